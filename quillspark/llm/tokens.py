"""Token ids of whole texts, by the `tokenizers` library.

A byte-level pre-tokenizer never joins characters across a single U+0020 between two characters that aren't white
space: what follows the space, with it, is encoded alone. The same holds before a run of line feeds. So texts are cut there, each
distinct unit is encoded by the library once, and the ids are strung together by array operations; the result is that of
encoding the whole text. New units of plain Latin characters go to the library many at once, as one text, whose ids fall apart
again where one begins with white space, words of letters alone to its model; a word with punctuation after it is put together from both. All others are encoded one
by one. Units are kept in a bounded cache in each Python worker. Whether a tokenizer may be cut like this is read from its
file; all others encode whole texts.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np

#: Units and ids of units that are kept; beyond that, those that were in several groups of texts remain, half as many at most.
CACHE_UNITS, CACHE_IDS = 500_000, 8_000_000
#: Longer units aren't kept.
LONG_UNIT = 64
#: Characters of the texts that are encoded at once, and units that the library gets as one text.
GROUP, JOINED = 1 << 20, 64

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than space and line feed, and all beyond Latin: texts with any of it take the careful way.
_RARE = re.compile("[^\n -~\u00a1-\u024f]")
#: Characters that follow a word as one piece.
_ENDS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"

def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself if it is printable Latin-1, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()
_CODES = np.array([ord(_LETTERS[b]) for b in range(256)], "<u4")
_BYTES = {c: b for b, c in _LETTERS.items()}
#: A space after something else.
_INNER = re.compile(f"[^{_LETTERS[0x20]}]{_LETTERS[0x20]}")


def _only_words(token: str) -> bool:
    """A text of letters and single spaces can hold the token; so can one that isn't whole characters."""
    try:
        return bytes(map(_BYTES.__getitem__, token)).decode().replace(" ", "").isalpha()
    except (KeyError, UnicodeDecodeError):
        return True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Units(dict):
    """unit -> number. New ones are numbered on and listed."""

    def __init__(self):
        super().__init__()
        self.next, self.new = 0, []

    def __missing__(self, unit: str) -> int:
        n = self.next
        self.next += 1
        self.new.append(unit)
        if len(unit) <= LONG_UNIT:
            self[unit] = n
        return n


class Encoder:
    """Units are keyed by what follows their space; a line feed in front stands for itself, a space for a unit without one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task a core
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        added = spec.get("added_tokens", [])
        self.cuts = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and not spec.get("normalizer") and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)
        )
        self.added = [t["content"] for t in added]
        self.joins = self.cuts and model.get("type") == "BPE" and not model.get("dropout") and all("<" in a for a in self.added)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: No token reaches from a word into the next: so the model can merge words at once.
        self.words = self.joins and sys.byteorder == "little" and not any(
            model.get(k) for k in ("ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix", "unk_token")
        ) and not any(_INNER.search(t) and _only_words(t) for t in vocabulary)
        self.model = self.tokenizer.model
        #: The ids that begin with a space or a line feed, and that of a line feed.
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[n for t, n in vocabulary.items() if t[:1] in (_LETTERS[0x20], _LETTERS[0x0A])]] = True
        self.line_feed = vocabulary.get(_LETTERS[0x0A], -1)
        self.units, self.filled = Units(), 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts, self.counts, self.uses = (np.zeros(1 << 14, k) for k in (np.int64, np.int64, np.int32))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _literal(self, unit: str) -> np.ndarray:
        return self._whole(unit[1:] if unit[0] == " " else unit if unit[0] == "\n" else " " + unit)

    def _joins(self, unit: str) -> bool:
        """It can be told apart from its neighbours: no white space but in front, nothing rare, no added token."""
        rest = unit[1:] if unit[0] in " \n" else unit
        return bool(rest) and not (" " in rest or "\n" in rest or _RARE.search(rest) or "<" in rest and any(a in rest for a in self.added))

    def _encoded(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of units that can be told apart, strung together, and their counts."""
        parts = [units[k : k + JOINED] for k in range(0, len(units), JOINED)]
        joined = ["".join(["\n" + u[1:] if u[0] == " " else u if u[0] == "\n" else " " + u for u in part]) for part in parts]
        ids, counts = [], []
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            own = np.array(e.ids, np.uint32)
            first = np.flatnonzero(self.begins[own])
            bare = np.flatnonzero(np.array([u[0] == " " for u in part]))
            if len(first) != len(part) or first[0] or (own[first[bare]] != self.line_feed).any():
                each = [self._literal(u) for u in part]
                own, count = np.concatenate(each), np.array([len(x) for x in each])
            else:
                count = np.diff(np.append(first, len(own)))
                count[bare] -= 1
                own = np.delete(own, first[bare])
            ids.append(own)
            counts.append(count)
        return ids, counts

    def _merged(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The same of words of letters alone, by the library's model, which merges within them only."""
        ids, counts = [], []
        for k in range(0, len(words), JOINED):
            part = words[k : k + JOINED]
            letters = _CODES[np.frombuffer((" " + " ".join(part)).encode(), np.uint8)].tobytes().decode("utf-32-le")
            own = np.array([t.id for t in self.model.tokenize(letters)], np.uint32)
            first = np.flatnonzero(self.begins[own])
            if len(first) != len(part) or first[0]:
                each = [self._literal(u) for u in part]
                own, count = np.concatenate(each), np.array([len(x) for x in each])
            else:
                count = np.diff(np.append(first, len(own)))
            ids.append(own)
            counts.append(count)
        return ids, counts

    def _put(self, numbers: list[int], ids: np.ndarray, counts: np.ndarray) -> None:
        to = self.filled + len(ids)
        if to > len(self.ids):
            self.ids = np.append(self.ids[: self.filled], np.zeros(to, np.uint32))
        self.ids[self.filled : to] = ids
        self.starts[numbers] = self.filled + np.cumsum(counts) - counts
        self.counts[numbers] = counts
        self.uses[numbers] = 0
        self.filled = to

    def _gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units, strung together, and where each ends."""
        counts = self.counts[numbers]
        ends = np.cumsum(counts)
        at = np.repeat(self.starts[numbers] - (ends - counts), counts)
        return self.ids[at + np.arange(len(at))], ends

    def _learn(self, plain: bool) -> None:
        """Encodes the new units. plain: their texts were cut at every white space."""
        units, new = self.units, self.units.new
        at = units.next - len(new)
        words, together, alone, ended, parts = ([], []), ([], []), ([], []), [], []
        every = "".join(new)
        plain = plain and self.joins and "<" not in every and not _RARE.search(every) and not {" ", "\n"} & {*new}
        for n, u in enumerate(new, at):  # grows by the parts of what is put together
            if not plain and not (self.joins and self._joins(u)):
                alone[0].append(n)
                alone[1].append(self._literal(u))
                continue
            head = u.rstrip(_ENDS)
            if len(head) == len(u) and self.words and u.isalpha():
                words[0].append(n)
                words[1].append(u)
            elif len(head) < len(u) and head.isalpha():
                ended.append(n)
                parts += [units[head], units[" " + u[len(head) :]]]
            else:
                together[0].append(n)
                together[1].append(u)
        units.new = []
        if units.next > len(self.starts):
            more = np.zeros(units.next, np.int64)
            self.starts, self.counts, self.uses = (np.append(x, more.astype(x.dtype)) for x in (self.starts, self.counts, self.uses))
        for own, encoded in ((words, self._merged), (together, self._encoded)):
            if own[0]:
                ids, counts = encoded(own[1])
                self._put(own[0], np.concatenate(ids), np.concatenate(counts))
        if alone[0]:
            self._put(alone[0], np.concatenate(alone[1]), np.array([len(x) for x in alone[1]]))
        if ended:
            ids, ends = self._gathered(np.array(parts))
            self._put(ended, ids, np.diff(ends[1::2], prepend=0))

    def _forget(self) -> None:
        """Keeps the units that were in most groups of texts since the last time, of those that were in two."""
        own = np.flatnonzero(self.uses[: self.units.next] > 1)
        own = np.sort(own[np.argsort(-self.uses[own], kind="stable")[: CACHE_UNITS // 2]])
        ids, ends = self._gathered(own)
        if len(ids) > CACHE_IDS // 2:
            own, ids, ends = own[:0], ids[:0], ends[:0]
        number = np.full(self.units.next, -1)
        number[own] = np.arange(len(own))
        kept = Units()
        kept.update((u, n) for u, n in zip(self.units, number[list(self.units.values())].tolist(), strict=True) if n >= 0)
        kept.next, self.units, self.filled = len(own), kept, 0
        self._put(number[own], ids, np.diff(ends, prepend=0))

    def largest_id(self) -> int:
        return max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)

    @staticmethod
    def _plain(text: str) -> bool:
        """Nothing rare, and no white space beside a space."""
        return not (_RARE.search(text) or "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ")

    def _cut(self, text: str, plain: bool) -> list[str]:
        """The units of a text."""
        if plain:
            if "\n" in text:  # a cut before each run of line feeds
                text = text.replace("\n", " \n")
                while "\n \n" in text:
                    text = text.replace("\n \n", "\n\n")
            units = text.split(" ")
        else:
            units = _CUT.split(text)
        if units[0]:
            units[0] = " " + units[0]
        else:
            del units[0]
        return units

    def _group(self, texts: list[str]) -> list[bytes]:
        every, to, all_plain = [], [], True
        for text in texts:
            plain = self._plain(text)
            all_plain &= plain
            every += self._cut(text, plain)
            to.append(len(every))
        numbers = np.fromiter(map(self.units.__getitem__, every), np.int64, len(every))
        if self.units.new:
            self._learn(all_plain)
        self.uses[numbers] += 1
        ids, ends = self._gathered(numbers)
        last = np.append(0, ends)[to].tolist()
        out = [ids[a:b].tobytes() for a, b in zip([0, *last], last, strict=False)]
        if self.units.next > CACHE_UNITS or self.filled > CACHE_IDS:
            self._forget()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if not self.cuts or sys.byteorder != "little":
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out, group, held = [], [], 0
        for text in texts:
            group.append(text)
            held += len(text)
            if held >= GROUP:
                out += self._group(group)
                group, held = [], 0
        return out + self._group(group) if group else out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
