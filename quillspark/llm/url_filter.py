"""URL filters: host and path rules, then a weighted vocabulary found by an Aho-Corasick automaton.

`judge_urls(pages)` adds host, path, rule, verdict, weight, strict_terms, soft_terms.
* Null url, or one without "://": host and path are empty, no rule fits, nothing is found: allow.
* Host: what stands between the first "://" and the next "/", "?", "#" or the end, A-Z lower-cased (a port or user
  name stays part of it). Path: from there up to "?", "#" or the end.
* A rule (verdict, host, path) fits its host and all subdomains if the path starts with the rule's. The longest rule
  (host and path characters together) wins; of two equally long ones the first in code-point order.
* Without a rule: the distinct terms in host and path are found, and their weights added; the url is rejected if they reach
  `LIMIT`. A strict term weighs `LIMIT`, so one is enough; a soft term weighs less, so several distinct ones are needed. A term
  counts only where no letter or digit adjoins it, so "essex" holds no "sex". Terms of several words are found with "-", "_"
  or "." between the words. Overlapping terms are found independently, repeated ones count once.
* A vocabulary is a table of version, term and weight (`read_vocabulary`), of at most `MOST_TERMS` terms; `DEFAULT` is used
  where none is given. The automaton is built once in a worker. No shuffle, one pass, bounded memory.
* Null ids are kept, repeated rows judged each. Urls of any length are searched whole, in time that grows with their length.
  Empty tables give empty results; further columns are left out of the result unless named in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The rules of the query's contract (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

LIMIT = 2.0
MOST_TERMS = 1_000_000

# Terms that reject alone.
STRICT_TERMS = (
    "adult-x", "bestiality", "blowjob", "bukkake", "camgirl", "camgirls", "cheap-pills", "cheap-viagra", "cialis", "creampie",
    "cumshot", "deepthroat", "escorts", "gangbang", "handjob", "hardcore-sex", "hentai", "incest", "milf", "onlyfans-leak", "porn",
    "porno", "pornhub", "pornography", "redtube", "sex", "sexcam", "spam-farm", "threesome", "viagra", "warez", "xhamster", "xnxx",
    "xvideos", "xxx", "youporn",
)

# Terms that reject together.
SOFT_TERMS = (
    "ads", "adult", "baccarat", "bet", "bets", "betting", "bingo", "bitcoin-doubler", "blackjack", "bonus", "casino", "cheap", "click",
    "coupon", "crack", "dating", "discount", "download-free", "erotic", "escort", "fetish", "free", "gambling", "giveaway", "hookup",
    "jackpot", "keygen", "lingerie", "loan", "loans", "lottery", "naked", "nude", "nudes", "offer", "payday", "pills", "poker", "promo",
    "replica", "roulette", "serial-key", "sexy", "slots", "spam", "streaming-free", "topless", "torrent", "track", "win", "winner",
)


@dataclass(frozen=True)
class Vocabulary:
    """Terms and their weights, of one version."""

    version: str
    weights: tuple[tuple[str, float], ...]

    def __post_init__(self) -> None:
        if any(w <= 0 for _, w in self.weights):
            raise ValueError("weights are positive")

    @property
    def strict(self) -> tuple[str, ...]:
        return tuple(t for t, w in self.weights if w >= LIMIT)

    @property
    def soft(self) -> tuple[str, ...]:
        return tuple(t for t, w in self.weights if w < LIMIT)


DEFAULT = Vocabulary("builtin-2", tuple((t, LIMIT) for t in STRICT_TERMS) + tuple((t, LIMIT / 2) for t in SOFT_TERMS))


def read_vocabulary(terms: DataFrame, version: str) -> Vocabulary:
    """The vocabulary of a version from a table with version, term, weight; null terms or weights are left out, of repeated
    terms the largest weight counts. More than MOST_TERMS raise ValueError, so what workers hold has a bound."""
    rows = terms.where((F.col("version") == version) & F.col("term").isNotNull() & F.col("weight").isNotNull())
    rows = rows.groupBy("term").agg(F.max(F.col("weight").cast("double")).alias("weight")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return Vocabulary(version, tuple(sorted((r["term"], r["weight"]) for r in rows)))


_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_JOINTS = str.maketrans("_.", "--")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a url."""
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    cut = min(ends, default=len(rest))
    host, tail = rest[:cut].translate(_LOWER), rest[cut:]
    ends = [i for i in map(tail.find, "?#") if i >= 0]
    return host, tail[: min(ends, default=len(tail))]


def find_rule(host: str, path: str, rules: Sequence[tuple[str, str, str]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    fits = [
        (-len(h) - len(p), h + p, verdict)
        for verdict, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return min(fits)[1:] if fits else None


@lru_cache(maxsize=8)
def automaton(weights: tuple[tuple[str, float], ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in sorted(weights, key=lambda x: x[1]):  # the largest weight of terms that fold to the same
        term = term.translate(_LOWER).translate(_JOINTS)
        if term:
            found.add_word(term, (term, weight))
    if len(found):
        found.make_automaton()
    return found


def terms_in(text: str, vocabulary: Vocabulary = DEFAULT) -> dict[str, float]:
    """Distinct terms of a text at word boundaries, with their weights."""
    auto = automaton(vocabulary.weights)
    hits: dict[str, float] = {}
    if not len(auto):
        return hits
    low = text.translate(_LOWER).translate(_JOINTS)
    for end, (term, weight) in auto.iter(low):
        start = end - len(term) + 1
        if (start == 0 or not low[start - 1].isalnum()) and (end + 1 == len(low) or not low[end + 1].isalnum()):
            hits[term] = weight
    return hits


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    keep: Sequence[str] = ("page_id",),
    rules: Sequence[tuple[str, str, str]] = RULES,
    vocabulary: Vocabulary = DEFAULT,
) -> DataFrame:
    """One row for each row of `pages`: the columns of `keep`, then what the module's text says."""
    rules = tuple(map(tuple, rules))
    kept = pages.select(*keep, pages[url].alias("__url"))
    n_keep = len(keep)
    names = ["host", "path", "rule", "verdict", "weight", "strict_terms", "soft_terms"]
    kinds = (pa.string(),) * 4 + (pa.float64(),) + (pa.list_(pa.string()),) * 2

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for u in b.column(n_keep).to_pylist():
                host, path = split_url(u)
                hits = terms_in(host + path, vocabulary)
                fit, weight = find_rule(host, path, rules), sum(hits.values())
                verdict = fit[1] if fit else "block" if weight >= LIMIT else "allow"
                strict, soft = (sorted(t for t, w in hits.items() if (w >= LIMIT) is k) for k in (True, False))
                out.append((host, path, fit[0] if fit else None, verdict, weight, strict, soft))
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            arrays = [pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:n_keep] + arrays, b.schema.names[:n_keep] + names)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:n_keep])
    return kept.mapInArrow(
        judge, f"{shape}, host string, path string, rule string, verdict string, weight double, strict_terms array<string>, soft_terms array<string>"
    )
