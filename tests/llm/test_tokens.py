import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import packing, queries, token_files, tokens

PATH = tokens.default_path()
ENCODER = tokens.encoder(PATH)
PLAIN = Tokenizer.from_file(PATH)


def ids_of(text, end):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def same(text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t\x0b\x1c\x85\xa0  '.,#|<>!abszZ019_-éßªº²½ÄΩя日́\U0001f600")), max_size=40))
def test_any_text(text):
    same(text)


@pytest.mark.parametrize("text", ["", " ", " a  b ", "a <|endoftext|> b", "x<|endoftext|>", "don't I'll we've x's 's", "a\r\n b", "a\x85 b", "y" * 500 + " z", "a " * 300])
def test_odd_texts(text):
    same(text)


def test_whole_documents(documents):
    for _, text in documents[1]:
        same(text)


def test_other_kinds():
    import public_tokenizers

    enc = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not enc.cuts
    want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode("Some Words here", add_special_tokens=False).ids
    assert np.frombuffer(enc.encode(["Some Words here"])[0], "<u4").tolist() == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("  \n\n abSzéÄ'.,!1<")), max_size=30), max_size=6))
def test_line_feeds_and_punctuation(texts):
    got = tokens.Encoder.encode(ENCODER, texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_words_reach_the_library_together(monkeypatch):
    """Of texts of words never seen, only few calls go to the library; forgetting units changes nothing."""
    monkeypatch.setattr(tokens, "CACHE_UNITS", 3_000)
    monkeypatch.setattr(tokens, "GROUP", 20_000)
    enc, rng, calls = tokens.Encoder(PATH), random.Random(5), []
    word = lambda: "".join(rng.choice("abcdefghijéüß") for _ in range(rng.randint(1, 12)))
    texts = [" ".join(word() + rng.choice(["", "", ",", ".\nThe", "!?", "\n\nxy"]) for _ in range(800)) + "\n" * (k % 3) for k in range(12)]

    class Counted:
        def __init__(self, of):
            self.of = of

        def __getattr__(self, name):
            calls.append(name)
            return getattr(self.of, name)

    enc.tokenizer, enc.model = Counted(enc.tokenizer), Counted(enc.model)
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)]
        assert got == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) < 1_000 and enc.units.next <= 3_000 + 20_000


# ---------------------------------------------------------------- packing

def test_first_fit_decreasing():
    rng = random.Random(5)
    for n in (0, 1, 2, 7, 300):
        sizes = [rng.randint(1, 100) for _ in range(n)]
        bins = []
        want = {}
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            k = next((k for k, used in enumerate(bins) if used + sizes[i] <= 100), len(bins))
            if k == len(bins):
                bins.append(0)
            want[i] = (k, bins[k])
            bins[k] += sizes[i]
        assert dict(enumerate(packing.first_fit_decreasing(sizes, 100))) == want


def check_pieces(pieces, sizes, capacity, spare):
    """pieces: (doc, start, length, sequence, offset). Every id once, no gaps, at most `spare` sequences with padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for d, start, length, seq, offset in pieces:
        assert length > 0
        by_doc[d].append((start, length))
        by_seq[seq].append((offset, length))
    for d, size in sizes.items():
        at = 0
        for start, length in sorted(by_doc[d]):
            assert start == at
            at += length
        assert at == size
    padded = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padded += at < capacity
    assert padded <= spare


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_pack_sizes(sizes):
    check_pieces(packing.pack_sizes(sizes, 64), dict(enumerate(sizes)), 64, 1)


def test_packing_query(spark, documents):
    _, rows = documents
    got = queries.op1_packing(spark, "/root/testdata/sf0.001").collect()
    ids = {d: ids_of(t, 1) for d, t in rows}
    check_pieces([(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in got], {d: len(x) for d, x in ids.items()}, 2048, 1)
    for r in got:
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])


def test_packing_odd_rows(spark, odd, empty):
    df, rows = odd
    got = packing.pack(df, PATH, 1, group_docs=2).collect()
    assert sum(r["length"] for r in got) == sum(len(ids_of(r[1], 1)) for r in rows)
    assert {r["doc_id"] for r in got} == {r[0] for r in rows}
    assert [(r["length"], np.frombuffer(r["piece_ids"], "<u4").tolist()) for r in got if r["doc_id"] in (2, 3)] == [(1, [1]), (1, [1])]
    seen = defaultdict(int)
    for r in got:
        seen[r["sequence_id"]] += r["length"]
    assert max(seen.values()) <= 2048
    assert packing.pack(empty, PATH, 1).count() == 0


# ---------------------------------------------------------------- token files

@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**16 - 1), max_size=50), max_size=12), st.sampled_from([(8, 2), (8, 4), (1, 16), (1, 32)]), st.sampled_from([8, 64]))
def test_round_trip(docs, shape, block):
    out = io.BytesIO()
    w = token_files.Writer(out, *shape, block)
    for k, d in enumerate(docs):
        w.add(None if k == 0 else k, np.array(d, np.uint32))
    w.close()
    raw = out.getvalue()
    r = token_files.Reader(lambda at, n: raw[at : at + n], len(raw))
    assert [(i, x.tolist()) for i, _, x in r.documents()] == [(None if k == 0 else k, d) for k, d in enumerate(docs)]
    flat = [x for d in docs for x in d]
    for at in range(0, len(flat), 7):
        assert r.ids(at, min(9, len(flat) - at)).tolist() == flat[at : at + 9]


def test_large_ids():
    w = token_files.Writer(io.BytesIO(), 8, 2, 4)
    with pytest.raises(ValueError):
        w.add(1, np.array([1, 70_000, 3, 4], np.uint32))


def test_token_file_query(spark, documents):
    _, rows = documents
    got = {r["doc_id"]: r for r in queries.op10_token_files(spark, "/root/testdata/sf0.001").collect()}
    at = 0
    for d, t in rows:
        ids = ids_of(t, 0)
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_token_files_odd_rows(spark, odd, empty, tmp_path):
    df, rows = odd
    path = f"file://{tmp_path}/t"
    manifest = token_files.write_token_files(df, path, PATH, 0, bits=1, planes=16, block_ids=512)
    got = sorted(token_files.read_token_files(spark, path, manifest).collect(), key=lambda r: r["start"])
    want = sorted(((r[0] is not None, r[0] or 0, r[1] or ""), r[0], ids_of(r[1], 0)) for r in rows)
    assert [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got] == [w[1:] for w in want]
    assert [r["start"] for r in got] == [sum(len(w[2]) for w in want[:k]) for k in range(len(want))]
    none = token_files.write_token_files(empty, f"file://{tmp_path}/e", PATH, 0)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/e", none).count() == 0


def test_planes_follow_the_ids(spark, tmp_path):
    """An end id beyond 65,536 gets a third byte plane; seventeen bit planes."""
    df = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    for bits, planes in ((8, 3), (1, 17)):
        path = f"file://{tmp_path}/p{bits}"
        assert token_files.planes_for(100_000, bits) == planes
        manifest = token_files.write_token_files(df, path, PATH, 100_000, bits=bits)
        got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_files.read_token_files(spark, path, manifest).collect()}
        assert got == {1: ids_of("one two", 100_000), 2: [100_000]}
