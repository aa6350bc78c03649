from collections import Counter

import pytest

from quillspark.llm import lines


def brute(rows):
    """Sequences; lines that may go: in a run of GRAM lines that starts at an earlier place too; lines that must go: in a
    run of GRAM + WINNOW - 1 lines that one earlier place holds, and holds first."""
    places = sorted({((1 << 62) if d is None else d, t) for d, t in rows if t is not None})
    first = {}
    seqs = {}
    for d, t in places:
        full = [(i, x.strip(" \t\r")) for i, x in enumerate(t.split("\n")) if x.strip(" \t\r")]
        seqs[d, t] = full
        for k in range(len(full) - lines.GRAM + 1):
            first.setdefault(tuple(x for _, x in full[k : k + lines.GRAM]), (d, t, k))
    may, must = {}, {}
    for (d, t), full in seqs.items():
        gone = set()
        for k in range(len(full) - lines.GRAM + 1):
            if first[tuple(x for _, x in full[k : k + lines.GRAM])] != (d, t, k):
                gone |= {i for i, _ in full[k : k + lines.GRAM]}
        may[d, t], must[d, t] = gone, set()
        heads = [first[tuple(x for _, x in full[k : k + lines.GRAM])] for k in range(len(full) - lines.GRAM + 1)]
        for k in range(len(heads) - lines.WINNOW + 1):
            b, c, j = heads[k]
            if (b, c, j) != (d, t, k) and heads[k : k + lines.WINNOW] == [(b, c, j + m) for m in range(lines.WINNOW)]:
                must[d, t] |= {i for i, _ in full[k : k + lines.WINNOW + lines.GRAM - 1]}
    return seqs, may, must


def test_whole_table(spark, documents):
    df, rows = documents
    seqs, may, must = brute(rows)
    got = {r["doc_id"]: r for r in lines.dedup_lines(df).collect()}
    assert len(got) == len(rows)
    removed = sure = 0
    for d, t in rows:
        r = got[d]
        assert r["n_lines"] == len(seqs[d, t])
        assert len(must[d, t]) <= r["n_removed"] <= len(may[d, t])
        kept = [x for x in r["text"].split("\n") if x.strip(" \t\r")]
        assert len(kept) == r["n_lines"] - r["n_removed"]
        lines_of = lambda cond: Counter(x for i, x in enumerate(t.split("\n")) if cond(i) and x.strip(" \t\r"))  # noqa: B023, E731
        assert not lines_of(lambda i: i not in may[d, t]) - Counter(kept)  # noqa: B023
        assert not lines_of(lambda i: i in must[d, t]) - (lines_of(lambda i: True) - Counter(kept))  # noqa: B023
        removed += r["n_removed"]
        sure += len(must[d, t])
    assert removed >= sure > 0


def test_runs(spark):
    a = "\n".join(f"line {i}" for i in range(20))
    rows = [
        (5, "x\ny\n" + a + "\nz"),
        (3, a),
        (7, "line 4\nline 6\nline 8"),  # no run
        (8, "q\nline 4\nline 5\nline 6\nr"),
        (9, "u\nv\nw\nu\nv\nw"),  # repeats itself
    ]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3] == (a, 0)
    assert got[5] == ("x\ny\nz", 20)
    assert got[7] == (rows[2][1], 0)
    assert got[8] == ("q\nr", 3)
    assert got[9] == ("u\nv\nw", 3)


def test_long_document(spark):
    """Line numbers beyond one mask word."""
    a = "\n".join(f"line {i}" for i in range(300))
    rows = [(1, a), (2, "top\n" + a + "\nend")]
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2]["text"] == "top\nend" and got[2]["n_removed"] == 300 and got[2]["n_lines"] == 302


def test_odd_rows(spark, odd, empty):
    df, rows = odd
    got = lines.dedup_lines(df).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got if r["n_removed"] == 0) == Counter((r[0], r[1]) for r in rows if r[0] != 8)
    assert [(r["text"], r["n_lines"], r["n_removed"]) for r in got if r["doc_id"] == 8] == [("zero line\n", 4, 3)]
    assert lines.dedup_lines(empty).columns == [*empty.columns, "n_lines", "n_removed"]
    assert lines.dedup_lines(empty).count() == 0
    with pytest.raises(ValueError):
        lines.dedup_lines(df.withColumnRenamed("lang", "n_lines"))


def test_every_repeated_passage_goes(spark, documents):
    """Exactly the lines of more than LONG words and of runs of two that stand earlier, whatever holds their parts first."""
    df, rows = documents
    long = " ".join(f"w{i}" for i in range(lines.LONG + 1))
    short = long.rsplit(" ", 1)[0]
    extra = [
        (10**9, f"a1\n{long}\n{short}"), (10**9 + 1, long), (10**9 + 2, f"b1\n {long}\r\nb2"), (10**9 + 3, short),
        (10**9 + 4, "p\nq"), (10**9 + 5, "q\nr\ns"), (10**9 + 6, "p\nq\nr\nt"), (10**9 + 7, "r\nt\nu\nv\nu\nv\nv\nv"),
    ]
    rows = rows + extra
    seen, want = set(), {}
    for d, t in rows:  # oldest first
        full = [(i, x.strip(" \t\r")) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\r")]
        gone = set()
        for n in (1, 2):
            for k in range(len(full) - n + 1):
                gram = tuple(x for _, x in full[k : k + n])
                if n == 2 or len(gram[0].split()) > lines.LONG:
                    if gram in seen:
                        gone |= {i for i, _ in full[k : k + n]}
                    seen.add(gram)
        kept = [x for i, x in enumerate((t or "").split("\n")) if i not in gone]
        want[d] = ("\n".join(kept) if any(x.strip(" \t\r") for x in kept) else "", len(gone)) if gone else (t, 0)
    more = spark.createDataFrame(extra, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.dedup_lines(df.select("doc_id", "text").union(more)).collect()}
    assert got == want
    assert want[10**9 + 1] == ("", 1) and want[10**9 + 2][1] == 1 and want[10**9 + 6] == ("t", 3)


def test_small_alphabets(spark):
    """Every run of two lines or more that stands earlier is gone, whatever places hold its parts first; nothing else is."""
    import random

    rng = random.Random(4)
    rows = [(i, "\n".join(f"L{rng.randrange(6)}" for _ in range(rng.randrange(1, 9)))) for i in range(200)]
    rows += [(200 + i, "\n".join(f"M{rng.randrange(40)}" for _ in range(rng.randrange(1, 30)))) for i in range(100)]
    seen, want = set(), {}
    for d, t in rows:
        own = t.split("\n")
        gone = set()
        for k in range(len(own) - 1):
            if (own[k], own[k + 1]) in seen:
                gone |= {k, k + 1}
            seen.add((own[k], own[k + 1]))
        want[d] = ("\n".join(x for k, x in enumerate(own) if k not in gone), len(gone))
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_equal_lines(spark):
    """100,000 equal lines in one document: linear in time and memory; the first line stays."""
    rows = [(1, "\n".join(["same line"] * 100_000)), (2, "same line\nsame line\nother"), (3, "x" * 2_000_000)]
    got = {r["doc_id"]: (len(r["text"]), r["n_lines"], r["n_removed"]) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (9, 100_000, 99_999), 2: (5, 3, 2), 3: (2_000_000, 1, 0)}
