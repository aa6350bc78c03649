"""Line dedup by winnowing over line hashes, in built-in functions only.

A document's sequence are its non-blank lines (cut at line feeds, trimmed of spaces, tabs and carriage returns), each a
64-bit hash. Documents are ordered by id. A passage is `WINNOW` consecutive lines, or a line of more than `LONG` words.
* Fingerprints: of each window of `WINNOW` lines the smallest hash (the last of equal ones) is selected, and every long line.
  Equal passages have equal fingerprints at the same place in them, so each repeated passage is found by one.
* Positions are joined by fingerprint: those whose line stands nowhere else are done with. A count by line, aggregated before
  the shuffle, is all that a line that every document has costs; no pairs of its positions are made.
* Matches are extended both ways: a shared position gives the windows of which it is the minimum, each with the hashes of
  its lines, and each is joined with its own first holder, the smallest (id, line). A longer run is the windows it consists of,
  whatever places hold them first. So extension takes one comparison a window, not one for each pair of places.
* Lines of passages that have an earlier place are deleted. Places are judged on the input.
So what is deleted always stands earlier, and nothing stays of a line of more than `LONG` words that stands earlier, or of a
run of `WINNOW` or more lines that stands earlier. A shorter line that is repeated alone stays.

Defined results: null text stays null; texts without non-blank lines are unchanged. Null ids come after all others.
Rows that agree in id and text are one place: they are all treated as the first of them. Rows with equal ids and different
texts are ordered by a hash of the text. `text` of a document that has lost all non-blank lines is "". Other columns are
passed through; names beginning with "__" are refused. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.written import written

GRAM = 1
WINNOW = 2
LONG = 50
_LAST = (1 << 63) - 1


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def _is_long(line: Column) -> Column:
    """More than LONG words; the lengths of most lines tell that they have fewer."""
    words = F.size(F.split(F.trim(line, F.lit(" \t\x0b\f\r")), "[ \t\x0b\f\r]+"))
    return F.when(F.length(line) > 2 * LONG, words > LONG).otherwise(False)


def _run(column: str, start: Column, n: int) -> Column:
    """n elements of an array; Spark's slice copies the whole array each time where it is interpreted, as in lambdas."""
    return F.array(*[F.element_at(column, start + k) for k in range(n)])


def line_sequences(docs: DataFrame) -> DataFrame:
    """__ord, __sig, h (hashes of the non-blank lines), at (their line numbers), long (of more than LONG words), chosen (of each
    window the place of its minimum in h, from 1), a row for each place that has a passage."""
    every = F.transform(_lines(F.col("t")), lambda line, i: F.struct(i.cast("int").alias("i"), _trimmed(line).alias("line")))
    full = F.filter(every, lambda x: x["line"] != "")
    one = lambda x: F.struct(F.xxhash64(x["line"]).alias("h"), x["i"].alias("i"), _is_long(x["line"]).alias("long"))
    seq = docs.select("__ord", "__sig", F.transform(full, one).alias("s"))
    some = seq.where((F.size("s") >= WINNOW) | F.exists("s", lambda x: x["long"]))
    some = some.select("__ord", "__sig", F.col("s.h").alias("h"), F.col("s.i").alias("at"), F.col("s.long").alias("long"))
    # The aggregate also keeps Spark from taking the arrays out of s anew for each window.
    some = some.dropDuplicates(["__ord", "__sig"])

    def minimum(i: Column) -> Column:
        window = _run("h", i, WINNOW)
        return (i + WINNOW - F.array_position(F.reverse(window), F.array_min(window))).cast("int")

    starts = F.when(F.size("h") >= WINNOW, F.sequence(F.lit(1), F.size("h") - WINNOW + 1)).otherwise(F.array().cast("array<int>"))
    return some.withColumn("chosen", F.transform(starts, minimum))


def fingerprints(seq: DataFrame) -> DataFrame:
    """f, the line hash of each selected position."""
    long = F.filter(F.sequence(F.lit(1), F.size("h")), lambda i: F.element_at("long", i))
    return seq.select(F.explode(F.transform(F.array_union("chosen", long), lambda i: F.element_at("h", i))).alias("f"))


def positions(seq: DataFrame) -> DataFrame:
    """__ord, __sig, f, passages (g: hashes, lines: line numbers), a row for each selected position, with the passages of which
    it is the fingerprint."""

    def of(i: Column) -> Column:
        passage = lambda s, n: F.struct(_run("h", s, n).alias("g"), _run("at", s, n).alias("lines"))
        around = F.sequence(F.greatest(F.lit(1), i - WINNOW + 1), F.least(i, F.size("h") - WINNOW + 1))
        windows = F.filter(F.when(F.size("chosen") > 0, around).otherwise(F.array().cast("array<int>")), lambda s: F.element_at("chosen", s) == i)
        alone = F.when(F.element_at("long", i), F.array(i)).otherwise(F.array().cast("array<int>"))
        return F.concat(F.transform(alone, lambda s: passage(s, GRAM)), F.transform(windows, lambda s: passage(s, WINNOW)))

    every = F.transform(F.sequence(F.lit(1), F.size("h")), lambda i: F.struct(F.element_at("h", i).alias("f"), of(i).alias("passages")))
    return seq.select("__ord", "__sig", F.explode(F.filter(every, lambda x: F.size(x["passages"]) > 0)).alias("e")).select("__ord", "__sig", "e.*")


def deleted_lines(seq: DataFrame) -> DataFrame:
    """__ord, __sig, line: the numbers of lines to delete (a line may come several times)."""
    # Written, so that the joins below deal both sides out themselves: Spark can then split a fingerprint or a passage that a
    # large part of all documents has, which it can't where an aggregate stands between exchange and join.
    shared = written(fingerprints(seq).groupBy("f").count().where("count > 1").select("f"), "shared")
    met = positions(seq).join(shared, "f").select("__ord", "__sig", F.explode("passages").alias("e"))
    met = written(met.select("__ord", "__sig", "e.g", "e.lines"), "passages")
    place = F.struct("__ord", "__sig", F.element_at("lines", 1).alias("line"))
    first = written(met.groupBy("g").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("g", "first"), "holders")
    later = met.join(first, "g").where(place != F.col("first"))
    return later.select("__ord", "__sig", F.explode("lines").alias("line"))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of `docs` with lines deleted from `text`, and n_lines, n_removed (non-blank and deleted lines)."""
    if any(c.startswith("__") or c in ("n_lines", "n_removed") and c not in (id_column, text) for c in docs.columns):
        raise ValueError("columns named __*, n_lines or n_removed can't be passed through")
    order = [F.coalesce(docs[id_column].cast("long"), F.lit(_LAST)).alias("__ord"), F.xxhash64(docs[text].cast("string")).alias("__sig")]
    seq = written(line_sequences(docs.select(*order, docs[text].cast("string").alias("t"))), "lines")
    words = (
        deleted_lines(seq)
        .groupBy("__ord", "__sig", (F.col("line") / 64).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, line % 64)")).alias("m"))
    )
    masks = words.groupBy("__ord", "__sig").agg(F.map_from_entries(F.collect_list(F.struct("w", "m"))).alias("__masks"))
    keyed = docs.select("*", *order).join(masks, ["__ord", "__sig"], "left")
    lines = _lines(F.col(text).cast("string"))
    dense = F.transform(F.sequence(F.lit(0), (F.size(lines) / 64).cast("int")), lambda w: F.coalesce(F.element_at("__masks", w), F.lit(0).cast("long")))
    with_dense = keyed.withColumn("__dense", F.when(F.col("__masks").isNotNull(), dense))
    gone = lambda i: F.expr("1L") == F.call_function("shiftrightunsigned", F.get("__dense", (i / 64).cast("int")), i % 64).bitwiseAND(F.lit(1).cast("long"))
    kept = F.filter(lines, lambda line, i: ~gone(i))
    text_left = F.when(F.exists(kept, lambda x: _trimmed(x) != ""), F.array_join(kept, "\n")).otherwise("")
    removed = F.coalesce(F.aggregate("__dense", F.lit(0), lambda n, w: n + F.bit_count(w)), F.lit(0)).cast("long")
    n_lines = F.coalesce(F.size(F.filter(lines, lambda x: _trimmed(x) != "")), F.lit(0)).cast("long")
    out = [F.when(F.col("__dense").isNotNull(), text_left).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in docs.columns]
    return with_dense.select(*out, n_lines.alias("n_lines"), removed.alias("n_removed"))
