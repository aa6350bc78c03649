"""Quality rules: a ledger of rule failures and measurements, policies over it, ablations by bit operations.

`measure(docs)`: each document is read once (an Arrow function; no shuffle) and gets its measurements.
`ledger(measured)`: every rule is evaluated once over the measurements; bit r of `failed_bits` says that rule r failed.
`store(ledger, path)`, `stored(spark, path)`: the ledger as a Parquet table with the rules' names and predicates, which are
compared when it is read: bits of rules that have changed since raise ValueError, rules appended since are missing in it. So
later policies over the same rules are applied to what is stored, without reading a text again.
`apply_policy(ledger, version)`: a policy is a versioned bit mask; a document is kept if it fails no rule in the mask.
`attributed(ledger, version)`: the versions that keep each document, and the one rule without which the policy would keep it.
`ablation(ledger, version)`: per rule of a policy, how many documents fail it, fail only it, and would be kept without
it. Bits are counted first (at most one row for each distinct bit set), so that what is shuffled doesn't grow with the
documents.

Defined results: null text counts as empty; texts without words have n_words 0 and fail `few_words`; ratios divide by
at least 1. A null id is kept as null. Repeated rows are judged each on its own. Very long texts are read whole; memory
is bounded by one text. Further columns (also of clashing names) are left out unless named in `keep`; those of `keep`
that bear a measurement's name are refused with ValueError. Empty tables give empty results.

Words are runs of anything but 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.words import slices, texts

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps_words", "n_shouts")

#: (name, predicate over the measurements). Bit r belongs to entry r; entries are only ever appended.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "4 * n_symbols > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("capitals", "2 * n_caps_words > n_words"),
    ("shouting", "4 * n_shouts > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
)
BIT = {name: 1 << r for r, (name, _) in enumerate(RULES)}

#: Policies by version: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines"),
    "v2": tuple(name for name, _ in RULES),
}
CURRENT = "v2"


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """Words that stand in an n-word window found twice or more."""
    if len(words) <= n:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    key = a[: len(a) - n + 1]
    size = len(ids)
    for k in range(1, n):
        if size * len(ids) >= 2**63:  # number the windows so far, to stay exact
            _, key = np.unique(key, return_inverse=True)
            size = int(key.max()) + 1
        key = key * len(ids) + a[k : len(a) - n + 1 + k]
        size *= len(ids)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(a), bool)
    for k in range(n):
        covered[k : len(a) - n + 1 + k] |= again
    return int(covered.sum())


def measure_text(text: bytes) -> tuple[int, ...]:
    """The values of MEASURES."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "replace"))
    symbols = sum(map(joined.count, SYMBOLS.encode()))
    caps = sum(1 for w in words if len(w) > 1 and w.isupper())
    shouts = sum(1 for w in words if w.endswith(b"!!")) if b"!!" in joined else 0
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), caps, shouts


def measure(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns of `keep` and the measurements, a row for each row of `docs`."""
    if clash := set(keep) & ({"failed_bits"} | set(MEASURES)):
        raise ValueError(f"columns named like measurements: {sorted(clash)}")
    kept = docs.select(*keep, docs[text].cast("string").alias("__text"))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [measure_text(t) for t in texts(b, "__text")]
            cols = zip(*rows, strict=True) if rows else [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays(
                b.columns[:n] + [pa.array(c, pa.int64()) for c in cols], b.schema.names[:n] + list(MEASURES)
            )

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:n])
    return kept.mapInArrow(run, ", ".join([shape, *(f"{m} long" for m in MEASURES)]))


def ledger(measured: DataFrame) -> DataFrame:
    """Adds failed_bits."""
    bits: Column = F.lit(0).cast("long")
    for r, (_, predicate) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(predicate), F.lit(1 << r).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("failed_bits", bits)


def policy_mask(version: str) -> int:
    return sum(BIT[name] for name in POLICIES[version])


def passes(version: str = CURRENT, bits: str = "failed_bits") -> Column:
    """True if no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(policy_mask(version)).cast("long")) == 0


def apply_policy(ledger_df: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds kept and policy."""
    return ledger_df.withColumn("kept", passes(version)).withColumn("policy", F.lit(version))


def attributed(ledger_df: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds kept_by (versions that keep it, sorted, comma-joined) and sole_rule (null unless exactly one rule of the policy
    fails)."""
    by = F.array_join(F.filter(F.array(*[F.when(passes(v), F.lit(v)) for v in sorted(POLICIES)]), lambda v: v.isNotNull()), ",")
    failed = F.col("failed_bits").bitwiseAND(F.lit(policy_mask(version)).cast("long"))
    sole = F.lit(None).cast("string")
    for name in POLICIES[version]:
        sole = F.when(failed == BIT[name], F.lit(name)).otherwise(sole)
    return ledger_df.withColumns({"kept_by": by, "sole_rule": sole})


def store(ledger_df: DataFrame, path: str) -> None:
    """Writes a ledger with the rules that its bits stand for."""
    ledger_df.write.parquet(f"{path}/ledger")
    rules = [(r, name, predicate) for r, (name, predicate) in enumerate(RULES)]
    ledger_df.sparkSession.createDataFrame(rules, "bit int, name string, predicate string").coalesce(1).write.parquet(f"{path}/rules")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """A stored ledger; its rules must be the first of RULES."""
    rules = [(r["name"], r["predicate"]) for r in spark.read.parquet(f"{path}/rules").orderBy("bit").collect()]  # a row for each rule
    if rules != list(RULES[: len(rules)]):
        raise ValueError(f"rules have changed since: {json.dumps(rules)}")
    return spark.read.parquet(f"{path}/ledger")


def ablation(ledger_df: DataFrame, version: str = CURRENT) -> DataFrame:
    """rule, n_failed, n_only (of the policy's rules, it alone failed), n_kept (by the policy), n_kept_without it."""
    mask = policy_mask(version)
    counts = ledger_df.groupBy((F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long"))).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in POLICIES[version]])
    rows = counts.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    only = F.col("bits") == F.col("bit")
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(F.lit(0)))
    return rows.groupBy("rule").agg(
        total(failed).alias("n_failed"),
        total(only).alias("n_only"),
        total(F.col("bits") == 0).alias("n_kept"),
        total((F.col("bits") == 0) | only).alias("n_kept_without"),
    )
