"""The gold set (S3, E3, E4, A17, A26, A27, F17, F18, JN6, JN8): scan, validation, statistics, review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.functions import text

# Categories of queries and grades of labels.
TYPES = (
    "legal_principle", "statutory_interpretation", "doctrine_or_test", "procedural", "fact_pattern", "exact_terminology", "semantic_paraphrase",
)
DIFFICULTIES = ("easy", "medium", "hard")
GRADES = (1, 2, 3)
FIELDS = tuple(f.split(" ")[0] for f in ("query_id", "query", "query_type", "difficulty", "notes", "relevant_paragraphs"))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Gold queries, and lines whose field set isn't exactly the expected one."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    keys = F.json_object_keys("value")
    want = F.array(*map(F.lit, FIELDS))
    wrong = lines.where(keys.isNull() | (F.size(F.array_except(want, keys)) > 0) | (F.size(F.array_except(keys, want)) > 0))
    good = lines.select(F.from_json("value", schemas.GOLD).alias("q")).select("q.*")
    problems = wrong.select("value", F.array_except(want, keys).alias("missing"), F.array_except(keys, want).alias("unknown"))
    return good, problems


def labels(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode("relevant_paragraphs").alias("l")).select("query_id", "l.*")


def violations(queries: DataFrame, paragraphs: DataFrame | None = None, expected: int | None = None) -> DataFrame:
    """(query_id, problem). paragraphs: paragraph_uid, case_name, case_number, paragraph_number, page_number."""
    row = queries.select(
        "query_id",
        F.filter(
            F.array(
                F.when(F.trim(F.coalesce("query", F.lit(""))) == "", F.lit("empty query")),
                F.when(F.coalesce(~F.col("query_type").isin(*TYPES), F.lit(True)), F.lit("unknown query_type")),
                F.when(F.coalesce(~F.col("difficulty").isin(*DIFFICULTIES), F.lit(True)), F.lit("unknown difficulty")),
                F.when(F.coalesce(F.size("relevant_paragraphs"), F.lit(0)) <= 0, F.lit("no labels")),
                F.when(F.exists("relevant_paragraphs", lambda x: F.coalesce(~x["relevance"].isin(*GRADES), F.lit(True))), F.lit("bad grade")),
                F.when(~F.exists("relevant_paragraphs", lambda x: x["relevance"] == max(GRADES)), F.lit("no label of the best grade")),
                F.when(F.size(F.array_distinct(F.transform("relevant_paragraphs", lambda x: x["paragraph_uid"]))) < F.size("relevant_paragraphs"), F.lit("repeated label")),
            ),
            lambda x: x.isNotNull(),
        ).alias("problems"),
    )
    out = row.select("query_id", F.explode("problems").alias("problem"))
    repeated = lambda key, what: queries.groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.max("query_id").alias("query_id")).where("n > 1").select("query_id", F.lit(what).alias("problem"))
    out = out.union(repeated(F.col("query_id"), "repeated query_id")).union(repeated(F.trim(text.latin_fold(F.col("query"))), "repeated query"))
    if expected is not None:
        out = out.union(queries.agg(F.count("*").alias("n")).where(F.col("n") != expected).select(F.lit(None).cast("string").alias("query_id"), F.lit("another number of queries").alias("problem")))
    if paragraphs is not None:
        facts = ("case_name", "case_number", "paragraph_number", "page_number")
        stored = paragraphs.select("paragraph_uid", F.lit(True).alias("known"), *[F.col(c).alias(f"s_{c}") for c in facts])
        joined = labels(queries).join(stored, "paragraph_uid", "left")
        same = F.lit(True)
        for c in facts:
            same = same & F.col(c).eqNullSafe(F.col(f"s_{c}"))
        problem = F.when(F.col("known").isNull(), "unknown paragraph").when(~same, "provenance differs")
        out = out.union(joined.select("query_id", problem.alias("problem")).where("problem is not null"))
    return out


def _domain(spark: SparkSession) -> DataFrame:
    rows = [("query_type", t) for t in TYPES] + [("difficulty", d) for d in DIFFICULTIES] + [("relevance", str(g)) for g in GRADES]
    return spark.createDataFrame(rows, "kind string, category string")


def category_counts(queries: DataFrame) -> DataFrame:
    """Kind, category, n, with categories that don't occur."""
    grade = labels(queries).select(F.lit("relevance").alias("kind"), F.col("relevance").cast("string").alias("category"))
    each = queries.select(F.lit("query_type").alias("kind"), F.col("query_type").alias("category")).union(
        queries.select(F.lit("difficulty").alias("kind"), F.col("difficulty").alias("category"))
    ).union(grade)
    counted = each.groupBy("kind", "category").agg(F.count("*").alias("n"))
    return _domain(queries.sparkSession).join(counted, ["kind", "category"], "left").select("kind", "category", F.coalesce("n", F.lit(0)).alias("n"))


def statistics(queries: DataFrame) -> DataFrame:
    """A17 in one row."""
    n = F.size("relevant_paragraphs")
    cases = F.size(F.array_distinct(F.transform("relevant_paragraphs", lambda x: F.struct(x["case_name"], x["case_number"]))))
    return queries.agg(
        F.count("*").alias("n_queries"), F.sum(n).alias("n_labels"), F.avg(n).alias("mean_labels"), F.min(n).alias("min_labels"), F.max(n).alias("max_labels"),
        F.count_if(n > 1).alias("queries_with_several_labels"), F.count_if(cases > 1).alias("queries_with_several_cases"),
    ).crossJoin(labels(queries).agg(F.count_distinct("case_name", "case_number").alias("n_cases")))  # fmt: skip  one row each


def review(queries: DataFrame, paragraphs: DataFrame, limit: int = 240) -> str:
    """A Markdown review; the gold set is small."""
    cut = paragraphs.select("paragraph_uid", text.snippet(F.col("text"), limit).alias("snippet"))
    rows = labels(queries).join(cut, "paragraph_uid", "left").join(queries.select("query_id", "query"), "query_id").orderBy("query_id", F.desc("relevance"), "paragraph_uid").collect()
    out, last = ["# Gold queries", ""], None
    for r in rows:
        if r["query_id"] != last:
            out += [f"## {r['query_id']}: {r['query']}", ""]
            last = r["query_id"]
        out.append(f"- grade {r['relevance']}, {r['case_name']}, paragraph {r['paragraph_number']}: {r['snippet']}")
    return "\n".join(out) + "\n"
