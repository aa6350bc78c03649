"""Evidence and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text

# Fixed value: the answer where there is no evidence.
NO_EVIDENCE = "The retrieved evidence is insufficient to answer this question."
TASK = "Answer the research question from the evidence below only, and cite every statement by its evidence id in square brackets."


def assign(results: DataFrame, rank: str = "final_rank") -> DataFrame:
    """G1: evidence_id E1, E2, … by rank."""
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(rank, "uid"))
    return results.withColumn("evidence_id", F.concat(F.lit("E"), at.cast("string")))


def integrity_error(answer: Column, declared: Column, supplied: Column) -> Column:
    """The first rule that an answer breaks, else null."""
    cited = text.cited_ids(answer)
    unknown = F.size(F.array_except(F.concat(cited, declared), supplied)) > 0
    return (
        F.when(text.has_malformed_citation(answer), "malformed citation")
        .when(F.exists(declared, lambda x: ~x.rlike(text.EVIDENCE_ID)), "malformed declared id")
        .when(unknown, "unknown evidence id")
        .when(declared != cited, "declared ids differ from citations")
    )


def extractive_answers(evidence: DataFrame, n: int = 3, limit: int = 240) -> DataFrame:
    """A deterministic provider: query_id, answer, declared from the first n pieces of evidence, each cited.

    evidence: query_id, evidence_id, text.
    """
    number = F.substring("evidence_id", 2, 10).cast("int")
    first = evidence.withColumn("n", number).where(F.col("n") <= n)
    bare = F.rtrim(F.regexp_replace(text.snippet(F.col("text"), limit), r"\[E[1-9][0-9]*\]", ""), F.lit(" .!?…"))
    line = F.concat(bare, F.lit(" ["), "evidence_id", F.lit("]."))
    rows = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line"), "evidence_id"))).alias("e"))
    answer = F.array_join(F.transform("e", lambda x: x["line"]), "\n")
    return rows.select("query_id", answer.alias("answer"), F.transform("e", lambda x: x["evidence_id"]).alias("declared"))


def prompts(evidence: DataFrame, fields: tuple[str, ...] = ("evidence_id", "uid", "text")) -> DataFrame:
    """query_id, evidence_ids, prompt: query and evidence as delimited JSON that can't forge the delimiters."""
    number = F.substring("evidence_id", 2, 10).cast("int")
    rows = evidence.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct(number.alias("n"), *fields))).alias("items"))
    items = F.transform("items", lambda i: F.struct(*[i[f].alias(f) for f in fields]))
    ids = F.transform("items", lambda i: i["evidence_id"])
    prompt = F.concat_ws(
        "\n", F.lit(TASK), F.concat(F.lit("Valid ids: "), F.to_json(ids)),
        F.lit("<QUERY>"), text.tag_safe_json(F.struct("query")), F.lit("</QUERY>"),
        F.lit("<EVIDENCE>"), text.tag_safe_json(items), F.lit("</EVIDENCE>"),
    )
    return rows.select("query_id", ids.alias("evidence_ids"), prompt.alias("prompt"))
