"""Parameter sweeps and error analysis (E6-E11, A14-A16, A21, A22, JN16, M14, W12-W14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import fusion
from quillspark.plans import evaluation

# The grid.
RRF_VALUES = (10, 20, 40, 60, 80, 100)
DEPTHS = ((30, 30), (40, 40), (50, 50), (50, 30), (30, 50))
RERANK_DEPTHS = (30, 40, 50)
FULL_DEPTH, DEPTH_K = 50, 60


def grid(spark: SparkSession) -> DataFrame:
    """experiment_id, bm25_depth, dense_depth, rrf_k; each point once."""
    points = dict.fromkeys([(FULL_DEPTH, FULL_DEPTH, k) for k in RRF_VALUES] + [(*d, DEPTH_K) for d in DEPTHS])
    rows = [(f"rrf_b{b}_d{d}_k{k}", b, d, k) for b, d, k in points]
    return spark.createDataFrame(rows, "experiment_id string, bm25_depth int, dense_depth int, rrf_k int")


def sweep(bm25: DataFrame, dense: DataFrame, configs: DataFrame, top: int = 10, digits: int | None = None) -> DataFrame:
    """E7, JN16: the fused lists of every experiment, in one plan over rankings that were made once."""
    at = lambda df, depth: df.crossJoin(configs).where(F.col("rank") <= F.col(depth))  # noqa: E731  a dozen configurations
    keys = ("experiment_id", "rrf_k", "query_id")
    return fusion.fuse(at(bm25, "bm25_depth"), at(dense, "dense_depth"), F.col("rrf_k"), top, digits, keys, unique=True)


def candidate_recall(rankings: list[DataFrame], gold: DataFrame, depth: int) -> DataFrame:
    """query_id, recall of the union of the lists at a depth."""
    union = rankings[0].where(F.col("rank") <= depth).select("query_id", "uid")
    for r in rankings[1:]:
        union = union.union(r.where(F.col("rank") <= depth).select("query_id", "uid"))
    found = gold.join(union.distinct().withColumn("hit", F.lit(1)), ["query_id", "uid"], "left")
    return found.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def failure_classes(candidates: DataFrame, reranked: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, failure_class."""
    mark = lambda df, c: df.select("query_id", "uid").distinct().withColumn(c, F.lit(True))
    joined = gold.join(mark(candidates, "candidate"), ["query_id", "uid"], "left").join(mark(reranked.where("rank <= 10"), "top"), ["query_id", "uid"], "left")
    flags = joined.groupBy("query_id").agg(F.count("top").alias("t"), F.count("candidate").alias("c"))
    kind = F.when(F.col("t") > 0, "success").when(F.col("c") > 0, "bad_reranking").otherwise("missing_candidates")
    return flags.select("query_id", kind.alias("failure_class"))


def facets(queries: DataFrame, per_query_rows: DataFrame) -> DataFrame:
    """Macro means by facet, category and system. queries: query_id, query_type, difficulty, n_labels, n_judgments."""
    pairs = F.array(
        F.struct(F.lit("query_type").alias("facet"), F.col("query_type").alias("category")),
        F.struct(F.lit("difficulty").alias("facet"), F.col("difficulty").alias("category")),
        F.struct(F.lit("gold_paragraph_count").alias("facet"), F.col("n_labels").cast("string").alias("category")),
        F.struct(F.lit("judgment_scope").alias("facet"), F.when(F.col("n_judgments") > 1, "multi_judgment").otherwise("single_judgment").alias("category")),
    )
    each = queries.select("query_id", F.explode(pairs).alias("f")).select("query_id", "f.*")
    return evaluation.macro(per_query_rows.join(each, "query_id"), ("facet", "category", "system"))


def best_experiment(experiments: DataFrame) -> DataFrame:
    """W12. experiments: experiment_id, ndcg_at_10, recall_at_10, mrr, runtime_seconds, bm25_depth, dense_depth, candidate_k."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in experiments.columns else F.lit(0)
    effort = zero("bm25_depth") + zero("dense_depth") + zero("candidate_k")
    return experiments.orderBy(F.desc("ndcg_at_10"), F.desc("recall_at_10"), F.desc("mrr"), "runtime_seconds", effort, "experiment_id").limit(1)


def experiment_errors(experiments: DataFrame) -> DataFrame:
    """Ids that are blank or repeated, configurations that repeat."""
    config = [c for c in ("bm25_depth", "dense_depth", "rrf_k", "candidate_k") if c in experiments.columns]
    ids = experiments.groupBy("experiment_id").count().where("count > 1 or trim(coalesce(experiment_id, '')) = ''").select("experiment_id", F.lit("blank or repeated id").alias("problem"))
    same = experiments.groupBy(*config).agg(F.count("*").alias("n"), F.max("experiment_id").alias("experiment_id")).where("n > 1")
    return ids.union(same.select("experiment_id", F.lit("repeated configuration").alias("problem")))


def deltas(macro_rows: DataFrame, baseline: str) -> DataFrame:
    """Each system's means less those of the baseline."""
    base = macro_rows.where(F.col("system") == baseline).select(*[F.col(m).alias(f"b_{m}") for m in evaluation.METRICS])
    return macro_rows.crossJoin(base).select("system", *[(F.col(m) - F.col(f"b_{m}")).alias(m) for m in evaluation.METRICS])  # one row


def chunks(candidates: DataFrame, edges: tuple[int, ...] = (30, 40, 50)) -> DataFrame:
    """Which scoring chunk each candidate falls in; a chunk is scored once for all deeper settings."""
    chunk = F.lit(None).cast("int")
    for k, e in reversed(list(enumerate(edges))):
        chunk = F.when(F.col("hybrid_rank") <= e, F.lit(k)).otherwise(chunk)
    return candidates.withColumn("chunk", chunk).where("chunk is not null")


def feature_groups(queries: DataFrame, per_query_rows: DataFrame) -> DataFrame:
    """Means by what a query names. queries: query_id, query, case_names."""
    f = text.query_features(F.col("query"), F.col("case_names"))
    flags = queries.select("query_id", f.alias("f"))
    groups = F.filter(F.array(*[F.when(F.col(f"f.{c}"), F.lit(c)) for c in ("names_statute", "names_citation", "names_case")]), lambda x: x.isNotNull())
    each = flags.select("query_id", F.explode(groups).alias("feature"))
    return evaluation.macro(per_query_rows.join(each, "query_id"), ("feature", "system"))


def length_stats(docs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Length statistics of texts."""
    n = F.length("text")
    return docs.groupBy(*by).agg(
        F.count("*").alias("n"), F.min(n).alias("min_length"), F.median(n).alias("median_length"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY length(text))").cast("long").alias("p95_length"), F.max(n).alias("max_length"),
    )


def bucket_recall(docs: DataFrame, gold: DataFrame, retrieved: DataFrame) -> DataFrame:
    """How many gold texts of each length bucket were retrieved, by system."""
    sized = gold.join(docs.select("uid", text.length_bucket(F.col("text")).alias("bucket")), "uid")
    hits = retrieved.select("system", "query_id", "uid").distinct().withColumn("hit", F.lit(1))
    systems = retrieved.select("system").distinct()
    joined = sized.crossJoin(systems).join(hits, ["system", "query_id", "uid"], "left")  # a few systems
    return joined.groupBy("system", "bucket").agg(F.count("*").alias("n_gold"), F.count("hit").alias("n_retrieved"))


def examples(rows: DataFrame, by: str, order: str, n: int = 2) -> DataFrame:
    """The first n rows of each category by a metric's difference."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order), "query_id"))
    return rows.withColumn("at", at).where(F.col("at") <= n)


def ranks_of(gold: DataFrame, rankings: DataFrame) -> DataFrame:
    """The rank of each gold id in each system's list, null if absent."""
    systems = rankings.select("system").distinct()
    return gold.crossJoin(systems).join(rankings.select("system", "query_id", "uid", F.col("position").alias("rank")), ["system", "query_id", "uid"], "left")  # a few systems


def hit_summaries(rankings: DataFrame, gold: DataFrame, docs: DataFrame, limit: int = 240) -> DataFrame:
    """system, query_id, position, uid, grade (0 without a label), characters, snippet. docs: uid, text."""
    graded = rankings.join(gold, ["query_id", "uid"], "left").join(docs.select("uid", "text"), "uid")
    characters = F.length("text").alias("characters")
    return graded.select("system", "query_id", "position", "uid", F.coalesce("grade", F.lit(0)).alias("grade"), characters, text.snippet(F.col("text"), limit).alias("snippet"))


def error_sets(per_query_rows: DataFrame, bm25: str = "bm25", dense: str = "dense", hybrid: str = "hybrid", reranked: str = "reranked") -> DataFrame:
    """(error_set, query_id) of the six comparisons of systems."""
    systems = {"b": bm25, "d": dense, "h": hybrid, "r": reranked}
    value = lambda s, m: F.max(F.when(F.col("system") == systems[s], F.col(m)))
    wide = per_query_rows.groupBy("query_id").agg(
        *[value(s, m).alias(f"{s}_{k}") for s in systems for k, m in (("recall", "recall_at_10"), ("ndcg", "ndcg_at_10"))]
    )
    sets = {
        "bm25_succeeds_dense_fails": "b_recall > 0 and d_recall = 0",
        "dense_succeeds_bm25_fails": "d_recall > 0 and b_recall = 0",
        "hybrid_hurts_bm25": "h_ndcg < b_ndcg",
        "rrf_helps_bm25": "h_ndcg > b_ndcg",
        "reranker_helps_hybrid": "r_ndcg > h_ndcg",
        "reranker_hurts_hybrid": "r_ndcg < h_ndcg",
    }
    named = F.array(*[F.when(F.expr(cond), F.lit(name)) for name, cond in sets.items()])
    return wide.select(F.explode(F.filter(named, lambda x: x.isNotNull())).alias("error_set"), "query_id")
