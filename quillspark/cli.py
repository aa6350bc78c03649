"""Command line: ingest a folder, search and audit a store, run a query of the catalogue."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillspark")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("ingest", help="ingest a folder of JSON lines; resumes where it stopped")
    p.add_argument("folder")
    p.add_argument("store")
    p.add_argument("--default-source")
    p = sub.add_parser("search", help="search the paragraphs of a store")
    p.add_argument("store")
    p.add_argument("query")
    p.add_argument("--mode", choices=("bm25", "dense", "hybrid", "reranked"), default="bm25")
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--court")
    p.add_argument("--year", type=int)
    p.add_argument("--case-number")
    p = sub.add_parser("audit", help="counts of a store; with an index its coverage, and exit code 1 on defects")
    p.add_argument("store")
    p.add_argument("--points")
    p = sub.add_parser("index", help="write the vectors and the lexical index of a store")
    p.add_argument("store")
    p.add_argument("target")
    p = sub.add_parser("manifest", help="what each row of a manifest breaks")
    p.add_argument("manifest")
    p = sub.add_parser("artifacts", help="check written evaluation artifacts; exit code 1 on errors")
    p.add_argument("folder")
    p = sub.add_parser("resume", help="the last line done of an input; refuses one that has changed")
    p.add_argument("progress")
    p.add_argument("input")
    p.add_argument("store")
    p = sub.add_parser("query", help="run a query of the catalogue")
    p.add_argument("name")
    p.add_argument("folder")
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from quillspark.operators import acquisition, bm25, dense, filters, ingest
    from quillspark.plans import audit, catalogue, engine, evaluation
    from quillspark.sources import lines
    from quillspark.streaming import ingest as stream

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "ingest":
        stream.ingest_folder(spark, args.folder, args.store, f"{args.store}/_progress", args.default_source)
    elif args.command == "query":
        catalogue.queries()[args.name](spark, args.folder).show(50, truncate=80)
    elif args.command == "manifest":
        rows = acquisition.read_manifest(spark, args.manifest)
        rows.select("title", acquisition.source_error().alias("error")).where("error is not null").show(50, truncate=80)
    elif args.command == "artifacts":
        wrong = evaluation.artifact_errors(*evaluation.read_artifacts(spark, args.folder))
        wrong.show(truncate=False)
        sys.exit(int(wrong.limit(1).count() > 0))
    elif args.command == "resume":
        found = lines.file_hashes(spark, args.input).first()
        print(ingest.check_resume(spark.read.parquet(args.progress), found["path"], found["sha256"], args.store))
    else:
        cases, paragraphs = ingest.read_store(spark, args.store)
        if args.command == "audit":
            named = cases.withColumnRenamed("document_hash", "case_id")
            audit.corpus_audit(named, paragraphs.withColumnRenamed("document_hash", "case_id")).show(vertical=True)
            if args.points:
                coverage = audit.vector_coverage(paragraphs.select(F.col("paragraph_uid").alias("uid")), spark.read.parquet(args.points))
                coverage.show(vertical=True)
                sys.exit(int(audit.defects(coverage) > 0))
        elif args.command == "index":
            docs = paragraphs.select(F.col("paragraph_uid").alias("uid"), "text")
            dense.embed(docs, dense.HashingEmbedder()).write.mode("overwrite").parquet(f"{args.target}/points")
            bm25.build(docs).write(f"{args.target}/bm25")
        else:
            filters.check_request(args.query, args.top_k)
            facts = cases.select("document_hash", "title", "court", "case_number", "judgment_date")
            docs = paragraphs.join(facts, "document_hash").withColumnRenamed("paragraph_uid", "uid")
            embedder = dense.HashingEmbedder()
            e = engine.Engine(docs, dense.embed(docs, embedder), embedder)
            queries = spark.createDataFrame([("q", args.query)], "query_id string, query string")
            chosen = filters.Filters(args.court, args.year, args.case_number)
            found = e.search(queries, args.mode, args.top_k, chosen).join(docs.select("uid", "title", "paragraph_number", F.left("text", F.lit(120)).alias("text")), "uid")
            found.orderBy("final_rank").show(args.top_k, truncate=120)


if __name__ == "__main__":
    main()
