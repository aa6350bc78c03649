"""Resumable ingestion as a stream (S17): new files of a folder, each batch once, with Spark's own checkpoint.

Duplicates are dropped against all stored hashes, forever; a watermark would forget them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators import ingest as batch
from quillspark.sources.lines import numbered


def ingest_folder(spark: SparkSession, folder: str, store: str, checkpoint: str, default_source: str | None = None) -> None:
    """Ingests what is new in `folder` (text files, a JSON record a line) and returns when all is done. Lines keep their path
    and number; those that aren't UTF-8 fail alone."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def run(df: DataFrame, batch_id: int) -> None:
        batch.ingest(spark, numbered(df.select("path", "content")), store, default_source).unpersist()

    query = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
