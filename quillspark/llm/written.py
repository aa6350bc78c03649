"""Intermediate tables, written to the shared folder: they cut lineage and outlive executors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillspark.deploy import fresh_path, remove_path


class Written:
    """A DataFrame written as Parquet and read again; `drop` deletes it once nothing reads it any more."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, fresh_path(df.sparkSession, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove_path(self.spark, self.path)


def written(df: DataFrame, name: str) -> DataFrame:
    return Written(df, name).df
