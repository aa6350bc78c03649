"""Shipping the package to executors, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Arrow functions can be imported there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(root):  # already runs from an archive
        return
    name = os.path.basename(root)
    folder = tempfile.mkdtemp(prefix="ship-")  # the driver serves it to the executors until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, f"{name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(target)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where that is unset, in a local run, a temporary one is set. On a cluster a
    local folder would be another one on each machine, so that is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not base:
        base = sc._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quillspark-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path written under `fresh_path`, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Tables of less aren't worth dealing out.
SPREAD_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out where a table has fewer partitions than there are cores, as one file with one row group has. Tables of
    many files are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size >= SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
