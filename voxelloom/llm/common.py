"""Scratch tables in the cluster's shared folder, and a cache that outlives tasks."""

from __future__ import annotations

import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on a local master a temporary one if it is unset."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="voxelloom-"))
        where = sc.getCheckpointDir()
    return where


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts the
    lineage with files that survive a lost executor."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/voxelloom-{uuid.uuid4().hex}/{tag}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._voxelloom_path = path
    if scratch.open:
        scratch.open[-1].tables.append(out)
    return out


class scratch:
    """A context that deletes the tables which materialize() makes in it, when it ends,
    but for those kept; they are left to the context around it. Contexts nest, and a
    table belongs to the innermost one."""

    open: list[scratch] = []

    def __enter__(self) -> scratch:
        self.tables: list[DataFrame] = []
        self.kept: list[DataFrame] = []
        scratch.open.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df)
        return df

    def __exit__(self, *_) -> None:
        scratch.open.remove(self)
        for df in self.tables:
            if not any(df is x for x in self.kept):
                discard(df)
            elif scratch.open:
                scratch.open[-1].tables.append(df)


def discard(df: DataFrame) -> None:
    """Deletes a table of materialize() that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._voxelloom_path).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(build: Callable[[], DataFrame], tag: str) -> DataFrame:
    """The rows of build(), written; every other table that it writes is deleted."""
    with scratch() as own:
        return own.keep(materialize(build(), tag))


def release(spark: SparkSession) -> None:
    """Collects the driver's garbage: executors delete shuffle files and broadcast
    blocks when the driver no longer holds the plans they belong to."""
    gc.collect()
    spark._jvm.System.gc()


def worker_cache() -> dict:
    """A dictionary of this Python process, shared by the tasks it runs."""
    name = "_voxelloom_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].kept = {}
    return sys.modules[name].kept
