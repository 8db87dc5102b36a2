"""Shared-folder tables and files.

Everything that has to outlive a stage goes to the folder named by
``spark.checkpoint.dir``; it is the only place that driver and all executors see.
"""

from __future__ import annotations

import gc
import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset (local tests)."""
    base = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{KEY} must name a shared folder on a cluster")
        base = f"file://{tempfile.mkdtemp(prefix='loomtext-')}"
        spark.conf.set(KEY, base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/loomtext/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that survive lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.coalesce(partition_files) if partition_files else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomtext_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_loomtext_path", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def open_fs(path: str):
    """(file system, path) for a URI or a plain path, usable on executors."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:") and not path.startswith("file://"):
        return fs.LocalFileSystem(), path[5:]
    return fs.FileSystem.from_uri(path)


def worker_cache(name: str, make):
    """One object per Python worker; functions are shipped by value, so module globals don't outlive a task."""
    home = sys.modules.setdefault("_loomtext_worker", types.ModuleType("_loomtext_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def tune(spark: SparkSession, rows: int = 256) -> None:
    """Small Arrow batches: a Python worker then holds few texts at a time, long ones included."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are done; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
