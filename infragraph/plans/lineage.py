"""Lineage cuts that outlive a lost executor.

Every cut goes through the reliable checkpoint folder of the session (``spark.checkpoint.dir``). A folder
of our own is chosen only when the session names none and runs on one machine, as in tests; on a cluster
that is an error. What is written below the folder goes when the session's JVM ends, or with ``discard``.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="infragraph-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/infragraph-{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str, act: Callable[..., object]) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    act(at.getFileSystem(spark._jsc.hadoopConfiguration()), at)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this name, in whatever store."""
    found = []
    _hadoop(spark, path, lambda fs, at: found.append(fs.exists(at)))
    return found[0]


def _scratch(df: DataFrame, path: str) -> DataFrame:
    _hadoop(df.sparkSession, path, lambda fs, at: fs.deleteOnExit(at))
    df.scratch_path = path
    return df


def discard(*frames: DataFrame) -> None:
    """Removes what ``stored`` or ``bucketed`` wrote for these frames; nothing may read them any more."""
    for df in frames:
        _hadoop(df.sparkSession, df.scratch_path, lambda fs, at: fs.delete(at, True))


def release(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files, broadcasts and checkpoints of jobs that are over.

    Its cleaner acts when the driver collects garbage, which may be long after the disks are full; ``stored`` and
    ``bucketed`` end with this, loops call it once a round.
    """
    gc.collect()
    spark._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage replaced by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(df: DataFrame, name: str = "rows") -> DataFrame:
    """``cut`` for large results: compressed columns instead of rows as they lie in memory, and ``discard`` removes them."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return _scratch(spark.read.schema(df.schema).parquet(path), path)


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet below the shared folder, and read back with the same schema."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    release(spark)
    return _scratch(spark.read.schema(df.schema).parquet(path), path)


def bucketed(df: DataFrame, key: str | list[str], name: str) -> DataFrame:
    """``df`` written once as a table in buckets of ``key``; joins and groups on the key read it without a shuffle.

    There are as many buckets as shuffle partitions, so a plan that ends with a shuffle on the key writes one
    file each. The table lies below the shared folder; only its catalog entry is dropped again.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").option("path", path).bucketBy(n, *([key] if isinstance(key, str) else key)).saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved before the entry goes
    spark.sql(f"DROP TABLE {table}")
    release(spark)
    return _scratch(out, path)
