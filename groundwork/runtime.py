"""What several operators need from the cluster: durable intermediates and joins whose small side is measured."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows times columns is no size; a side is broadcast only if its measured bytes are below this.
BROADCAST_BYTES = 64 << 20

_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_ROOTS: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a local session without one gets a temporary folder, which
    goes with the process."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    return known or _temporary_folder(sc.master)


@functools.cache
def _temporary_folder(master: str) -> str:
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="groundwork-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept as compressed Parquet in the shared folder, so that a lost executor costs no more than a
    read, and a later step reads only the columns it needs. release() removes it; what is left goes when the process ends."""
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/groundwork-{spark.sparkContext.applicationId}"
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_remove, spark, root)
    kept = spark.read.schema(df.schema).parquet(path)
    _PATHS[kept] = path
    return kept


def release(*kept: DataFrame) -> None:
    """Removes tables of durable() that no later step reads."""
    for df in kept:
        if path := _PATHS.pop(df, None):
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session is over
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A scan's rows over as many tasks as there are cores, by hash of keys, if its files make fewer; else df. For work that costs
    much per row: at scale a scan has more tasks than cores, and nothing is moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def bounded_batches(spark: SparkSession, limit: int = 16 << 20) -> None:
    """Let no Arrow batch that goes to Python be larger than limit bytes, however long its rows are (one row at least)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name, None)
    if held is None or not 0 < int(held.rstrip("b")) <= limit:
        spark.conf.set(name, str(limit))


def measured_bytes(df: DataFrame, *columns: str) -> int:
    """Rows of df and the length of its given string or array columns as one number of bytes, by one aggregation."""
    width = 16 * max(1, len(df.columns))
    parts = [F.coalesce(F.sum(F.length(F.col(c).cast("string"))), F.lit(0)) for c in columns]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[p.alias(f"c{i}") for i, p in enumerate(parts)]).first()
    return int(row["n"]) * width + sum(int(row[f"c{i}"]) for i in range(len(parts)))


def broadcast_if_small(df: DataFrame, *columns: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it measures less than limit bytes; else df, to be joined by a shuffle."""
    return F.broadcast(df) if measured_bytes(df, *columns) < limit else df
