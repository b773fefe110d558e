"""Event-time windows over streams, and how a bounded stream is drained into a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from groundwork.runtime import shared_folder


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet files of a table as a stream, whether it is one file or a folder of parts."""
    path = f"{folder}/{name}.parquet"
    schema: StructType = spark.read.parquet(path).schema
    parts = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = parts.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(parts).isDirectory()
    stream = spark.readStream.schema(schema)
    return stream.parquet(path) if is_folder else stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that is available now, through the stream's own plan, as a table in the shared folder.

    The sink is a Parquet folder with its commit log, so a batch that is run again isn't written twice.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def hourly(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Count and sum by hour and type; rows later than delay behind the newest are dropped, a window is given once it's over."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    by = timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def sliding(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("most")).select(F.col("w.start").alias("start"), "n", "most")


def visits(events: DataFrame, gap: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    """Session windows per user."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    by = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return by.select("user_id", F.col("w.start").alias("started_at"), "n")
