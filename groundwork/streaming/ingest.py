"""Documents that arrive as files: parsed, chunked, written, read back, and only then called indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions.text import tokens
from groundwork.plans.chunks import chunked


def ingest(stream: DataFrame, key: str, text: str, target: str, checkpoint: str):  # noqa: ANN201
    """Start a query that takes each batch of documents to target/chunks and target/status.

    A document is indexed once a probe, its first eight tokens, is found among the chunks that were written; one without
    chunks is empty, one whose probe fails is failed. Batches are written by number, so one that is run again replaces itself.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        chunks, status = f"{target}/chunks/batch={number}", f"{target}/status/batch={number}"
        df = df.dropDuplicates([key])
        chunked(df, key, text).write.mode("overwrite").parquet(chunks)
        written = spark.read.parquet(chunks).groupBy(key).agg(F.count("*").alias("chunks"), F.array_distinct(F.flatten(F.collect_set(F.expr(tokens("text"))))).alias("held"))
        probe = df.select(key, F.expr(f"slice({tokens(text)}, 1, 8)").alias("probe")).join(written, key, "left")
        state = F.when(F.col("chunks").isNull(), "empty").when(F.size(F.array_except("probe", "held")) == 0, "indexed").otherwise("failed")
        probe.select(key, F.coalesce("chunks", F.lit(0)).alias("chunks"), state.alias("status")).write.mode("overwrite").parquet(status)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
