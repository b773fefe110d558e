"""Search connectors as a Python data source, with failover between providers.

There is no network here: a provider is a table of results in Parquet (query, rank, title, url, snippet, published_at), as a
crawl or a cache leaves it, and a real connector is another reader behind the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "query string, rank int, title string, url string, snippet string, published_at string"


class SearchReader(DataSourceReader):
    def __init__(self, path: str, provider: str) -> None:
        self.path, self.provider = path, provider

    def partitions(self) -> list[InputPartition]:
        import pyarrow.dataset as ds

        return [InputPartition(f) for f in ds.dataset(self.path, format="parquet").files] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        import pyarrow.parquet as pq

        for batch in pq.ParquetFile(partition.value).iter_batches():
            yield from zip(*[batch.column(c.split()[0]).to_pylist() for c in SCHEMA.split(", ")], strict=True)


class SearchSource(DataSource):
    """spark.read.format("search_results").option("path", ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "search_results"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return SearchReader(self.options["path"], self.options.get("provider", "table"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SearchSource)


def failover(providers: list[tuple[str, DataFrame]]) -> DataFrame:
    """For each query the results of the first provider that has any, with its name."""
    tagged = [df.withColumn("provider", F.lit(name)).withColumn("_order", F.lit(i)) for i, (name, df) in enumerate(providers)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    first = F.min("_order").over(Window.partitionBy("query"))
    return every.withColumn("_first", first).where("_order = _first").drop("_order", "_first")
