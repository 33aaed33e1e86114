"""Read-only table sources: Parquet data sets and JDBC tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fs

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events", "documents", "embeddings", "pages",
                 "benchmark", "labels", "conversations")


class Source:
    """A set of read-only tables under one folder (``<dir>/<name>.parquet``).

    Reads are lazy; Catalyst prunes columns and pushes filters into each
    Parquet scan, so a table is never read whole unless the plan needs it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return fs.join(self.root, f"{name}.parquet")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    __getitem__ = table

    def names(self) -> list[str]:
        """Tables present, ordered by name."""
        return [e[: -len(".parquet")] for e in fs.list_names(self.spark, self.root) if e.endswith(".parquet")]

    def register(self, names=None) -> None:
        for n in names or self.names():
            self.table(n).createOrReplaceTempView(n)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None,
              lower: int | None = None, upper: int | None = None,
              partitions: int = 10, properties: dict | None = None) -> DataFrame:
    """Partitioned JDBC read: ``partitions`` range queries on ``key`` run in
    parallel (and bound the number of open connections).  Filters and
    column selections on the result are pushed into each range query."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if key is not None:
        reader = (reader.option("partitionColumn", key)
                        .option("lowerBound", str(lower))
                        .option("upperBound", str(upper))
                        .option("numPartitions", str(partitions)))
    return reader.load()
