"""Tables laid out for lookups by partition key and row key, and for ranges of row keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import starts_with


@dataclass(frozen=True)
class Keyed:
    """A table of ``path`` in ``buckets`` folders by the hash of its partition key, each file sorted by partition key and row key.

    A lookup names its bucket as a constant, so only that folder is read, and of its files only the row groups and pages whose range holds the
    key. A partition key with very many rows lies in several files, each a range of its row keys.
    """

    path: str
    partition_key: str
    row_key: str
    buckets: int = 256

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, mode: str = "errorifexists", **options) -> None:
        """Write ``rows``; with mode ``append`` further files beside those that are there."""
        if "bucket" in (c.lower() for c in rows.columns):
            raise ValueError("bucket is a name of the layout")
        placed = rows.withColumn("bucket", self._bucket(F.col(self.partition_key)))
        order = ["bucket", self.partition_key, self.row_key]
        placed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).options(**options).partitionBy("bucket").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def _of(self, spark: SparkSession, partition) -> DataFrame:
        key = F.lit(partition)
        return self.read(spark).where((F.col("bucket") == self._bucket(key)) & (F.col(self.partition_key) == key)).drop("bucket")

    def point(self, spark: SparkSession, partition, row) -> DataFrame:
        """The row of this key, or none."""
        return self._of(spark, partition).where(F.col(self.row_key) == F.lit(row)).limit(1)

    def prefix(self, spark: SparkSession, partition, prefix: str) -> DataFrame:
        """The rows of a partition key whose row keys, texts, start with ``prefix``."""
        return self._of(spark, partition).where(starts_with(F.col(self.row_key), prefix))

    def lookup(self, requests: DataFrame) -> DataFrame:
        """The rows of many keys: ``requests`` has both key columns. A request names its bucket, so folders that none asks for are not read."""
        asked = requests.select(self.partition_key, self.row_key).distinct().withColumn("bucket", self._bucket(F.col(self.partition_key)))
        return self.read(requests.sparkSession).join(asked, ["bucket", self.partition_key, self.row_key], "left_semi").drop("bucket")
