"""A Parquet table in partitions that changes touch one by one.

An upsert, a deletion or a retention run rewrites or drops the partitions that
hold changed rows and leaves the files of all others as they are. Which ones
these are is read from two narrow columns; Spark's dynamic partition overwrite
replaces them when all their tasks are done, so a lost executor or an ended run
leaves the old files. A run that was ended between two partitions is repeated as
a whole and gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.ingest import delete_by_id, upsert
from lodestone.session import materialize


class PartitionedTable:
    """Rows under ``path`` in partitions by the column ``by``: a day, or ``bucket_of`` a key.

    The names of touched partitions come to the driver, at most as many as the
    table has.
    """

    def __init__(self, spark: SparkSession, path: str, by: str, schema: str | None = None):
        self.spark, self.path, self.by, self.schema = spark, path, by, schema

    @classmethod
    def create(cls, df: DataFrame, path: str, by: str) -> PartitionedTable:
        """A new table of the rows of ``df``; a partition's rows come to one file where adaptive execution finds them small."""
        df.repartition(by).write.partitionBy(by).parquet(path)
        return cls(df.sparkSession, path, by, df.schema)

    def read(self) -> DataFrame:
        r = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        return r.parquet(self.path)

    def _in(self, parts: list) -> Column:
        named = [p for p in parts if p is not None]
        c = F.col(self.by).isin(named) if named else F.lit(False)
        return c | F.col(self.by).isNull() if len(named) < len(parts) else c

    def _parts(self, df: DataFrame) -> list:
        return [r[0] for r in df.select(self.by).distinct().collect()]

    def _replace(self, rows: DataFrame, touched: list) -> None:
        """New rows for the touched partitions; those left without a row are removed."""
        rows = materialize(rows, "partitions")  # the partitions it is read from are about to go
        rows.repartition(self.by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.by).parquet(self.path)
        left = set(self._parts(rows))  # a partition without a new row still has its old files
        self._drop([p for p in touched if p not in left])

    def _drop(self, parts: list) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        for p in parts:
            text = None if p is None else str(p)
            at = path(self.path, escaped(self.by, text))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def holding(self, keys: DataFrame, key: str) -> list:
        """Partitions that hold one of the keys; reads the key and nothing else of the rows."""
        return self._parts(self.read().select(self.by, key).join(keys.select(key).distinct(), key, "left_semi"))

    def upsert(self, updates: DataFrame, key: str, order: str) -> list:
        """Last write wins, also where it moves a row to another partition; returns the touched partitions."""
        touched = list(dict.fromkeys(self.holding(updates, key) + self._parts(updates)))
        if touched:
            base = self.read().where(self._in(touched))
            self._replace(upsert(base, updates.select(*base.columns), key, order).select(*base.columns), touched)
        return touched

    def delete(self, ids: DataFrame, key: str) -> list:
        """Rows of the given ids are gone; returns the touched partitions."""
        touched = self.holding(ids, key)
        if touched:
            self._replace(delete_by_id(self.read().where(self._in(touched)), ids, key), touched)
        return touched

    def retain(self, least) -> list:
        """Drops the partitions before ``least``, of which no column is read; returns them. A null partition stays."""
        gone = self._parts(self.read().select(self.by).where(F.col(self.by) < F.lit(least)))
        self._drop(gone)
        return gone


def bucket_of(key: str, buckets: int) -> Column:
    """A partition for tables that have no day: ids spread evenly."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
