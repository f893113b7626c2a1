"""Typed readers for the star-schema and content tables.

Schemas are declared, so planning never opens a file to infer one and only
the columns a query names are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import pin_utc

TABLE_DDL = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# text tables, whose rows cost far more to process than to read
_TEXT_KEYS = {"documents": ("doc_id",), "pages": ("page_id",), "conversations": ("conv_id", "turn")}

_NTZ = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}


class Tables:
    """Attribute access to the tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str, text_splits: int | None = None):
        """``text_splits`` spreads the text tables over so many partitions, for tables that lie in one small file.

        Without it the session's setting ``spark.lodestone.textSplits`` holds;
        where that is unset too, as on a cluster, nothing is shuffled.
        """
        self.spark = pin_utc(spark)
        self.folder = folder.rstrip("/")
        self.text_splits = text_splits or int(self.spark.conf.get("spark.lodestone.textSplits", "0"))

    def read(self, name: str) -> DataFrame:
        df = (self.spark.read.schema(TABLE_DDL[name])
              .parquet(f"{self.folder}/{name}.parquet"))
        if name in _NTZ:
            c = _NTZ[name]
            df = df.withColumn(c, F.col(c).cast("timestamp"))
        return df.repartition(self.text_splits, *_TEXT_KEYS[name]) if self.text_splits and name in _TEXT_KEYS else df

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_DDL:
            return self.read(name)
        raise AttributeError(name)
