"""Session set-up and the few run-time helpers that touch the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  memory: str = "12g", app: str = "lodestone") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.lodestone.textSplits", str(shuffle_partitions))
         .config("spark.driver.memory", memory)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.streaming.metricsEnabled", "false"))
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin_utc(spark: SparkSession) -> SparkSession:
    """All day and hour arithmetic is defined in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent (tests, single machine) is a temporary
    folder made and recorded in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a derived table once to the shared folder and read it back.

    For tables that several branches of a job use: the plan starts anew there
    (deep jobs would otherwise be planned again from the first table for every
    branch), the file sizes tell the optimiser what it may broadcast, and a
    lost executor costs a task.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of files up to which a table that many rows look things up in is sent to every task.
LOOKED_UP = 48 << 20


def looked_up(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once; a join sends it to every task if it is small, so that the many rows on the other side stay where they lie."""
    kept = materialize(df, label)
    size = int(str(kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(kept) if size <= LOOKED_UP else kept
