"""Tables written once to the shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the session names none (tests, one machine) is a temporary
    folder made and recorded in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = tempfile.mkdtemp(prefix="lodestone-llm-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_folder(spark)}/llm/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, a lost executor costs a task."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` made, once nothing reads it any more."""
    spark = df.sparkSession
    root = work_folder(spark)
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if "/llm/" in f and root.split(":")[-1].strip("/") in f:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
