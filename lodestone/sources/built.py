"""Tables derived from the tables of a folder, written once and read by every later query.

An index or a vocabulary costs a pass over whole texts; a query over it does
not. The first caller builds such a table, hash-bucketed by the column that
queries join it on, so that a join moves the query's rows and never the
table's. Its name holds a fingerprint of the source files (path, length, time
of change): changed sources make a new table, and nobody reads a stale one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.session import shared_dir
from lodestone.sources.tables import Tables


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Changes when a file below one of the paths is added, removed, resized or written anew."""
    seen = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.md5(repr(sorted(seen)).encode()).hexdigest()[:16]


def built(t: Tables, name: str, sources: tuple[str, ...], make: Callable[[], DataFrame], by: str | tuple[str, ...], order: tuple[str, ...] = ()) -> DataFrame:
    """The table ``name`` over the named source tables of ``t``; ``make`` gives its rows where it does not exist yet.

    It is bucketed by ``by`` into as many files as there are shuffle partitions
    when it is made, each sorted by ``by`` and ``order``, and lies in the shared
    folder as a table of the session's catalog. It lives as long as the catalog.
    A join on exactly the columns ``by`` leaves the table where it lies; with
    one column more Spark shuffles it.
    """
    by = (by,) if isinstance(by, str) else by
    spark = t.spark
    table = f"lodestone_{name}_{fingerprint(spark, *(f'{t.folder}/{s}.parquet' for s in sources))}"
    if not spark.catalog.tableExists(table):
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        (make().repartition(n, *by).write.bucketBy(n, *by).sortBy(*by, *order).mode("overwrite")
         .option("path", f"{shared_dir(spark)}/built/{table}").saveAsTable(table))
    return spark.table(table)
