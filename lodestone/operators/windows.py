"""Window patterns that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition by ``cols`` before a step that turns few bytes into much work.

    Adaptive coalescing sees only the small input and would leave such a step
    to a handful of tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int | None, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of each key, all of them where ``k`` is None.

    ``row_number() <= k`` lets Spark keep only k rows per key and task before
    the shuffle, so a hot key costs k rows per map task, not its full size.
    Spark does so up to ``spark.sql.window.group.limit.threshold`` (1000); with
    a larger k, or none, the window sorts the whole key on disk.
    """
    if k is None and not rank:
        return df
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    out = out if k is None else out.where(F.col(name) <= k)
    return out if rank else out.drop(name)


def carry_forward(df: DataFrame, keys: list[str], ts: str, tie: str, cols: list[str],
                  chunk: str = "hour", prefix: str = "seen_") -> DataFrame:
    """Latest non-null value of ``cols`` up to each row, per key in time order.

    Two levels: inside (key, hour) by a window, across hours by a window over
    one row per (key, hour). No task ever holds a whole hot key.
    """
    d = df.withColumn("_chunk", F.date_trunc(chunk, F.col(ts)))
    inner = W.partitionBy(*keys, "_chunk").orderBy(ts, tie).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumns({"_in_" + x: F.last(x, ignorenulls=True).over(inner) for x in cols})
    ends = (d.groupBy(*keys, "_chunk")
            .agg(*[F.max_by(x, F.when(F.col(x).isNotNull(), F.struct(ts, tie))).alias(x) for x in cols]))
    outer = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    prev = ends.select(*keys, "_chunk", *[F.last(x, ignorenulls=True).over(outer).alias("_pr_" + x) for x in cols])
    d = d.join(prev, [*keys, "_chunk"], "left")
    return d.withColumns({prefix + x: F.coalesce("_in_" + x, "_pr_" + x) for x in cols}) \
        .drop("_chunk", *["_in_" + x for x in cols], *["_pr_" + x for x in cols])


def chunked_lag(df: DataFrame, keys: list[str], ts: str, tie: str, col: str, out: str,
                chunk: str = "hour") -> DataFrame:
    """Value of ``col`` on the previous row of the key, in the same two levels."""
    d = df.withColumn("_chunk", F.date_trunc(chunk, F.col(ts)))
    d = d.withColumn("_in", F.lag(col).over(W.partitionBy(*keys, "_chunk").orderBy(ts, tie)))
    ends = d.groupBy(*keys, "_chunk").agg(F.max_by(col, F.struct(ts, tie)).alias("_end"))
    prev = ends.select(*keys, "_chunk", F.lag("_end").over(W.partitionBy(*keys).orderBy("_chunk")).alias("_pr"))
    d = d.join(prev, [*keys, "_chunk"], "left")
    return d.withColumn(out, F.coalesce("_in", "_pr")).drop("_chunk", "_in", "_pr")


#: Seconds of a key that may lie in one row of ``once_per_ttl``, 48 days.
SPAN = 1 << 22


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(keys, _span, _gaps): the distinct seconds of a key that a batch holds, in order, as gaps from the begin of their span."""
    for b in batches:
        keys, sec = b.schema.names[:-1], np.asarray(b.column(b.num_columns - 1)).astype(np.int64)
        t = pa.Table.from_batches([b.select(keys)]).append_column("_span", pa.array(sec // SPAN)).append_column("_sec", pa.array((sec % SPAN).astype(np.int32)))
        t = t.group_by([*keys, "_span"]).aggregate([("_sec", "distinct")]).combine_chunks()
        if not t.num_rows:
            continue
        lists = t.column("_sec_distinct").chunk(0)
        sec, size = np.asarray(lists.flatten()).astype(np.int32), np.asarray(lists.value_lengths()).astype(np.int64)
        sec = sec[np.lexsort((sec, np.repeat(np.arange(len(size)), size)))]
        start = np.cumsum(size) - size
        gaps = np.diff(sec, prepend=np.int32(0))
        gaps[start] = sec[start]
        held = pa.ListArray.from_arrays(pa.array(np.r_[start, len(sec)].astype(np.int32)), pa.array(gaps))
        yield pa.RecordBatch.from_arrays([*(t.column(k).chunk(0) for k in [*keys, "_span"]), held], names=[*keys, "_span", "_gaps"])


def once_per_ttl(df: DataFrame, keys: list[str], ts: str, ttl: int) -> DataFrame:
    """(keys, accepted): the events a key lets through when each accepted
    event blocks the key for ``ttl`` seconds.

    Works on whole seconds. What a batch of rows holds of a key moves as one
    row, its seconds as gaps; then each task walks its keys in time order and
    keeps nothing but the second accepted last and the seconds of one span, so
    a busy key is never held as a whole.
    """
    secs = df.where(F.col(ts).isNotNull()).select(*keys, F.unix_timestamp(ts).alias("accepted"))
    ddl = lambda d: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*keys).schema)
    rows = secs.mapInArrow(_packed, f"{ddl(secs)}, _span bigint, _gaps array<int>")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "_span")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, at, out, kinds = None, [], None, [], None

        def walked() -> Iterator[list]:
            nonlocal last
            sec = np.unique(np.concatenate(held)) + at[-1] * SPAN
            n = 0 if last is None else int(np.searchsorted(sec, last + ttl))
            while n < len(sec):
                last = int(sec[n])
                yield [*at[:-1], last]
                n = max(n + 1, int(np.searchsorted(sec, last + ttl)))

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[*keys, "accepted"])
            out.clear()
            return made

        for b in batches:
            kinds = [*b.schema.types[:len(keys)], pa.int64()]
            gaps, size = b.column(len(keys) + 1), np.asarray(b.column(len(keys) + 1).value_lengths())
            flat, ends = np.asarray(gaps.flatten()).astype(np.int64), np.cumsum(size)
            for n, own in enumerate(zip(*(c.to_pylist() for c in b.columns[:-1]))):
                if own != at:
                    if held:
                        out.extend(walked())
                        held.clear()
                    if at is None or own[:-1] != at[:-1]:
                        last = None
                    at = own
                held.append(np.cumsum(flat[ends[n] - size[n]:ends[n]]))
            if len(out) >= 10000:
                yield batch()
        if held:
            out.extend(walked())
        if out:
            yield batch()

    return rows.mapInArrow(run, f"{ddl(secs)}, accepted bigint")
