"""Event streams: counters, sessions, once-per-session dedupe and rate windows.

Event time is ``ts``. Each transformation takes a streaming DataFrame and
returns one; ``run_to_table`` drains what is available and ``replay_*`` does so
over the event files of a data folder. A stream and the batch job over the
same rows give the same result.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.session import shared_dir
from lodestone.sources.tables import TABLE_DDL, Tables

COUNTER_WATERMARK = "1 hour"
DEDUPE_WATERMARK = "24 hours"
#: Events of one key that are sorted in memory at once; more are merged from runs on local disk.
RUN_ROWS = 1 << 18


def event_stream(spark: SparkSession, folder: str, ddl: str = TABLE_DDL["events"], files_per_trigger: int | None = None,
                 glob: str | None = None) -> DataFrame:
    """Events arriving as Parquet files in a folder."""
    r = spark.readStream.schema(ddl)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    s = r.parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("event_date", F.to_date("ts"))


def write_event_log(stream: DataFrame, path: str, checkpoint: str):
    """Lands the stream in a date-partitioned log."""
    return (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .partitionBy("event_date").trigger(availableNow=True).start())


def stream_counters(stream: DataFrame, dims: dict[str, Column], watermark: str = COUNTER_WATERMARK) -> DataFrame:
    """Counts per day and value of each dimension; rows without a value are not counted."""
    e = F.array(*[F.struct(F.lit(k).alias("dim"), v.cast("string").alias("value")) for k, v in dims.items()])
    return (stream.withWatermark("ts", watermark).select("ts", F.explode(e).alias("e")).where(F.col("e.value").isNotNull())
            .groupBy(F.window("ts", "1 day").alias("w"), F.col("e.dim").alias("dim"), F.col("e.value").alias("value"))
            .agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "dim", "value", "n"))


def _sorted(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["id"], rows["ms"]))]


def _merged(runs: list[np.ndarray], rows: int) -> Iterator[np.ndarray]:
    """Sorted runs as sorted stretches, with about ``rows`` rows of all runs in memory."""
    at, block = [0] * len(runs), max(1, rows // len(runs))
    while live := [k for k, r in enumerate(runs) if at[k] < len(r)]:
        ends = [r[min(at[k] + block, len(r)) - 1] for k, r in ((k, runs[k]) for k in live)]
        ms, last = min((int(e["ms"]), int(e["id"])) for e in ends)
        parts = []
        for k in live:
            part = np.array(runs[k][at[k]:at[k] + block])
            part = part[(part["ms"] < ms) | ((part["ms"] == ms) & (part["id"] <= last))]
            at[k] += len(part)
            parts.append(part)
        yield _sorted(np.concatenate(parts))


def _in_order(frames: Iterator[pd.DataFrame], rows: int | None = None) -> Iterator[np.ndarray]:
    """The events of one key in one micro-batch in time order, as stretches of ms, id and kind.

    Beyond ``rows`` events (``RUN_ROWS``) sorted runs go to local disk and are
    merged in blocks, so a key of any size needs the memory of one run.
    """
    rows, held, n, runs, folder = rows or RUN_ROWS, [], 0, [], None
    with contextlib.ExitStack() as made:  # most keys need no folder
        for d in frames:
            part = np.empty(len(d), dtype=[("ms", "i8"), ("id", "i8"), ("kind", "i1")])
            part["ms"] = d.ts.astype("datetime64[ms]").astype("int64")
            part["id"] = d.event_id.astype("Int64").fillna(np.iinfo(np.int64).max)
            part["kind"] = d.kind if "kind" in d else 0
            held, n = [*held, part], n + len(part)
            if n >= rows:
                folder = folder or made.enter_context(tempfile.TemporaryDirectory(prefix="lodestone-run-"))
                np.save(f"{folder}/{len(runs)}.npy", _sorted(np.concatenate(held)))
                runs.append(np.load(f"{folder}/{len(runs)}.npy", mmap_mode="r"))
                held, n = [], 0
        if n:
            runs.append(_sorted(np.concatenate(held)))
        del held
        if len(runs) == 1 and not folder:
            yield runs[0]
            return
        if runs:
            yield from _merged(runs, rows)


def stream_sessions(stream: DataFrame, who: str, gap_seconds: int, end_event: str | None = None, watermark: str = COUNTER_WATERMARK) -> DataFrame:
    """Closed sessions (who, started, last_active, n, clicks, ended), each emitted once.

    A session closes with ``end_event``, with the first event after a silence
    of ``gap_seconds``, or when the watermark has passed its end. State per key
    is the one open session.
    """
    gap = gap_seconds * 1000
    kind = stream.schema[who].dataType.simpleString()

    def run(key, frames, state: GroupState):
        out = []
        if state.hasTimedOut:
            out.append((*state.get, False))
            state.remove()
        else:
            s, late = state.get if state.exists else None, state.getCurrentWatermarkMs()
            for rows in _in_order(frames):
                for ms, event in zip(rows["ms"].tolist(), rows["kind"].tolist()):
                    if ms < late:  # behind the watermark: its session is closed
                        continue
                    if s and ms - s[1] >= gap:
                        out.append((*s, False))
                        s = None
                    click = event & 1
                    s = (s[0], max(s[1], ms), s[2] + 1, s[3] + click) if s else (ms, ms, 1, click)
                    if event & 2:
                        out.append((*s, True))
                        s = None
            if s and s[1] + gap <= late:
                out.append((*s, False))
                s = None
            if s:
                state.update(tuple(int(x) for x in s))
                state.setTimeoutTimestamp(int(s[1] + gap))
            elif state.exists:
                state.remove()
        yield pd.DataFrame([(key[0], *r) for r in out], columns=[who, "started_ms", "last_ms", "n", "clicks", "ended"])

    # bit 1: a click; bit 2: the event that ends a session
    bit = F.col("event_type").eqNullSafe("click").cast("byte")
    if end_event is not None:
        bit = (bit + 2 * F.col("event_type").eqNullSafe(end_event).cast("byte")).cast("byte")
    out = (stream.withWatermark("ts", watermark).select(who, "ts", "event_id", bit.alias("kind")).groupBy(who)
           .applyInPandasWithState(run, f"{who} {kind}, started_ms long, last_ms long, n long, clicks long, ended boolean",
                                   "started long, last long, n long, clicks long", "append", GroupStateTimeout.EventTimeTimeout))
    return out.select(who, F.timestamp_millis("started_ms").alias("started"), F.timestamp_millis("last_ms").alias("last_active"), "n", "clicks", "ended")


def stream_dedupe(stream: DataFrame, keys: list[str], ttl_seconds: int = 86400, watermark: str = DEDUPE_WATERMARK) -> DataFrame:
    """(keys, accepted): events that count; each blocks its key for ``ttl_seconds`` from its own second.

    State per key is the second accepted last; it goes when the watermark has
    passed the end of the block. The batch form is ``windows.once_per_ttl``.
    """
    kinds = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)

    def run(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last, out, late = state.get[0] if state.exists else None, [], state.getCurrentWatermarkMs()
        for rows in _in_order(frames):
            for sec in np.unique(rows["ms"][rows["ms"] >= late] // 1000).tolist():
                if last is None or sec >= last + ttl_seconds:
                    last = sec
                    out.append(last)
        if last is not None and (last + ttl_seconds) * 1000 > late:
            state.update((last,))
            state.setTimeoutTimestamp((last + ttl_seconds) * 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(*key, s) for s in out], columns=[*keys, "accepted"])

    return (stream.withWatermark("ts", watermark).select(*keys, "ts", "event_id").groupBy(*keys)
            .applyInPandasWithState(run, f"{kinds}, accepted long", "last long", "append", GroupStateTimeout.EventTimeTimeout))


def stream_rate(stream: DataFrame, who: str, length: str, limit: int, watermark: str = COUNTER_WATERMARK) -> DataFrame:
    """Windows above their limit."""
    return (stream.withWatermark("ts", watermark).groupBy(who, F.window("ts", length).alias("w"))
            .agg(F.count("*").alias("n")).where(F.col("n") > limit).select(who, F.col("w.start").alias("window_start"), "n"))


def upsert_batch(path: str, keys: list[str]):
    """foreachBatch sink for update mode: every batch is one folder of the table.

    Written by batch id, so a batch that is run again replaces itself;
    ``read_upserts`` takes the row of the latest batch for each key.
    """
    def write(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id:08d}")
    return write


def read_upserts(spark: SparkSession, path: str, keys: list[str], schema: str) -> DataFrame:
    cols = [f.split()[0] for f in schema.split(",")]
    rest = [x for x in cols if x not in keys]
    d = spark.read.schema(schema + ", batch_id int").parquet(f"{path}/batch=*")
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


def run_to_table(stream: DataFrame, name: str, keys: list[str], schema: str, mode: str = "update") -> DataFrame:
    """Drains what is available into a keyed table in the shared folder and reads it."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    q = (stream.writeStream.foreachBatch(upsert_batch(f"{base}/rows", keys)).outputMode(mode)
         .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return read_upserts(spark, f"{base}/rows", keys, schema)


def _events(t: Tables) -> DataFrame:
    return event_stream(t.spark, t.folder, glob="events.parquet")


def counter_dims() -> dict[str, Column]:
    """What the daily counters count by: type of event, and mode and query of searches."""
    k = F.get_json_object("props", "$.k").cast("int")
    search = F.col("event_type") == "view"
    return {"event_type": F.col("event_type"), "mode": F.when(search, F.when(k % 2 == 0, "n").otherwise("y")),
            "query": F.when(search, F.concat(F.lit("query "), k % 25))}


def replay_counters(t: Tables) -> DataFrame:
    return run_to_table(stream_counters(_events(t), counter_dims()), "counters", ["day", "dim", "value"], "day timestamp, dim string, value string, n bigint")


def replay_sessions(t: Tables, gap_seconds: int, end_event: str | None = None) -> DataFrame:
    return run_to_table(stream_sessions(_events(t), "user_id", gap_seconds, end_event), "sessions", ["user_id", "started"],
                        "user_id bigint, started timestamp, last_active timestamp, n bigint, clicks bigint, ended boolean", "append")


def replay_dedupe(t: Tables, ttl_seconds: int = 86400) -> DataFrame:
    s = stream_dedupe(_events(t), ["user_id", "event_type"], ttl_seconds).withColumn("one", F.lit(1))
    return run_to_table(s, "dedupe", ["user_id", "event_type", "accepted"], "user_id bigint, event_type string, accepted bigint, one int", "append")


def replay_rate(t: Tables, length: str, limit: int) -> DataFrame:
    return run_to_table(stream_rate(_events(t), "user_id", length, limit), "rate", ["user_id", "window_start"],
                        "user_id bigint, window_start timestamp, n bigint")
