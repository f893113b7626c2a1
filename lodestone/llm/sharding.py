"""Random order and shards of equal row counts by a two-pass external shuffle.

Pass one scatters the rows by seeded hashes into buckets that fit in memory
(Spark's shuffle). Pass two holds one bucket at a time, permutes it with
Spark's ``shuffle`` (Fisher-Yates) and writes it. The buckets one after the
other are a random order of all rows, which is cut into shards whose counts
differ by at most one. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.store import stored

BUCKET_BYTES = 16 << 20
#: Bucket offsets (16 bytes each) are broadcast up to this many buckets, joined by sorting beyond.
BROADCAST_BUCKETS = 1 << 20
#: Buckets whose offsets one task adds up; the totals of the runs are added up in one more.
OFFSET_RUN = 1 << 12
SEED = 42


def scatter_and_permute(rows: DataFrame, buckets: int, seed: int = SEED, tie: list[str] | None = None) -> DataFrame:
    """(_bucket, _pos, _row): rows dealt to buckets by hash, each bucket in random order, written to the shared folder.

    The row number of the scan salts the hash, so repeated rows spread as well.
    Rows are sorted before they are permuted, and the outcome is written, so a
    repeated task gives the same order; another split of the files gives another
    one. A bucket is a task of its own.
    """
    h = F.xxhash64(F.lit(seed), *(tie or []), F.monotonically_increasing_id())
    dealt = (rows.select(F.struct("*").alias("_row"), h.alias("_h")).withColumn("_bucket", F.pmod(F.xxhash64("_h"), F.lit(buckets)).cast("int"))
             .repartitionById(buckets, "_bucket").sortWithinPartitions("_bucket", "_h"))
    held = dealt.groupBy("_bucket").agg(F.collect_list("_row").alias("_rows"))
    return stored(held.select("_bucket", F.posexplode(F.shuffle("_rows", seed)).alias("_pos", "_row")), "shuffled")


def offsets(counts: DataFrame, run: int = OFFSET_RUN) -> DataFrame:
    """(_bucket, _start): the rows before each bucket of (_bucket, count), summed in runs of buckets and over the runs."""
    ahead = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = counts.withColumn("_run", F.floor(F.col("_bucket") / run))
    runs = c.groupBy("_run").agg(F.sum("count").alias("count")).select("_run", ahead(Window.orderBy("_run")).alias("_ahead"))
    inside = c.select("_run", "_bucket", ahead(Window.partitionBy("_run").orderBy("_bucket")).alias("_start"))
    return inside.join(runs, "_run").select("_bucket", (F.col("_start") + F.col("_ahead")).alias("_start"))


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """All rows and columns of ``docs`` with their ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Shards hold consecutive stretches of the random order; their row counts
    differ by at most one. Nulls and empty texts are rows like others, repeated
    rows stay repeated, an empty table gives an empty table. Columns of ``docs``
    named shard or slot are replaced.
    """
    rows = docs.select(*(c for c in docs.columns if c.lower() not in ("shard", "slot")))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    # at least a bucket for each shuffle partition, so that a small table is not left to a few tasks
    buckets = max(1, -(-total // bucket_bytes), min(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    mixed = scatter_and_permute(rows, buckets, seed, [id_col])
    starts = offsets(mixed.groupBy("_bucket").count())
    starts = F.broadcast(starts) if buckets <= BROADCAST_BUCKETS else starts
    base, extra = divmod(n, shards)
    g, long_rows = F.col("_start") + F.col("_pos"), extra * (base + 1)
    in_long = g < long_rows
    place = [F.when(in_long, F.floor(g / (base + 1))), F.when(in_long, g % (base + 1))]
    if base:
        place = [place[0].otherwise(extra + F.floor((g - long_rows) / base)), place[1].otherwise((g - long_rows) % base)]
    return mixed.join(starts, "_bucket").select("_row.*", place[0].cast("int").alias("shard"), place[1].cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in the order of their slots."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
