"""Corpus-wide removal of repeated lines with levelled sorted runs of line hashes.

Documents are taken in batches of rising id. What earlier batches have seen
lies in sorted runs, tables of 128-bit line hashes in the shared folder. A new
batch reduces its lines to one row for each hash (before the shuffle, so that a
line which a third of the documents hold costs a row for each task), merges
them with the runs, and writes the hashes that no run holds as a run of its
own. When a level holds ``fanout`` runs they are merged into one run of the
next level. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.store import discard, free_names, new_path, stored

BATCHES = 4
FANOUT = 2
MIN_CHARS = 10
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["_h1", "_h2"]


def line_key(line: Column) -> Column:
    """Blanks stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


class LevelledRuns:
    """Sorted runs of distinct hashes; each hash lies in one run only."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, []

    def all(self) -> DataFrame | None:
        out = None
        for run in (r for level in self.levels for r in level):
            out = run if out is None else out.unionByName(run)
        return out

    def add(self, hashes: DataFrame, level: int = 0) -> None:
        """One more run; full levels are merged upwards."""
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(stored(hashes.repartitionByRange(*HASH).sortWithinPartitions(*HASH), f"run-{level}"))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = full[0]
            for r in full[1:]:
                merged = merged.unionByName(r)
            self.add(merged, level + 1)
            for r in full:
                discard(r)

    def drop(self) -> None:
        for run in (r for level in self.levels for r in level):
            discard(run)


def _batch(id_col: Column, cuts: list[int]) -> Column:
    return sum((F.when(id_col > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


def _repeated(lines: DataFrame, batches: int, fanout: int) -> DataFrame:
    """(batch, hash, first id of the batch, seen): hashes that drop lines in a batch; ``seen`` if an earlier batch holds them."""
    runs, out = LevelledRuns(lines.sparkSession, fanout), None
    for b in range(batches):
        own = lines.where(F.col("_batch") == b).groupBy(*HASH).agg(F.min("_id").alias("_first"), (F.max("_id") > F.min("_id")).alias("_many"))
        before = runs.all()
        if before is None:
            own = own.withColumn("_seen", F.lit(False))
        else:
            own = own.join(before.withColumn("_run", F.lit(True)).hint("merge"), HASH, "left").select(*HASH, "_first", "_many", F.col("_run").isNotNull().alias("_seen"))
        own = stored(own, "line-batch")
        if b + 1 < batches:
            runs.add(own.where("not _seen").select(*HASH))
        drops = stored(own.where("_seen or _many").select(F.lit(b).alias("_batch"), *HASH, F.when(~F.col("_seen"), F.col("_first")).alias("_first")), "line-drops")
        discard(own)
        out = drops if out is None else out.unionByName(drops)
    runs.drop()
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """All rows and columns of ``docs`` with repeated lines gone from the text, and n_lines, n_dropped (long).

    Texts are split at \\n; a null or empty text is one empty line and becomes
    the empty text. A line whose key has at least ``min_chars`` code points and
    occurs in another document with a smaller id goes; all other lines stay in
    their order, joined by \\n. Rows that share an id are one document. A null
    id counts as the largest. Columns of ``docs`` named n_lines or n_dropped are
    replaced. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    rows = docs.select(ident.alias("_id"), text.alias("_t"))
    cuts = rows.agg(F.percentile_approx("_id", [k / batches for k in range(1, batches)] or [0.5], 1000)).first()[0] if batches > 1 else []
    lines = rows.select("_id", F.xxhash64("_t").alias("_th"), F.posexplode(F.split("_t", "\n")).alias("_pos", "_line"))
    key = line_key(F.col("_line"))
    lines = (lines.select("_id", "_th", "_pos", key.alias("_key")).where(F.length("_key") >= min_chars)
             .select("_id", "_th", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"), _batch(F.col("_id"), sorted(set(cuts or []))).alias("_batch")))
    path = new_path(docs.sparkSession, "lines")
    lines.write.partitionBy("_batch").parquet(path)
    lines = docs.sparkSession.read.schema(lines.schema).parquet(path)
    gone = _repeated(lines, batches, fanout)
    i, t, h, g = free_names(docs, "_id", "_t", "_th", "_gone")
    dropped = (lines.join(gone, ["_batch", *HASH]).where(F.col("_first").isNull() | (F.col("_id") > F.col("_first")))
               .groupBy(F.col("_id").alias(i), F.col("_th").alias(h)).agg(F.collect_set("_pos").alias(g)))
    split = F.split(t, "\n")
    n = F.size(split)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col(g)), lambda k: F.get(split, k)), "\n")
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    own = docs.select(*keep, ident.alias(i), text.alias(t), F.xxhash64(text).alias(h))
    return (own.join(dropped, [i, h], "left")
            .select(*(F.when(F.col(g).isNull(), F.col(t)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in keep),
                    n.cast("long").alias("n_lines"), F.coalesce(F.size(g), F.lit(0)).cast("long").alias("n_dropped")))


SQL = r"""
WITH lines AS (
  SELECT doc_id, i, list_extract(string_split(coalesce(text, ''), chr(10)), i) AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
keyed AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
firsts AS (SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (
  SELECT keyed.doc_id, i, line, coalesce(first_id < keyed.doc_id, false) AS gone
  FROM keyed LEFT JOIN firsts ON keyed.k = firsts.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
