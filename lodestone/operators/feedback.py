"""Trending, rank feedback and the store of related searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.retrieve import vector_topk
from lodestone.operators.windows import once_per_ttl, top_k

# --- fixed values: lifetimes, steps and caps of the feedback stores ------------------
DAY_SECONDS = 86400
TERM_STEP, QUESTION_STEP = 10000, 100
MIN_STORE_LENGTH, MIN_STORE_WORDS = 3, 2
TIME_WORDS = ["today", "tomorrow", "yesterday", "this week", "tonight", "now", "current", "latest", "2026", "2025"]
STORE_CAP, STORE_SLACK = 5000, 100
MAX_LIFE_HOURS, STORE_HOURS = 168, 24
SIMILAR_LOW, SIMILAR_HIGH, SIMILAR_K = 0.70, 0.92, 5


# ---- trending ------------------------------------------------------------------------

def result_record(df: DataFrame) -> DataFrame:
    """Title, summary, url, image, brand, category, schema and id with fallbacks."""
    have = set(df.columns)

    def first(*names: str) -> Column:
        cols = [X.blank_null(F.col(n)) for n in names if n in have]
        return F.coalesce(*cols, F.lit(""))
    image = F.coalesce(F.get("image_url", F.lit(0)), F.lit("")) if "image_url" in have else F.lit("")
    return df.withColumns({
        "r_title": first("document_title", "title"), "r_summary": first("document_summary", "summary"), "r_url": first("document_url", "url"),
        "r_image": image, "r_brand": first("document_brand", "host"), "r_category": first("document_category", "lang"),
        "r_id": F.coalesce(X.blank_null(first("document_uuid", "id")), F.md5(first("document_url", "url")))})


def trending(clicks: DataFrame, levels: list[str], dedupe_scope: str = "place", ttl_seconds: int | None = None) -> DataFrame:
    """(level, place, query_hash, doc_key, score, last_write): clicks of distinct sessions per place.

    A click counts at every place level it has and in ``general``. With scope
    ``session`` the first level and ``general`` of a click count, as the
    key without the place makes it. ``ttl_seconds`` drops places whose last
    write is older than that, measured from the newest click of the log.
    """
    c = clicks.where(F.col("session_id").isNotNull() & (F.coalesce("clicked_url", F.lit("")) != "") & (F.coalesce("query", F.lit("")) != ""))
    c = c.withColumn("query_hash", X.trending_hash(F.col("query")))
    every = [F.struct(F.lit(i).alias("level"), F.col(x).alias("place")) for i, x in enumerate(levels)]
    places = F.filter(F.array(*every), lambda p: F.coalesce(p["place"], F.lit("")) != "")
    if dedupe_scope == "session":
        places = F.slice(places, 1, 1)
    general = F.struct(F.lit(len(levels)).alias("level"), F.lit("general").alias("place"))
    e = c.select("session_id", "query_hash", "doc_key", "ts", F.explode(F.concat(places, F.array(general))).alias("p"))
    one = e.groupBy("p.level", "p.place", "session_id", "query_hash", "doc_key").agg(F.max("ts").alias("ts"))
    t = one.groupBy("level", "place", "query_hash", "doc_key").agg(F.count("*").alias("score"), F.max("ts").alias("last_write"))
    if ttl_seconds is not None:
        alive = t.groupBy("level", "place").agg(F.max("last_write").alias("_w"))
        newest = clicks.agg(F.max("ts").alias("_now")).withColumn("_k", F.lit(1))  # one row
        alive = alive.withColumn("_k", F.lit(1)).join(F.broadcast(newest), "_k").where(F.unix_timestamp("_now") - F.unix_timestamp("_w") <= ttl_seconds)
        t = t.join(alive.select("level", "place"), ["level", "place"], "left_semi")
    return t


def trending_top(t: DataFrame, k: int) -> DataFrame:
    """The ``k`` best documents of each place, each by its best row."""
    order = [F.desc("score"), F.asc("query_hash"), F.asc("doc_key")]
    one = top_k(t, ["level", "place", "doc_key"], order, 1)
    return top_k(one, ["level", "place"], order, k, rank="rank")


def trending_for(visitors: DataFrame, top: DataFrame) -> DataFrame:
    """Each visitor's place list, or the general one where the place has none (visitor, place)."""
    general = top.where(F.col("place") == "general").select(F.lit("general").alias("_k"), F.col("doc_key"), "score", "rank")
    have = top.select("place").distinct()
    v = visitors.join(have.withColumn("_has", F.lit(True)), "place", "left").withColumn(
        "_k", F.when(F.col("_has").isNull(), "general").otherwise(F.col("place")))
    lists = top.where(F.col("place") != "general").select(F.col("place").alias("_k"), "doc_key", "score", "rank").unionByName(general)
    return v.join(lists, "_k").select("visitor", F.col("_k").alias("place"), "doc_key", "score", "rank")


# ---- rank feedback -----------------------------------------------------------------------

def bump(table: DataFrame, key: str, value: str, clicks: DataFrame, step: int, ttl: int = DAY_SECONDS) -> DataFrame:
    """``value`` raised by ``step`` for each click that counts: once per session and key in ``ttl`` seconds."""
    hits = once_per_ttl(clicks, ["session_id", key], "ts", ttl)
    add = hits.groupBy(key).agg(F.count("*").alias("_n"), F.max("accepted").alias("last_clicked_at"))
    return table.join(add, key, "left").withColumn(value, F.col(value) + F.coalesce("_n", F.lit(0)) * step).drop("_n")


def bump_term_ranks(vocab: DataFrame, clicks: DataFrame) -> DataFrame:
    """Clicked terms of the vocabulary gain rank; unknown terms are ignored."""
    return bump(vocab, "term", "rank", clicks, TERM_STEP)


def bump_question_scores(questions: DataFrame, clicks: DataFrame) -> DataFrame:
    return bump(questions, "question_key", "question_score", clicks, QUESTION_STEP)


# ---- related searches ----------------------------------------------------------------------

def eligible(df: DataFrame, query: str = "query", vector: str | None = None, width: int = 384) -> DataFrame:
    """Long enough, at least two words, not tied to a date; the vector has the right width."""
    n = X.normalize_query(F.col(query))
    ok = (F.length(n) >= MIN_STORE_LENGTH) & (F.size(F.split(n, " ")) >= MIN_STORE_WORDS)
    ok = ok & ~reduce(lambda a, b: a | b, [n.contains(w) for w in TIME_WORDS])
    if vector:
        ok = ok & (F.coalesce(F.size(F.col(vector)), F.lit(0)) == width)
    return df.where(ok)


def store_queries(store: DataFrame, log: DataFrame) -> DataFrame:
    """The store merged with a log: counts added, larger result count kept, life extended.

    store: query_hash, query, search_count, result_count, created, expires (seconds).
    log: query, results_count, ts. Life grows by a day per sighting, at most a week from creation.
    """
    new = log.select(X.store_hash(F.col("query")).alias("query_hash"), X.normalize_query(F.col("query")).alias("query"),
                     F.col("results_count"), F.unix_timestamp("ts").alias("s"))
    new = new.groupBy("query_hash").agg(F.min("query").alias("n_query"), F.count("*").alias("n"), F.max("results_count").alias("n_results"),
                                        F.min("s").alias("n_first"), F.max("s").alias("n_last"))
    m = store.join(new, "query_hash", "full_outer")
    born = F.coalesce("created", "n_first")
    life = F.least(F.greatest(F.coalesce("expires", F.lit(0)), F.coalesce(F.col("n_last") + STORE_HOURS * 3600, F.lit(0))), born + MAX_LIFE_HOURS * 3600)
    return m.select("query_hash", F.coalesce("query", "n_query").alias("query"),
                    (F.coalesce("search_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("search_count"),
                    F.greatest(F.coalesce("result_count", F.lit(0)), F.coalesce("n_results", F.lit(0))).alias("result_count"),
                    born.alias("created"), life.alias("expires"))


def cap_store(store: DataFrame, cap: int | None = None, slack: int = STORE_SLACK) -> DataFrame:
    """The store with a column ``removed``: nothing goes unless a cap is asked for.

    A store over ``cap`` keeps its newest ``cap - slack`` entries, chosen by a
    distributed top-k; the size of the store is one row in the plan.
    """
    if cap is None:
        return store.withColumn("removed", F.lit(False))
    kept = store.orderBy(F.desc("created"), F.asc("query_hash")).limit(cap - slack).select("query_hash", F.lit(True).alias("_kept"))
    size = store.agg(F.count("*").alias("_size")).withColumn("_one", F.lit(1))
    d = store.withColumn("_one", F.lit(1)).join(F.broadcast(size), "_one").join(kept, "query_hash", "left")
    return d.withColumn("removed", (F.col("_size") > cap) & F.col("_kept").isNull()).drop("_one", "_size", "_kept")


def related_searches(queries: DataFrame, store: DataFrame, lo: float = SIMILAR_LOW, hi: float = SIMILAR_HIGH, k: int = SIMILAR_K) -> DataFrame:
    """Stored queries in the similarity band, most similar first, without the query itself.

    queries: query_hash, embedding. store: query_hash, embedding, result_count.
    """
    s = store.where(F.col("result_count") >= 1)
    r = vector_topk(queries.select(F.col("query_hash").alias("qid"), F.col("embedding").alias("qvec")),
                    s.select(F.col("query_hash").alias("iid"), F.col("embedding").alias("ivec")), k, exclude_self=True, lo=lo, hi=hi)
    return r.select(F.col("qid").alias("query_hash"), F.col("iid").alias("related_hash"), (1 - F.col("distance")).alias("similarity"), "rank")


def popular_stored(store: DataFrame, k: int) -> DataFrame:
    return store.where(F.col("result_count") > 0).orderBy(F.desc("search_count"), F.asc("query_hash")).limit(k)


def store_totals(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("total"), F.count_if(F.col("result_count") > 0).alias("with_results"),
                     F.count_if(F.col("result_count") == 0).alias("without_results"), F.sum("search_count").alias("searches"))


def clean_store(store: DataFrame, now: Column, max_age_hours: int = MAX_LIFE_HOURS) -> DataFrame:
    """Without zero-result entries and entries older than the limit."""
    return store.where((F.col("result_count") > 0) & (F.col("created") >= now - max_age_hours * 3600))


def seed_store(log: DataFrame, store: DataFrame, vectors: DataFrame, k: int | None = None, width: int = 384) -> tuple[DataFrame, DataFrame]:
    """Log queries not yet stored, with their vector, and the outcome counts.

    With ``k``, the k most popular of those that may be stored; queries that
    may not are counted as skipped.
    """
    q = log.groupBy(X.store_hash(F.col("query")).alias("query_hash")).agg(
        F.min("query").alias("query"), F.count("*").alias("search_count"), F.max("results_count").alias("result_count"))
    fit = eligible(q).join(store.select("query_hash"), "query_hash", "left_anti")
    best = fit if k is None else fit.orderBy(F.desc("search_count"), F.asc("query_hash")).limit(k)
    good = F.coalesce(F.size("embedding"), F.lit(0)) == width
    d = best.join(vectors.select("query_hash", "embedding"), "query_hash", "left").withColumn("outcome", F.when(good, "stored").otherwise("failed"))
    skipped = q.join(fit.select("query_hash"), "query_hash", "left_anti").select(F.lit("skipped").alias("outcome"))
    return d.where(F.col("outcome") == "stored").drop("outcome"), d.select("outcome").unionByName(skipped).groupBy("outcome").agg(F.count("*").alias("n"))


def daily_sample(df: DataFrame, key: str, day: str, salt: str, n: int | None = None, per: str | None = None) -> DataFrame:
    """The same pseudo-random order for everybody on one day; first n rows, or one per ``per``."""
    order = F.md5(F.concat_ws("|", F.lit(day), F.lit(salt), F.col(key).cast("string")))
    d = df.withColumn("shuffle_key", order)
    if per:
        d = top_k(d, [per], [F.asc("shuffle_key"), F.asc(key)], 1)
    return d.orderBy(F.asc("shuffle_key"), F.asc(key)).limit(n) if n else d
