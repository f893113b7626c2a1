"""Session, search and click analytics over one append-only event log.

Every counter is a group-by over the log, so loading a day twice through the
log's key cannot change it. Counts and sums are partial before the shuffle,
which keeps hot users, queries and days cheap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.windows import once_per_ttl, top_k

# --- fixed values: limits and buckets of the event log -----------------------
CLICK_BUCKETS = [(2000, "instant"), (5000, "fast"), (15000, "normal"), (30000, "slow")]
POSITION_CAP = 100
MIN_TYPING_MS = 50
MAX_SESSION_REQUESTS = 200
MAX_AGE_SECONDS, MAX_AHEAD_SECONDS, NONCE_SECONDS = 300, 60, 60
SEARCHES_PER_MINUTE, CLICKS_PER_MINUTE, CLICKS_PER_HOUR = 60, 120, 1000
RETENTION_DAYS = 90


def last_days(log: DataFrame, days: int | None, until: str, col: str = "event_date") -> DataFrame:
    """Rows of the last ``days`` days up to ``until``; a partition filter on the log."""
    if days is None:
        return log
    end = F.lit(until).cast("date")
    return log.where((F.col(col) <= end) & (F.col(col) > F.date_sub(end, days)))


def safe_ratio(a: Column, b: Column, digits: int) -> Column:
    return F.when(b != 0, F.round(a / b, digits)).otherwise(0.0)


# ---- event records ----------------------------------------------------------

def build_search_events(raw: DataFrame) -> DataFrame:
    """The search event record from raw request columns; absent ones take defaults."""
    have = set(raw.columns)

    def s(name: str, default: str = "", cap: int | None = None) -> Column:
        v = F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in have else F.lit(default)
        return F.substring(v, 1, cap) if cap else v

    def n(name: str, typ: str, default=0) -> Column:
        d = F.lit(default).cast(typ)
        return F.coalesce(F.col(name).cast(typ), d) if name in have else d

    norm = F.substring(X.strip(F.lower("query")), 1, 500)
    corrected = s("corrected_query", cap=500)
    words = F.filter(F.split("query", r"\s+"), lambda w: w != "")
    return raw.select(
        F.lit("search").alias("event_type"), F.col("ts").alias("timestamp"), F.unix_timestamp("ts").alias("timestamp_ts"),
        F.col("session_id").cast("string"),
        F.coalesce(F.nullif(s("request_id"), F.lit("")), F.concat_ws(":", "session_id", F.unix_timestamp("ts"))).alias("request_id"),
        F.substring("query", 1, 500).alias("query"), norm.alias("query_normalized"), X.short_hash(norm, 12).alias("query_hash"),
        F.length("query").alias("query_length"), F.size(words).alias("query_word_count"),
        n("results_count", "int").alias("results_count"), (n("results_count", "int") > 0).alias("has_results"),
        s("alt_mode", "n").alias("alt_mode"), s("user_id").alias("user_id"), (s("user_id") != "").alias("is_logged_in"),
        s("device_type", "unknown").alias("device_type"), s("browser", "Unknown").alias("browser"),
        s("browser_version").alias("browser_version"), s("os_name", "Unknown").alias("os_name"), s("os_version").alias("os_version"),
        n("is_mobile", "boolean", False).alias("is_mobile"), n("is_bot", "boolean", False).alias("is_bot"),
        n("search_time_ms", "double").alias("search_time_ms"), s("search_strategy").alias("search_strategy"),
        corrected.alias("corrected_query"),
        ((corrected != "") & (F.lower(corrected) != F.lower("query"))).alias("was_corrected"),
        s("filters_applied", "{}").alias("filters_applied"), n("page", "int", 1).alias("page"), s("intent", "general").alias("intent"),
        s("location_city").alias("location_city"), s("location_country").alias("location_country"),
        s("location_country_code").alias("location_country_code"), F.to_date("ts").alias("event_date"))


def build_click_events(raw: DataFrame) -> DataFrame:
    """The click event record with its length caps."""
    have = set(raw.columns)

    def s(name: str, cap: int | None = None) -> Column:
        v = F.coalesce(F.col(name).cast("string"), F.lit("")) if name in have else F.lit("")
        return F.substring(v, 1, cap) if cap else v

    def n(name: str, typ: str) -> Column:
        return F.coalesce(F.col(name).cast(typ), F.lit(0).cast(typ)) if name in have else F.lit(0).cast(typ)

    return raw.select(
        F.lit("click").alias("event_type"), F.col("ts").alias("timestamp"), F.unix_timestamp("ts").alias("timestamp_ts"),
        F.col("session_id").cast("string"), s("query", 500).alias("query"),
        F.substring(X.strip(F.lower(s("query"))), 1, 500).alias("query_normalized"), s("clicked_url", 2000).alias("clicked_url"),
        n("clicked_position", "int").alias("clicked_position"), s("result_id").alias("result_id"),
        s("result_title", 500).alias("result_title"), s("result_source", 200).alias("result_source"), s("user_id").alias("user_id"),
        n("time_to_click_ms", "bigint").alias("time_to_click_ms"), s("location_city").alias("location_city"),
        s("location_region").alias("location_region"), s("location_country").alias("location_country"),
        s("search_request_id").alias("search_request_id"), n("results_count", "int").alias("results_count"),
        n("was_corrected", "boolean").alias("was_corrected"), s("corrected_query", 500).alias("corrected_query"),
        F.to_date("ts").alias("event_date"))


def build_custom_events(raw: DataFrame) -> DataFrame:
    """Custom events: at most 50 properties, keys and values capped by kind.

    Plain strings keep 1000 characters, nested maps 20 entries of 200
    characters, numbers pass, anything else keeps 500 characters.
    """
    props = F.from_json("props", "map<string,string>")
    kept = F.slice(F.map_entries(props), 1, 50)

    def nested(v: Column) -> Column:
        inner = F.slice(F.map_entries(F.from_json(v, "map<string,string>")), 1, 20)
        return F.to_json(F.map_from_entries(F.transform(inner, lambda e: F.struct(
            F.substring(e["key"], 1, 50).alias("key"), F.substring(e["value"], 1, 200).alias("value")))))

    def clean(e: Column) -> Column:
        v = e["value"]
        number = v.try_cast("double").isNotNull() | v.isin("true", "false")
        return F.struct(F.substring(e["key"], 1, 100).alias("key"),
                        F.when(number, v).when(v.startswith("{"), nested(v)).when(v.startswith("["), F.substring(v, 1, 500))
                        .otherwise(F.substring(v, 1, 1000)).alias("value"))

    return raw.withColumns({"event_type": F.substring("event_type", 1, 100),
                            "props": F.map_from_entries(F.transform(kept, clean))})


# ---- sessions -----------------------------------------------------------------

def sessions(events: DataFrame, dims: list[str] = ()) -> DataFrame:
    """One row per session: activity span, counts, first known user and attributes."""
    known = [F.min_by(d, F.when(F.col(d).isNotNull(), F.struct("ts", "event_id"))).alias(d) for d in dims]
    return events.groupBy("session_id").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("last_active"),
        F.min_by("user_id", F.when(F.col("user_id").isNotNull(), F.struct("ts", "event_id"))).alias("user_id"), *known,
        F.count("*").alias("page_views"), F.count_if(F.col("event_type") == "view").alias("search_count"),
        F.count_if(F.col("event_type") == "click").alias("click_count"),
        F.bool_or(F.col("event_type") == "signup").alias("ended"),
        F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("ended_at"),
    ).withColumn("is_logged_in", F.col("user_id").isNotNull())


def session_duration(s: DataFrame) -> DataFrame:
    sec = F.unix_timestamp("last_active") - F.unix_timestamp("created_at")
    return s.withColumns({"duration_seconds": sec, "duration_minutes": F.round(sec / 60, 1)})


def session_archive(s: DataFrame, ended_only: bool = True) -> DataFrame:
    """Totals of finished sessions by end date."""
    s = session_duration(s)
    d = s.where("ended").withColumn("day", F.to_date("ended_at")) if ended_only else s.withColumn("day", F.to_date("last_active"))
    return d.groupBy("day").agg(
        F.count("*").alias("total_sessions"), F.sum("duration_seconds").alias("total_duration_seconds"),
        F.sum("search_count").alias("total_searches"), F.sum("click_count").alias("total_clicks"),
        F.count_if("is_logged_in").alias("logged_in_sessions"), F.count_if(~F.col("is_logged_in")).alias("anonymous_sessions"))


def user_sessions(s: DataFrame, k: int | None = None) -> DataFrame:
    return top_k(s.where(F.col("user_id").isNotNull()), ["user_id"], [F.desc("created_at"), F.asc("session_id")], k, rank="rank")


def daily_audience(s: DataFrame, dims: list[str]) -> DataFrame:
    """Active sessions per day, total and per value of each dimension, in one pass."""
    entries = F.array(F.struct(F.lit("all").alias("dim"), F.lit("").alias("value")),
                      *[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])
    return (s.select(F.to_date("created_at").alias("day"), F.explode(entries).alias("e")).select("day", "e.*")
            .where(F.col("value").isNotNull()).groupBy("day", "dim", "value").agg(F.count("*").alias("n")))


# ---- searches --------------------------------------------------------------------

def popular_queries(log: DataFrame, k: int | None, keys: list[str] = ()) -> DataFrame:
    """Search count per normalised query; ``keys`` adds day or other dimensions."""
    c = log.groupBy(*keys, F.col("query_normalized").alias("query")).agg(F.count("*").alias("n"))
    if k is None:
        return c
    order = [F.desc("n"), F.asc("query")]
    return top_k(c, list(keys), order, k) if keys else c.orderBy(*order).limit(k)


def zero_result_queries(log: DataFrame, k: int | None, keys: list[str] = ()) -> DataFrame:
    return popular_queries(log.where(F.col("results_count") == 0), k, keys)


MODE_MEANING = {"y": "dropdown", "n": "keyword"}


def compare_modes(log: DataFrame) -> DataFrame:
    """Searches, results and time per mode; time of timed rows over all searches."""
    meaning = F.create_map(*[F.lit(x) for kv in MODE_MEANING.items() for x in kv])
    n = F.col("searches")
    return (log.groupBy("mode").agg(F.count("*").alias("searches"), F.sum("results_count").alias("total_results"),
                                    F.sum(F.when(F.col("search_time_ms") > 0, F.floor("search_time_ms"))).alias("total_time_ms"))
            .withColumns({"meaning": F.try_element_at(meaning, F.col("mode")),
                          "avg_results": safe_ratio(F.col("total_results"), n, 2),
                          "avg_time_ms": safe_ratio(F.coalesce("total_time_ms", F.lit(0)), n, 2)}))


def location_stats(log: DataFrame, country_k: int = 20, city_k: int = 50, daily_cap: int | None = None) -> DataFrame:
    """Search volume of the top countries and cities; ``daily_cap`` sums only each day's leaders."""
    e = F.array(F.struct(F.lit("country").alias("level"), F.col("location_country").alias("place")),
                F.struct(F.lit("city").alias("level"), F.col("location_city").alias("place")))
    d = (log.select("event_date", F.explode(e).alias("e")).select("event_date", "e.*").where(F.col("place").isNotNull())
         .groupBy("event_date", "level", "place").agg(F.count("*").alias("n")))
    if daily_cap:
        d = top_k(d, ["event_date", "level"], [F.desc("n"), F.asc("place")], daily_cap)
    t = d.groupBy("level", "place").agg(F.sum("n").alias("n"))
    r = top_k(t, ["level"], [F.desc("n"), F.asc("place")], max(country_k, city_k), rank="rank")
    return r.where(F.when(F.col("level") == "country", F.col("rank") <= country_k).otherwise(F.col("rank") <= city_k))


def volume_by(log: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """Counts per dimension, several dimensions in one pass."""
    e = F.array(*[F.struct(F.lit(k).alias("dim"), v.cast("string").alias("value")) for k, v in dims.items()])
    return log.select(F.explode(e).alias("e")).select("e.*").groupBy("dim", "value").agg(F.count("*").alias("n"))


def strategy_stats(log: DataFrame, strategy: str) -> DataFrame:
    return (log.groupBy(strategy).agg(F.count("*").alias("count"), F.sum("results_count").alias("total_results"))
            .withColumn("avg_results", safe_ratio(F.col("total_results"), F.col("count"), 2)))


def user_history(log: DataFrame, k: int | None = None) -> DataFrame:
    return top_k(log, ["user_id"], [F.desc("ts"), F.desc("event_id")], k, rank="rank")


# ---- clicks ------------------------------------------------------------------------

def click_popularity(clicks: DataFrame, dims: list[str]) -> DataFrame:
    """Clicks per value of each dimension, daily and over all time."""
    e = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])
    daily = (clicks.select("event_date", F.explode(e).alias("e")).select("event_date", "e.*")
             .groupBy("event_date", "dim", "value").agg(F.count("*").alias("n")))
    total = daily.groupBy("dim", "value").agg(F.sum("n").alias("n")).withColumn("event_date", F.lit(None).cast("date"))
    return daily.unionByName(total)


def position_distribution(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy(F.least("clicked_position", F.lit(POSITION_CAP)).alias("position")).agg(F.count("*").alias("n"))


def query_clicks(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("query_normalized", "clicked_url").agg(F.count("*").alias("n"))


def click_bucket(ms: Column) -> Column:
    return reduce(lambda acc, b: F.when(ms < b[0], b[1]).otherwise(acc), reversed(CLICK_BUCKETS), F.lit("very_slow"))


def time_to_click(clicks: DataFrame) -> DataFrame:
    return clicks.where(F.col("time_to_click_ms") > 0).groupBy("event_date", click_bucket(F.col("time_to_click_ms")).alias("bucket")) \
        .agg(F.count("*").alias("n"))


def count_by(df: DataFrame, *dims: str) -> DataFrame:
    return df.groupBy("event_date", *dims).agg(F.count("*").alias("n"))


# ---- combined reports ----------------------------------------------------------------

def daily_stats(s: DataFrame, ended_only: bool = True) -> DataFrame:
    a = session_archive(s, ended_only)
    n, q, k = F.col("total_sessions"), F.col("total_searches"), F.col("total_clicks")
    return a.select("day", n.alias("sessions"), q.alias("searches"), k.alias("clicks"),
                    safe_ratio(F.col("total_duration_seconds"), n, 1).alias("avg_session_duration_seconds"),
                    safe_ratio(q, n, 2).alias("searches_per_session"), safe_ratio(k, q, 3).alias("click_through_rate"),
                    "logged_in_sessions", "anonymous_sessions")


def session_stats(log: DataFrame) -> DataFrame:
    """Counts, click-through, duration and distinct queries of each session."""
    q = F.when(F.col("event_type") == "view", F.col("query_normalized"))
    s = log.groupBy("session_id").agg(
        F.count_if(F.col("event_type") == "view").alias("search_count"),
        F.count_if(F.col("event_type") == "click").alias("click_count"),
        F.count_if(~F.col("event_type").isin("view", "click")).alias("event_count"),
        F.countDistinct(q).alias("unique_queries"),
        (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("sec"))
    return s.select("session_id", "search_count", "click_count", "event_count", "unique_queries",
                    safe_ratio(F.col("click_count"), F.col("search_count"), 3).alias("click_through_rate"),
                    F.round(F.col("sec") / 60, 1).alias("duration_minutes"))


TIMELINE_CAPS = {"search": 500, "click": 500, "event": 1000}


def session_timeline(log: DataFrame) -> DataFrame:
    """Latest searches, clicks and other events of each session."""
    kind = F.when(F.col("event_type") == "view", "search").when(F.col("event_type") == "click", "click").otherwise("event")
    r = top_k(log.withColumn("kind", kind), ["session_id", "kind"], [F.desc("ts"), F.desc("event_id")],
              max(TIMELINE_CAPS.values()), rank="rank")
    cap = reduce(lambda acc, kv: F.when(F.col("kind") == kv[0], kv[1]).otherwise(acc), TIMELINE_CAPS.items(), F.lit(0))
    return r.where(F.col("rank") <= cap)


def user_stats(log: DataFrame, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """Totals per user and each user's top queries."""
    u = log.groupBy("user_id").agg(
        F.countDistinct("session_id").alias("total_sessions"),
        F.count_if(F.col("event_type") == "view").alias("total_searches"),
        F.count_if(F.col("event_type") == "click").alias("total_clicks"))
    u = u.withColumn("click_through_rate", safe_ratio(F.col("total_clicks"), F.col("total_searches"), 3))
    q = (log.where(F.col("event_type") == "view").groupBy("user_id", F.lower("query").alias("query"))
         .agg(F.count("*").alias("n")))
    return u, top_k(q, ["user_id"], [F.desc("n"), F.asc("query")], k, rank="rank")


def retain(log: DataFrame, days: int, until: str) -> DataFrame:
    """The log without days older than the retention; a partition filter."""
    return log.where(F.col("event_date") >= F.date_sub(F.lit(until).cast("date"), days))


# ---- abuse signals ---------------------------------------------------------------------

def flag_bots(log: DataFrame, max_requests: int = MAX_SESSION_REQUESTS, min_typing_ms: int = MIN_TYPING_MS) -> DataFrame:
    """Bot reason per row: typing too fast, too many requests in the session, bot agent."""
    n = log.groupBy("session_id").agg(F.count("*").alias("session_requests"))
    return log.join(n, "session_id").withColumn(
        "bot_reason", F.when((F.col("typing_ms") > 0) & (F.col("typing_ms") < min_typing_ms), "Typing too fast")
        .when(F.col("session_requests") > max_requests, "Excessive requests in session")
        .when(X.parse_user_agent(F.col("user_agent"))["is_bot"], "Bot user agent"))


def flag_replays(log: DataFrame) -> DataFrame:
    """Stale, future and repeated-nonce requests (client_ts, nonce)."""
    ok = once_per_ttl(log, ["session_id", "nonce"], "ts", NONCE_SECONDS).withColumnRenamed("accepted", "_sec")
    age = F.unix_timestamp("ts") - F.unix_timestamp("client_ts")
    # a nonce is new on the first row of an accepted second
    lead = log.groupBy("session_id", "nonce", F.unix_timestamp("ts").alias("_sec")).agg(
        F.min(F.struct("ts", "event_id"))["event_id"].alias("event_id"))
    fresh = lead.join(ok, ["session_id", "nonce", "_sec"]).select("event_id", F.lit(True).alias("_new"))
    return log.join(fresh, "event_id", "left").withColumn(
        "replay_reason", F.when(age < -MAX_AHEAD_SECONDS, "Timestamp is in the future")
        .when(age > MAX_AGE_SECONDS, "Request too old").when(F.col("_new").isNull(), "Nonce already used")).drop("_new")


def rate_violations(log: DataFrame, who: str, limits: dict[str, tuple[str, str, int]]) -> DataFrame:
    """(who, rule, window_start, n): tumbling windows above their limit.

    limits: rule -> (event type, window length, limit).
    """
    parts = []
    for rule, (kind, length, limit) in limits.items():
        w = (log.where(F.col("event_type") == kind).groupBy(who, F.window("ts", length).alias("w"))
             .agg(F.count("*").alias("n")).where(F.col("n") > limit)
             .select(who, F.lit(rule).alias("rule"), F.col("w.start").alias("window_start"), "n"))
        parts.append(w)
    return reduce(lambda a, b: a.unionByName(b), parts)


DEFAULT_LIMITS = {"search_minute": ("view", "1 minute", SEARCHES_PER_MINUTE),
                  "click_minute": ("click", "1 minute", CLICKS_PER_MINUTE),
                  "click_hour": ("click", "1 hour", CLICKS_PER_HOUR)}


def rate_bursts(log: DataFrame, who: str, kind: str, gap: str, limit: int) -> DataFrame:
    """Gap-aware form: bursts whose hits follow each other within ``gap``."""
    return (log.where(F.col("event_type") == kind).groupBy(who, F.session_window("ts", gap).alias("w"))
            .agg(F.count("*").alias("n")).where(F.col("n") > limit)
            .select(who, F.col("w.start").alias("burst_start"), "n"))


