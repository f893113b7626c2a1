"""Session, search and click analytics over the event log."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from lodestone.catalog import sqlkit as S
from lodestone.catalog.registry import query
from lodestone.operators import analytics as O
from lodestone.session import shared_dir
from lodestone.sources import mapping as M
from lodestone.sources.partitions import PartitionedTable

c = F.col
UNTIL = "2024-01-28"

SESSIONS = f"""{S.EVENTS}, sessions AS (
  SELECT session_id, min(ts) AS created_at, max(ts) AS last_active, min(user_id) AS user_id, count(*) AS page_views,
    count(*) FILTER (event_type = 'view') AS search_count, count(*) FILTER (event_type = 'click') AS click_count,
    bool_or(event_type = 'signup') AS ended, max(ts) FILTER (event_type = 'signup') AS ended_at,
    CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS duration_seconds,
    arg_min(event_type, (ts, event_id)) AS first_type
  FROM ev GROUP BY session_id)"""
ARCHIVE = """archive AS (
  SELECT CAST(ended_at AS DATE) AS day, count(*) AS total_sessions, CAST(sum(duration_seconds) AS BIGINT) AS total_duration_seconds,
    CAST(sum(search_count) AS BIGINT) AS total_searches, CAST(sum(click_count) AS BIGINT) AS total_clicks,
    count(*) FILTER (user_id IS NOT NULL) AS logged_in_sessions, count(*) FILTER (user_id IS NULL) AS anonymous_sessions
  FROM sessions WHERE ended GROUP BY 1)"""
DAY = "strftime({}, '%Y-%m-%d')"


def _day(name="event_date"):
    return F.date_format(name, "yyyy-MM-dd")


def _search_log(t):
    return M.searches(t).withColumn("query_normalized", F.lower("query"))


@query("h01_session_table", f"""
WITH {SESSIONS}
SELECT session_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(last_active, '%Y-%m-%d %H:%M:%S') AS last_active,
  user_id, page_views, search_count, click_count, first_type, ended, user_id IS NOT NULL AS is_logged_in FROM sessions""")
def h01(t):
    s = O.sessions(M.events(t).withColumn("first_type", c("event_type")), ["first_type"])
    ts = "yyyy-MM-dd HH:mm:ss"
    return s.select("session_id", F.date_format("created_at", ts).alias("created_at"),
                    F.date_format("last_active", ts).alias("last_active"), "user_id", "page_views", "search_count",
                    "click_count", "first_type", "ended", "is_logged_in")


@query("h02_session_duration", f"""
WITH {SESSIONS} SELECT session_id, duration_seconds, round(duration_seconds / 60, 1) AS duration_minutes FROM sessions""")
def h02(t):
    return O.session_duration(O.sessions(M.events(t))).select("session_id", "duration_seconds", "duration_minutes")


@query("h03_session_archive", f"""
WITH {SESSIONS}, {ARCHIVE} SELECT {DAY.format('day')} AS day, * EXCLUDE (day) FROM archive""")
def h03(t):
    return O.session_archive(O.sessions(M.events(t))).withColumn("day", _day("day"))


@query("h04_user_sessions", f"""
WITH {SESSIONS}
SELECT user_id, session_id, row_number() OVER w AS rank FROM sessions
WINDOW w AS (PARTITION BY user_id ORDER BY created_at DESC, session_id)""")
def h04(t):
    return O.user_sessions(O.sessions(M.events(t))).select("user_id", "session_id", c("rank").cast("bigint").alias("rank"))


@query("h05_daily_audience", f"""
WITH {SESSIONS}, {S.PLACES}, x AS (
  SELECT {DAY.format('created_at')} AS day, first_type AS device, location_city AS city, location_country AS country
  FROM sessions LEFT JOIN places ON user_id = place_user)
SELECT day, 'all' AS dim, '' AS value, count(*) AS n FROM x GROUP BY 1
UNION ALL SELECT day, 'first_type', device, count(*) FROM x GROUP BY 1, 3
UNION ALL SELECT day, 'location_city', city, count(*) FROM x WHERE city IS NOT NULL GROUP BY 1, 3
UNION ALL SELECT day, 'location_country', country, count(*) FROM x WHERE country IS NOT NULL GROUP BY 1, 3""")
def h05(t):
    s = M.with_place(O.sessions(M.events(t).withColumn("first_type", c("event_type")), ["first_type"]), t)
    return O.daily_audience(s, ["first_type", "location_city", "location_country"]).withColumn("day", _day("day"))


@query("h06_popular_queries", f"""
WITH {S.SEARCHES}
SELECT 'days' AS span, NULL AS day, query, n FROM (SELECT query, count(*) AS n FROM searches
  WHERE event_date <= DATE '{UNTIL}' AND event_date > DATE '{UNTIL}' - 14 GROUP BY query ORDER BY n DESC, query LIMIT 10)
UNION ALL SELECT 'all', NULL, query, count(*) FROM searches GROUP BY query
UNION ALL SELECT 'daily', {DAY.format('event_date')}, query, n FROM (SELECT event_date, query, count(*) AS n FROM searches GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY event_date ORDER BY n DESC, query) <= 5""")
def h06(t):
    log = _search_log(t)
    none = F.lit(None).cast("string").alias("day")
    a = O.popular_queries(O.last_days(log, 14, UNTIL), 10).select(F.lit("days").alias("span"), none, "query", "n")
    b = O.popular_queries(log, None).select(F.lit("all").alias("span"), none, "query", "n")
    d = O.popular_queries(log, 5, ["event_date"]).select(F.lit("daily").alias("span"), _day().alias("day"), "query", "n")
    return a.unionByName(b).unionByName(d)


@query("h07_zero_result_queries", f"""
WITH {S.SEARCHES}
SELECT query, count(*) AS n FROM (SELECT * REPLACE (results_count // 10 AS results_count) FROM searches)
WHERE results_count = 0 GROUP BY query ORDER BY n DESC, query LIMIT 20""")
def h07(t):
    return O.zero_result_queries(_search_log(t).withColumn("results_count", F.floor(c("k") / 10)), 20)


@query("h08_compare_modes", f"""
WITH {S.SEARCHES}
SELECT mode, CASE mode WHEN 'y' THEN 'dropdown' ELSE 'keyword' END AS meaning, count(*) AS searches,
  CAST(sum(results_count) AS BIGINT) AS total_results, CAST(sum(floor(search_time_ms)) AS BIGINT) AS total_time_ms,
  round(sum(results_count) / count(*), 2) AS avg_results, round(sum(floor(search_time_ms)) / count(*), 2) AS avg_time_ms
FROM searches WHERE event_date <= DATE '{UNTIL}' AND event_date > DATE '{UNTIL}' - 7 GROUP BY mode""")
def h08(t):
    return O.compare_modes(O.last_days(_search_log(t), 7, UNTIL))


@query("h09_location_stats", f"""
WITH {S.SEARCHES}, {S.PLACES}, x AS (SELECT s.*, p.* FROM searches s LEFT JOIN places p ON user_id = place_user),
u AS (SELECT 'country' AS level, location_country AS place, count(*) AS n FROM x WHERE location_country IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'city', location_city, count(*) FROM x WHERE location_city IS NOT NULL GROUP BY 2)
SELECT level, place, n, row_number() OVER w AS rank FROM u WINDOW w AS (PARTITION BY level ORDER BY n DESC, place)
QUALIFY row_number() OVER w <= CASE level WHEN 'country' THEN 20 ELSE 50 END""")
def h09(t):
    return O.location_stats(M.with_place(_search_log(t), t)).withColumn("rank", c("rank").cast("bigint"))


@query("h10_volume_by", f"""
WITH {S.SEARCHES}
SELECT 'intent' AS dim, mode AS value, count(*) AS n FROM searches GROUP BY 2
UNION ALL SELECT 'hour', strftime(ts, '%Y-%m-%d %H'), count(*) FROM searches GROUP BY 2
UNION ALL SELECT 'user_type', CASE WHEN user_id % 3 = 0 THEN 'anonymous' ELSE 'logged_in' END, count(*) FROM searches GROUP BY 2""")
def h10(t):
    return O.volume_by(_search_log(t), {
        "intent": c("mode"), "hour": F.date_format("ts", "yyyy-MM-dd HH"),
        "user_type": F.when(c("user_id") % 3 == 0, "anonymous").otherwise("logged_in")})


@query("h11_strategy_stats", f"""
WITH {S.EVENTS}
SELECT event_type AS strategy, count(*) AS count, CAST(sum(k) AS BIGINT) AS total_results, round(sum(k) / count(*), 2) AS avg_results
FROM ev GROUP BY 1""")
def h11(t):
    log = M.events(t).select(c("event_type").alias("strategy"), c("k").alias("results_count"))
    return O.strategy_stats(log, "strategy")


@query("h12_user_history", f"""
WITH {S.SEARCHES}
SELECT user_id, event_id, query, row_number() OVER w AS rank FROM searches
WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)""")
def h12(t):
    return O.user_history(_search_log(t)).select("user_id", "event_id", "query", c("rank").cast("bigint").alias("rank"))


@query("h13_click_popularity", f"""
WITH {S.EVENTS}, {S.CLICKS}
SELECT {DAY.format('event_date')} AS event_date, dim, value, n FROM (
  SELECT event_date, 'clicked_url' AS dim, clicked_url AS value, count(*) AS n FROM clicks GROUP BY 1, 3
  UNION ALL SELECT event_date, 'doc_key', CAST(doc_key AS VARCHAR), count(*) FROM clicks GROUP BY 1, 3
  UNION ALL SELECT NULL, 'clicked_url', clicked_url, count(*) FROM clicks GROUP BY 3
  UNION ALL SELECT NULL, 'doc_key', CAST(doc_key AS VARCHAR), count(*) FROM clicks GROUP BY 3)""")
def h13(t):
    return O.click_popularity(M.clicks(t), ["clicked_url", "doc_key"]).withColumn("event_date", _day())


@query("h14_position_distribution", f"""
WITH {S.EVENTS}, {S.CLICKS}
SELECT CAST(least(clicked_position * 2, 100) AS BIGINT) AS position, count(*) AS n FROM clicks GROUP BY 1""")
def h14(t):
    return O.position_distribution(M.clicks(t).withColumn("clicked_position", (c("k") * 2).cast("bigint")))


@query("h15_query_clicks", f"""
WITH {S.EVENTS}, {S.CLICKS} SELECT query AS query_normalized, clicked_url, count(*) AS n FROM clicks GROUP BY 1, 2""")
def h15(t):
    return O.query_clicks(M.clicks(t).withColumn("query_normalized", F.lower("query")))


@query("h16_time_to_click", f"""
WITH {S.EVENTS}, {S.CLICKS}
SELECT {DAY.format('event_date')} AS event_date, CASE WHEN time_to_click_ms < 2000 THEN 'instant' WHEN time_to_click_ms < 5000 THEN 'fast'
  WHEN time_to_click_ms < 15000 THEN 'normal' WHEN time_to_click_ms < 30000 THEN 'slow' ELSE 'very_slow' END AS bucket, count(*) AS n
FROM clicks WHERE time_to_click_ms > 0 GROUP BY 1, 2""")
def h16(t):
    return O.time_to_click(M.clicks(t)).withColumn("event_date", _day())


@query("h17_clicks_by", f"""
WITH {S.EVENTS}, {S.CLICKS}, {S.PLACES}
SELECT {DAY.format('event_date')} AS event_date, location_city, k % 4 = 0 AS was_corrected, count(*) AS n
FROM clicks LEFT JOIN places ON user_id = place_user GROUP BY 1, 2, 3""")
def h17(t):
    d = M.with_place(M.clicks(t), t).withColumn("was_corrected", c("k") % 4 == 0)
    return O.count_by(d, "location_city", "was_corrected").withColumn("event_date", _day())


@query("h18_event_counts", f"""
WITH {S.EVENTS}, {S.PLACES}
SELECT {DAY.format('event_date')} AS event_date, event_type, location_country, count(*) AS n
FROM ev LEFT JOIN places ON user_id = place_user GROUP BY 1, 2, 3""")
def h18(t):
    return O.count_by(M.with_place(M.events(t), t), "event_type", "location_country").withColumn("event_date", _day())


@query("h19_daily_stats", f"""
WITH {SESSIONS}, {ARCHIVE}
SELECT {DAY.format('day')} AS day, total_sessions AS sessions, total_searches AS searches, total_clicks AS clicks,
  round(total_duration_seconds / total_sessions, 1) AS avg_session_duration_seconds,
  round(total_searches / total_sessions, 2) AS searches_per_session,
  CASE WHEN total_searches > 0 THEN round(total_clicks / total_searches, 3) ELSE 0 END AS click_through_rate,
  logged_in_sessions, anonymous_sessions FROM archive""")
def h19(t):
    return O.daily_stats(O.sessions(M.events(t))).withColumn("day", _day("day"))


@query("h20_session_stats", f"""
WITH {S.EVENTS}
SELECT session_id, count(*) FILTER (event_type = 'view') AS search_count, count(*) FILTER (event_type = 'click') AS click_count,
  count(*) FILTER (event_type NOT IN ('view', 'click')) AS event_count,
  count(DISTINCT k % 25) FILTER (event_type = 'view') AS unique_queries,
  CASE WHEN count(*) FILTER (event_type = 'view') > 0 THEN round(count(*) FILTER (event_type = 'click') / count(*) FILTER (event_type = 'view'), 3)
    ELSE 0 END AS click_through_rate,
  round((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 60, 1) AS duration_minutes FROM ev GROUP BY 1""")
def h20(t):
    return O.session_stats(M.events(t).withColumn("query_normalized", F.concat(F.lit("query "), (c("k") % 25))))


@query("h21_session_timeline", f"""
WITH {S.EVENTS}, x AS (SELECT user_id AS sid, event_id, ts, CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'click' ELSE 'event' END AS kind FROM ev)
SELECT sid AS session_id, kind, event_id, row_number() OVER w AS rank FROM x
WINDOW w AS (PARTITION BY sid, kind ORDER BY ts DESC, event_id DESC)
QUALIFY row_number() OVER w <= CASE kind WHEN 'event' THEN 1000 ELSE 500 END""")
def h21(t):
    log = M.events(t).withColumn("session_id", c("user_id"))
    return O.session_timeline(log).select("session_id", "kind", "event_id", c("rank").cast("bigint").alias("rank"))


@query("h22_user_stats", f"""
WITH {S.EVENTS}, u AS (
  SELECT user_id, count(DISTINCT session_id) AS s, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS k
  FROM ev GROUP BY 1)
SELECT user_id, 'totals' AS part, CAST(NULL AS VARCHAR) AS query, s AS a, v AS b, k AS d, CASE WHEN v > 0 THEN round(k / v, 3) ELSE 0 END AS ctr FROM u
UNION ALL SELECT user_id, 'top', query, n, row_number() OVER w, NULL, NULL FROM (
  SELECT user_id, 'query ' || (k % 25) AS query, count(*) AS n FROM ev WHERE event_type = 'view' GROUP BY 1, 2)
WINDOW w AS (PARTITION BY user_id ORDER BY n DESC, query) QUALIFY row_number() OVER w <= 20""")
def h22(t):
    u, q = O.user_stats(M.events(t).withColumn("query", F.concat(F.lit("query "), (c("k") % 25))))
    a = u.select("user_id", F.lit("totals").alias("part"), F.lit(None).cast("string").alias("query"),
                 c("total_sessions").alias("a"), c("total_searches").alias("b"), c("total_clicks").alias("d"),
                 c("click_through_rate").alias("ctr"))
    b = q.select("user_id", F.lit("top").alias("part"), "query", c("n").alias("a"), c("rank").cast("bigint").alias("b"),
                 F.lit(None).cast("bigint").alias("d"), F.lit(None).cast("double").alias("ctr"))
    return a.unionByName(b)


_RECENT = f"""
WITH {S.EVENTS} SELECT event_id, {DAY.format('event_date')} AS event_date FROM ev WHERE event_date >= DATE '{UNTIL}' - 14"""


@query("h23_retention", _RECENT)
def h23(t):
    return O.retain(M.events(t), 14, UNTIL).select("event_id", _day().alias("event_date"))


# a stored log by day: days before the retention are dropped, no row of them is read
@query("h23_retention_stored", _RECENT)
def h23_stored(t):
    log = M.events(t).select("event_id", "user_id", "event_type", "event_date")
    table = PartitionedTable.create(log, f"{shared_dir(t.spark)}/sources/log-{uuid.uuid4().hex}", "event_date")
    table.retain(datetime.date.fromisoformat(UNTIL) - datetime.timedelta(days=14))
    return table.read().select("event_id", _day().alias("event_date"))


@query("h24_bot_flags", f"""
WITH {S.EVENTS}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1)
SELECT event_id, CASE WHEN value > 0 AND value < 5 THEN 'Typing too fast' WHEN n > 70 THEN 'Excessive requests in session'
  WHEN k % 10 = 0 THEN 'Bot user agent' END AS bot_reason FROM ev JOIN n USING (user_id)""")
def h24(t):
    log = M.events(t).select("event_id", c("user_id").alias("session_id"), c("value").alias("typing_ms"),
                             F.when(c("k") % 10 == 0, "Googlebot/2.1").otherwise("Mozilla/5.0 Firefox/1").alias("user_agent"))
    return O.flag_bots(log, max_requests=70, min_typing_ms=5).select("event_id", "bot_reason")


# nonces repeat within a user; the SQL walks each (user, nonce) chain
@query("h25_replay_flags", f"""
WITH RECURSIVE {S.EVENTS}, x AS (
  SELECT event_id, k, user_id AS sid, user_id % 3 || 'nonce' AS nonce, ts, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM ev),
firsts AS (SELECT sid, nonce, sec, min((ts, event_id))[2] AS eid FROM x GROUP BY 1, 2, 3),
chain AS (SELECT sid, nonce, min(sec) AS sec FROM x GROUP BY 1, 2
  UNION ALL SELECT c.sid, c.nonce, (SELECT min(x.sec) FROM firsts x WHERE x.sid = c.sid AND x.nonce = c.nonce AND x.sec >= c.sec + 60)
  FROM chain c WHERE c.sec IS NOT NULL),
fresh AS (SELECT f.eid FROM firsts f JOIN chain c ON f.sid = c.sid AND f.nonce = c.nonce AND f.sec = c.sec)
SELECT event_id, CASE WHEN k - 10 < 0 AND (k - 10) * 10 < -60 THEN 'Timestamp is in the future' WHEN (k - 10) * 10 > 300 THEN 'Request too old'
  WHEN eid IS NULL THEN 'Nonce already used' END AS replay_reason FROM x LEFT JOIN fresh ON event_id = eid""")
def h25(t):
    log = M.events(t).select("event_id", "ts", c("user_id").alias("session_id"),
                             F.concat((c("user_id") % 3).cast("string"), F.lit("nonce")).alias("nonce"),
                             F.timestamp_seconds(F.unix_timestamp("ts") - (c("k") - 10) * 10).alias("client_ts"))
    return O.flag_replays(log).select("event_id", "replay_reason")


@query("h26_rate_violations", f"""
WITH {S.EVENTS}
SELECT user_id, 'view_hour' AS rule, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, count(*) AS n
FROM ev WHERE event_type = 'view' GROUP BY 1, 3 HAVING count(*) > 1
UNION ALL SELECT user_id, 'click_day', strftime(CAST(ts AS DATE), '%Y-%m-%d %H:%M'), count(*)
FROM ev WHERE event_type = 'click' GROUP BY 1, 3 HAVING count(*) > 2
UNION ALL SELECT user_id, 'burst', strftime(min(ts), '%Y-%m-%d %H:%M'), count(*) FROM (
  SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM (
    SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk
    FROM ev WHERE event_type = 'view')) GROUP BY user_id, grp HAVING count(*) > 2""")
def h26(t):
    log = M.events(t)
    ts = "yyyy-MM-dd HH:mm"
    v = O.rate_violations(log, "user_id", {"view_hour": ("view", "1 hour", 1), "click_day": ("click", "1 day", 2)})
    b = O.rate_bursts(log, "user_id", "view", "6 hours", 2)
    return (v.withColumn("window_start", F.date_format("window_start", ts))
            .unionByName(b.select("user_id", F.lit("burst").alias("rule"), F.date_format("burst_start", ts).alias("window_start"), "n")))
