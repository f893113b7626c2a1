"""Trending, rank feedback, related searches; streams replayed from the event files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import sqlkit as S
from lodestone.catalog.registry import query
from lodestone.catalog.section_h import DAY
from lodestone.functions import text as X
from lodestone.operators import feedback as O
from lodestone.plans import jobs as J
from lodestone.sources import mapping as M
from lodestone.streaming import streams as ST

c = F.col
_CL = f"""{S.EVENTS}, {S.CLICKS}, {S.PLACES}, cl AS (SELECT clicks.*, location_city, location_country, substring(md5(query), 1, 12) AS qh FROM clicks LEFT JOIN places ON user_id = place_user)"""
_TR = f"""{_CL}, lv AS (SELECT session_id, qh, doc_key, ts, 0 AS level, location_city AS place FROM cl WHERE location_city IS NOT NULL
  UNION ALL SELECT session_id, qh, doc_key, ts, 1, location_country FROM cl WHERE location_country IS NOT NULL UNION ALL SELECT session_id, qh, doc_key, ts, 2, 'general' FROM cl),
tr AS (SELECT level, place, qh AS query_hash, doc_key, count(DISTINCT session_id) AS score, max(ts) AS last_write FROM lv GROUP BY 1, 2, 3, 4)"""
LEVELS = ["location_city", "location_country"]


def _clicks(t):
    return M.with_place(M.clicks(t), t)


def _b(df, *cols):
    return df.withColumns({x: c(x).cast("bigint") for x in cols})


@query("i01_trending", f"""WITH {_TR} SELECT level, place, query_hash, doc_key, score FROM tr""")
def i01(t):
    return _b(O.trending(_clicks(t), LEVELS).drop("last_write"), "level", "doc_key")


@query("i01_trending_session_scope", f"""
WITH {_CL}, lv AS (SELECT session_id, qh, doc_key, CASE WHEN location_city IS NOT NULL THEN 0 ELSE 2 END AS level, coalesce(location_city, 'general') AS place FROM cl
  UNION SELECT session_id, qh, doc_key, 2, 'general' FROM cl)
SELECT level, place, qh AS query_hash, doc_key, count(DISTINCT session_id) AS score FROM lv GROUP BY 1, 2, 3, 4""")
def i01_session(t):
    return _b(O.trending(_clicks(t), LEVELS, dedupe_scope="session").drop("last_write"), "level", "doc_key")


_TOP = """o AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY level, place, doc_key ORDER BY score DESC, query_hash) = 1),
top AS (SELECT level, place, doc_key, score, row_number() OVER (PARTITION BY level, place ORDER BY score DESC, query_hash, doc_key) AS rank FROM o QUALIFY rank <= 10)"""


# customers look at their nation's list; those of even nations live where nothing is listed
@query("i02_trending_top", f"""
WITH {_TR}, {_TOP}, v AS (SELECT c_custkey AS visitor, CASE WHEN c_nationkey % 2 = 0 THEN 'NOWHERE' ELSE n_name END AS place FROM customer JOIN nation ON c_nationkey = n_nationkey),
w AS (SELECT visitor, CASE WHEN place IN (SELECT place FROM top) THEN place ELSE 'general' END AS place FROM v)
SELECT visitor, w.place, doc_key, score, rank FROM w JOIN top ON w.place = top.place""")
def i02(t):
    top = O.trending_top(O.trending(_clicks(t), LEVELS), 10)
    v = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).select(
        c("c_custkey").alias("visitor"), F.when(c("c_nationkey") % 2 == 0, "NOWHERE").otherwise(c("n_name")).alias("place"))
    return _b(O.trending_for(v, top), "doc_key", "rank")


@query("i03_result_record", f"""
WITH {S.PAGES} SELECT page_id, title AS r_title, url AS r_url, coalesce(image_url[1], '') AS r_image, host AS r_brand, lang AS r_category, md5(url) AS r_id FROM pg""")
def i03(t):
    return O.result_record(M.page_fields(t)).select("page_id", "r_title", "r_url", "r_image", "r_brand", "r_category", "r_id")


@query("i04_trending_expiry", f"""
WITH {_TR}, al AS (SELECT level, place FROM tr GROUP BY 1, 2 HAVING epoch((SELECT max(ts) FROM cl)) - epoch(max(last_write)) <= 7200)
SELECT level, place, query_hash, doc_key, score FROM tr JOIN al USING (level, place)""")
def i04(t):
    return _b(O.trending(_clicks(t), LEVELS, ttl_seconds=7200).drop("last_write"), "level", "doc_key")


_CHAIN = """chain AS (SELECT sid, key, min(sec) AS sec FROM x GROUP BY 1, 2
  UNION ALL SELECT c.sid, c.key, (SELECT min(x.sec) FROM x WHERE x.sid = c.sid AND x.key = c.key AND x.sec >= c.sec + 86400) FROM chain c WHERE c.sec IS NOT NULL),
add AS (SELECT key, count(*) AS n, max(sec) AS last FROM chain WHERE sec IS NOT NULL GROUP BY 1)"""


# a click goes to the terms whose hash has the four digits of its number; the session is the user
@query("i05_bump_term_ranks", f"""
WITH RECURSIVE {S.EVENTS}, {S.CLICKS}, {S.VOCAB},
x AS (SELECT user_id % 10 AS sid, term AS key, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM clicks JOIN vocab ON substring(md5(term), 1, 3) = printf('%03x', event_id % 512)), {_CHAIN}
SELECT term, rank + coalesce(n, 0) * 10000 AS rank, last AS last_clicked_at FROM vocab LEFT JOIN add ON term = key""")
def i05(t):
    v = M.vocabulary(t)
    digits = F.lower(F.lpad(F.hex(c("event_id") % 512), 3, "0"))
    # term by term, so that the clicks of one follow each other
    clicks = (v.select("term", F.substring(F.md5("term"), 1, 3).alias("digits"))
              .join(M.clicks(t).select((c("user_id") % 10).alias("session_id"), "ts", digits.alias("digits")), "digits"))
    return O.bump_term_ranks(v, clicks).select("term", "rank", "last_clicked_at")


@query("i06_bump_question_scores", f"""
WITH RECURSIVE {S.EVENTS}, {S.CLICKS}, x AS (SELECT user_id % 10 AS sid, k AS key, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM clicks), {_CHAIN}
SELECT item_id AS question_key, length(text) + coalesce(n, 0) * 100 AS question_score, last AS last_clicked_at FROM benchmark LEFT JOIN add ON item_id = key""")
def i06(t):
    clicks = M.clicks(t).select((c("user_id") % 10).alias("session_id"), c("k").cast("bigint").alias("question_key"), "ts")
    return O.bump_question_scores(M.scored_questions(t), clicks).select("question_key", "question_score", "last_clicked_at")


# the store holds the first half of the month, the log the second
_H = f"substring(md5({S.normalize_query('query')}), 1, 16)"
_HALF = """SELECT {h} AS query_hash, min(query) AS query, count(*) AS n, CAST(max(results_count) AS BIGINT) AS r, CAST(min(floor(epoch(ts))) AS BIGINT) AS f, CAST(max(floor(epoch(ts))) AS BIGINT) AS l
  FROM searches WHERE event_date {op} DATE '2024-01-15' GROUP BY 1"""
_STORE = f"""{S.SEARCHES}, a AS ({_HALF.format(h=_H, op='<')}), b AS ({_HALF.format(h=_H, op='>=')}),
m AS (SELECT coalesce(a.query_hash, b.query_hash) AS query_hash, coalesce(a.query, b.query) AS query, coalesce(a.n, 0) + coalesce(b.n, 0) AS search_count,
  greatest(coalesce(a.r, 0), coalesce(b.r, 0)) AS result_count, coalesce(a.f, b.f) AS created,
  least(greatest(coalesce(least(a.l + 86400, a.f + 604800), 0), coalesce(b.l + 86400, 0)), coalesce(a.f, b.f) + 604800) AS expires FROM a FULL JOIN b ON a.query_hash = b.query_hash)"""


def _halves(t):
    s = M.searches(t).select("query", c("results_count").cast("bigint").alias("results_count"), "ts", "event_date")
    empty = t.spark.createDataFrame([], "query_hash string, query string, search_count bigint, result_count bigint, created bigint, expires bigint")
    return O.store_queries(empty, s.where(c("event_date") < "2024-01-15")), s.where(c("event_date") >= "2024-01-15")


@query("i07_store_queries", f"WITH {_STORE} SELECT query_hash, query, search_count, result_count, created, expires FROM m")
def i07(t):
    return O.store_queries(*_halves(t))


_N = S.normalize_query("query")


@query("i08_eligible", f"""
WITH {S.QLOG} SELECT query_id FROM qlog LEFT JOIN embeddings ON vec_id = session_id
WHERE length({_N}) >= 3 AND len(string_split({_N}, ' ')) >= 2 AND NOT ({' OR '.join(f"contains({_N}, '{w}')" for w in O.TIME_WORDS)}) AND len(embedding) = 64""")
def i08(t):
    q = M.query_log(t).join(t.embeddings.select(c("vec_id").alias("session_id"), "embedding"), "session_id", "left")
    return O.eligible(q, vector="embedding", width=64).select("query_id")


def _turn_store(t):
    """Every document as a stored query: created at its number."""
    return t.documents.select(F.md5("text").alias("query_hash"), c("n_chars").alias("created")).groupBy("query_hash").agg(F.max("created").alias("created"))


@query("i09_cap_store", """
WITH s AS (SELECT md5(text) AS query_hash, max(n_chars) AS created FROM documents GROUP BY 1)
SELECT query_hash, created, NOT ((SELECT count(*) FROM s) <= 500 OR row_number() OVER (ORDER BY created DESC, query_hash) <= 400) AS removed FROM s""")
def i09(t):
    return O.cap_store(_turn_store(t), 500, 100)


# the similarity band of the fixture vectors lies lower than that of real ones
@query("i10_related_searches", f"""
WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS h, embedding AS e FROM embeddings), p AS (SELECT a.h AS query_hash, b.h AS related_hash, {S.dist('a.e', 'b.e')} AS d
  FROM v a JOIN v b ON a.h <> b.h WHERE CAST(b.h AS INT) % 9 <> 0)
SELECT query_hash, related_hash, round(1 - d, 6) AS similarity, row_number() OVER (PARTITION BY query_hash ORDER BY d, related_hash) AS rank FROM p
WHERE 1 - d BETWEEN 0.15 AND 0.92 QUALIFY rank <= 5""")
def i10(t):
    v = t.embeddings.select(c("vec_id").cast("string").alias("query_hash"), "embedding", F.when(c("vec_id") % 9 == 0, 0).otherwise(1).alias("result_count"))
    r = O.related_searches(v, v, lo=0.15)
    return _b(r.withColumn("similarity", F.round("similarity", 6)), "rank")


@query("i11_popular_stored", f"""
WITH {_STORE} SELECT 'top' AS part, query_hash AS name, search_count AS n FROM (SELECT * FROM m WHERE result_count > 0 ORDER BY search_count DESC, query_hash LIMIT 10)
UNION ALL SELECT 'total', 'total', count(*) FROM m UNION ALL SELECT 'total', 'with_results', count(*) FROM m WHERE result_count > 0
UNION ALL SELECT 'total', 'without_results', count(*) FROM m WHERE result_count = 0 UNION ALL SELECT 'total', 'searches', CAST(sum(search_count) AS BIGINT) FROM m""")
def i11(t):
    s = O.store_queries(*_halves(t))
    tot = O.store_totals(s)
    e = F.array(*[F.struct(F.lit(x).alias("name"), c(x).alias("n")) for x in ("total", "with_results", "without_results", "searches")])
    return (O.popular_stored(s, 10).select(F.lit("top").alias("part"), c("query_hash").alias("name"), c("search_count").alias("n"))
            .unionByName(tot.select(F.lit("total").alias("part"), F.explode(e).alias("e")).select("part", "e.name", "e.n")))


@query("i12_clean_store", f"WITH {_STORE} SELECT query_hash FROM m WHERE result_count > 0 AND created >= 1704689800 - 168 * 3600")
def i12(t):
    return O.clean_store(O.store_queries(*_halves(t)), F.lit(1704689800)).select("query_hash")


@query("i13_seed_store", f"""
WITH {S.QLOG}, q AS (SELECT {_H} AS query_hash, min(query) AS query, count(*) AS n, min(session_id) AS sid FROM qlog GROUP BY 1),
p AS (SELECT *,  length({_N}) < 3 OR len(string_split({_N}, ' ')) < 2 OR {' OR '.join(f"contains({_N}, '{w}')" for w in O.TIME_WORDS)} OR length(query) % 10 = 0 AS skip FROM q),
o AS (SELECT query_hash, n, CASE WHEN skip THEN 'skipped' WHEN sid % 5 = 0 THEN 'failed' ELSE 'stored' END AS outcome FROM p
  QUALIFY skip OR row_number() OVER (PARTITION BY skip ORDER BY n DESC, query_hash) <= 300)
SELECT 'row' AS part, query_hash AS name, n FROM o WHERE outcome = 'stored' UNION ALL SELECT 'count', outcome, count(*) FROM o GROUP BY 2""")
def i13(t):
    log = M.query_log(t).withColumn("results_count", F.lit(1))
    g = log.groupBy(X.store_hash(c("query")).alias("query_hash")).agg(F.min("query").alias("q"), F.min("session_id").alias("sid"))
    store = g.where(F.length("q") % 10 == 0).select("query_hash")
    vec = g.where(c("sid") % 5 != 0).select("query_hash", F.array(F.lit(0.5), F.lit(0.5)).alias("embedding"))
    rows, counts = O.seed_store(log, store, vec, 300, width=2)
    return (rows.select(F.lit("row").alias("part"), c("query_hash").alias("name"), c("search_count").alias("n"))
            .unionByName(counts.select(F.lit("count").alias("part"), c("outcome").alias("name"), "n")))


# ---- streams: the event files replayed, results equal to the batch statement ----------------

@query("i14_stream_counters", f"""
WITH {S.EVENTS}, {S.SEARCHES.split(', searches', 1)[1].join(['searches', ''])}, x AS (SELECT event_date, 'event_type' AS dim, event_type AS value FROM ev
  UNION ALL SELECT event_date, 'mode', mode FROM searches UNION ALL SELECT event_date, 'query', query FROM searches)
SELECT {DAY.format('event_date')} AS day, dim, value, count(*) AS n FROM x GROUP BY 1, 2, 3""")
def i14(t):
    return ST.replay_counters(t).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "dim", "value", "n")


# closed by a silence of six hours or by a sign-up; what is still open when the watermark (an hour behind) stops is not emitted
@query("i15_stream_sessions", f"""
WITH {S.EVENTS}, b AS (SELECT user_id, ts, event_id, event_type, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR AND lag(event_type) OVER w <> 'signup' THEN 0 ELSE 1 END AS brk
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM b),
s AS (SELECT user_id, grp, min(ts) AS started, max(ts) AS last, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, bool_or(event_type = 'signup') AS ended FROM g GROUP BY 1, 2)
SELECT user_id, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, n, clicks, ended FROM s
WHERE ended OR grp < (SELECT max(grp) FROM s z WHERE z.user_id = s.user_id) OR epoch_ms(last) + 6 * 3600000 < epoch_ms((SELECT max(ts) FROM ev)) - 3600000""")
def i15(t):
    return ST.replay_sessions(t, 6 * 3600, "signup").select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n", "clicks", "ended")


@query("i16_stream_dedupe", f"""
WITH RECURSIVE {S.EVENTS}, x AS (SELECT user_id AS sid, event_type AS key, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM ev), {_CHAIN}
SELECT sid AS user_id, key AS event_type, sec AS accepted FROM chain WHERE sec IS NOT NULL""")
def i16(t):
    return ST.replay_dedupe(t).select("user_id", "event_type", "accepted")


@query("i17_stream_rate", f"""
WITH {S.EVENTS} SELECT user_id, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, count(*) AS n FROM ev GROUP BY 1, 2 HAVING count(*) > 1""")
def i17(t):
    return ST.replay_rate(t, "1 hour", 1).select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n")


@query("j05_home_dataset", f"""
WITH {_TR}, {S.PAGES}, ut AS (SELECT user_id AS visitor, location_city, location_country FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN places ON user_id = place_user),
v AS (SELECT visitor, level, query_hash || ':' || doc_key AS item, score FROM ut JOIN tr ON (level = 0 AND place = location_city AND visitor % 3 <> 0) OR (level = 1 AND place = location_country AND visitor % 3 <> 1) OR level = 2),
b AS (SELECT *, min(level) OVER (PARTITION BY visitor) AS best FROM v),
f AS (SELECT CAST(page_id AS VARCHAR) AS item, row_number() OVER (ORDER BY md5('2024-01-31|news|' || page_id), page_id) AS rank FROM pg QUALIFY rank <= 8)
SELECT 'trending' AS part, CAST(visitor AS VARCHAR) AS visitor, item, row_number() OVER (PARTITION BY visitor ORDER BY score DESC, item) AS rank FROM b WHERE level = best QUALIFY rank <= 10
UNION ALL SELECT 'news', '', item, rank FROM f""")
def j05(t):
    from pyspark.sql import Window as W
    tr = O.trending(_clicks(t), LEVELS).select("level", "place", F.concat_ws(":", "query_hash", "doc_key").alias("item"), "score")
    u = M.with_place(t.events.select("user_id").distinct(), t)
    lv = F.array(F.struct(F.lit(0).alias("level"), F.when(c("user_id") % 3 != 0, c("location_city")).alias("place")),
                 F.struct(F.lit(1).alias("level"), F.when(c("user_id") % 3 != 1, c("location_country")).alias("place")),
                 F.struct(F.lit(2).alias("level"), F.lit("general").alias("place")))
    v = u.select(c("user_id").alias("visitor"), F.explode(lv).alias("e")).select("visitor", "e.level", "e.place").where(c("place").isNotNull())
    # a place offers at most ten rows, so a visitor never meets a whole list
    best = O.top_k(tr, ["level", "place"], [F.desc("score"), F.asc("item")], 10)
    s = O.daily_sample(M.page_fields(t), "page_id", "2024-01-31", "news", 8)
    feeds = s.select(F.lit("news").alias("feed"), c("page_id").cast("string").alias("item"),
                     F.row_number().over(W.orderBy("shuffle_key", "page_id")).alias("rank"))
    return _b(J.home_dataset(v.join(best, ["level", "place"]), feeds), "rank")
