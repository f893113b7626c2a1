"""Cleaning and normalising jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import sqlkit as S
from lodestone.catalog.registry import query
from lodestone.functions import text as X
from lodestone.operators import enrich
from lodestone.rules import fixed as R
from lodestone.sources import mapping as M

c = F.col


@query("b01_sanitize_query", f"""
SELECT conv_id, turn, {S.sanitize_query('text')} AS query FROM conversations""")
def b01(t):
    return t.conversations.select("conv_id", "turn", X.sanitize_query(c("text")).alias("query"))


# brackets and quotes are put around the values so that the rule has work to do
@query("b02_sanitize_filter_value", rf"""
SELECT doc_id, regexp_replace(substring({S.strip("' [' || source || ':=' || lang || '] ' || text")}, 1, 200),
  '[&|!=<>:;\[\]{{}}()''"\\]', '', 'g') AS filter_value FROM documents""")
def b02(t):
    return t.documents.select("doc_id", X.sanitize_filter_value(
        F.concat(F.lit(" ["), "source", F.lit(":="), "lang", F.lit("] "), "text")).alias("filter_value"))


@query("b03_sanitize_url", rf"""
SELECT page_id, CASE WHEN u LIKE 'http://%' OR u LIKE 'https://%' THEN u ELSE '' END AS url, ok FROM (
  SELECT page_id, regexp_replace(substring({S.strip('v')}, 1, 2000), '{S.CONTROL}', '', 'g') AS u, ok FROM (
    SELECT page_id, ' ' || url || chr(10) AS v, true AS ok FROM pages
    UNION ALL SELECT page_id, 'ftp' || url, false FROM pages))""")
def b03(t):
    v = t.pages.select("page_id", F.concat(F.lit(" "), "url", F.lit("\n")).alias("v"), F.lit(True).alias("ok"))
    v = v.unionAll(t.pages.select("page_id", F.concat(F.lit("ftp"), "url"), F.lit(False)))
    return v.select("page_id", X.sanitize_url(c("v")).alias("url"), "ok")


@query("b04_sanitize_string_int", rf"""
SELECT event_id, substring({S.strip("' ' || props || ' '")}, 1, 8) AS s8,
  coalesce(least(greatest(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 10), 50), 7) AS k_clamped,
  coalesce(TRY_CAST(event_type AS BIGINT), 7) AS k_default FROM events""")
def b04(t):
    return M.events(t).select(
        "event_id", X.sanitize_string(F.concat(F.lit(" "), "props", F.lit(" ")), 8).alias("s8"),
        X.sanitize_int(F.get_json_object("props", "$.k"), 7, 10, 50).alias("k_clamped"),
        X.sanitize_int(c("event_type"), 7).alias("k_default"))


@query("b05_validate_request", f"""
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN k * 20 - 100 < 1 THEN 1 ELSE least(k * 20 - 100, 1000) END AS page,
  CASE WHEN k * 2 - 20 < 1 THEN 20 ELSE least(k * 2 - 20, 100) END AS per_page,
  CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'authority' END AS sort,
  CASE WHEN k % 3 = 0 THEN 'article' ELSE '' END AS data_type,
  CASE WHEN k % 3 = 0 THEN 'Recipe' ELSE '' END AS schema_name FROM e""")
def b05(t):
    e = M.events(t)
    dt = F.when(c("k") % 3 == 0, " ARTICLE ").otherwise(c("event_type"))
    sc = F.when(c("k") % 3 == 0, " Recipe").otherwise(c("event_type"))
    return e.select(
        "event_id", X.validate_page(c("k") * 20 - 100).alias("page"),
        X.validate_per_page(c("k") * 2 - 20).alias("per_page"),
        X.validate_choice(F.upper("event_type"), ["view", "click"], "authority").alias("sort"),
        X.validate_choice(dt, R.VALID_DATA_TYPES).alias("data_type"),
        X.validate_choice(sc, R.VALID_SCHEMAS, lower=False).alias("schema_name"))


_ALIASES = list(R.CITY_ALIASES)


# customers typed a city: alias, supported name in odd case, or their nation
@query("b06_normalize_city", f"""
WITH a(i, alias, name) AS ({S.values([(i, k, v) for i, (k, v) in enumerate(R.CITY_ALIASES.items())])}),
     s(i, name) AS ({S.values(list(enumerate(R.SUPPORTED_CITIES)))})
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN a.name WHEN c_custkey % 3 = 1 THEN s.name ELSE 'Atlanta' END AS city
FROM customer LEFT JOIN a ON c_custkey % {len(_ALIASES)} = a.i LEFT JOIN s ON c_custkey % {len(R.SUPPORTED_CITIES)} = s.i""")
def b06(t):
    alias = F.array(*[F.lit(a.upper()) for a in _ALIASES])
    name = F.array(*[F.lit(n.lower()) for n in R.SUPPORTED_CITIES])
    cu = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey"))
    typed = (F.when(c("c_custkey") % 3 == 0, F.get(alias, (c("c_custkey") % len(_ALIASES)).cast("int")))
             .when(c("c_custkey") % 3 == 1,
                   F.concat(F.lit(" "), F.get(name, (c("c_custkey") % len(R.SUPPORTED_CITIES)).cast("int"))))
             .otherwise(c("n_name")))
    return cu.select("c_custkey", X.normalize_city(typed).alias("city"))


@query("b07_normalize_query", f"""
SELECT conv_id, turn, substring({S.normalize_query('text')}, 1, {R.MAX_QUERY_LENGTH}) AS query_normalized FROM conversations""")
def b07(t):
    return t.conversations.select("conv_id", "turn", X.normalize_query(c("text"), cap=R.MAX_QUERY_LENGTH).alias("query_normalized"))


@query("b08_query_hashes", f"""
WITH {S.QLOG}
SELECT query_id, substring(md5({S.strip('lower(query)')}), 1, 12) AS hash12,
  substring(md5({S.normalize_query('query')}), 1, 16) AS hash16,
  md5('final|' || session_id || '|' || lower({S.strip('query')})) AS cache_key,
  'page:' || md5(query || ':' || session_id) AS page_key FROM qlog""")
def b08(t):
    return M.query_log(t).select(
        "query_id", X.trending_hash(c("query")).alias("hash12"), X.store_hash(c("query")).alias("hash16"),
        X.result_cache_key(c("session_id"), c("query")).alias("cache_key"),
        X.joined_cache_key("page", c("query"), c("session_id")).alias("page_key"))


@query("b09_question_slug", rf"""
SELECT item_id, 'questions:' || regexp_replace({S.strip(r"regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g')")}, '\s+', '_', 'g')
  AS question_key FROM benchmark""")
def b09(t):
    return t.benchmark.select("item_id", X.question_slug(c("text")).alias("question_key"))


@query("b10_match_tokens", f"""
SELECT doc_id, array_to_string({S.token_set('text')}, ' ') AS tokens, CAST(len({S.token_set('text')}) AS BIGINT) AS n_tokens
FROM documents""")
def b10(t):
    return (t.documents.select("doc_id", F.array_sort(X.match_tokens(c("text"))).alias("tk"))
            .select("doc_id", F.array_join("tk", " ").alias("tokens"), F.size("tk").cast("bigint").alias("n_tokens")))


@query("b11_signal_tokens", f"""
SELECT doc_id, array_to_string({S.token_set('text', R.SIGNAL_STOPWORDS)}, ' ') AS tokens FROM documents""")
def b11(t):
    return t.documents.select("doc_id", F.array_join(F.array_sort(X.signal_tokens(c("text"))), " ").alias("tokens"))


def _filler_sql(e: str) -> str:
    for p in R.FILLER_PATTERNS:
        e = f"regexp_replace({e}, {S.lit('(?i)' + p)}, ' ', 'g')"
    return e


# each turn is asked as a request, so the filler rule meets filler words
@query("b12_truncate_query", rf"""
WITH q AS (SELECT conv_id, turn, 'Can you find me the best one: ' || text || ' really' AS text FROM conversations),
r AS (SELECT *, array_to_string(regexp_split_to_array({S.squeeze(_filler_sql('text'))}, ' ')[1:40], ' ') AS v FROM q)
SELECT conv_id, turn, CASE WHEN v = '' THEN substring(text, 1, 200) ELSE v END AS query FROM r""")
def b12(t):
    q = F.concat(F.lit("Can you find me the best one: "), "text", F.lit(" really"))
    return t.conversations.select("conv_id", "turn", X.truncate_query(q).alias("query"))


@query("b13_parse_rank", """
SELECT event_id, CAST(CASE WHEN k % 3 = 0 THEN k WHEN k % 3 = 1 THEN trunc(value) ELSE 0 END AS BIGINT) AS rank
FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def b13(t):
    raw = (F.when(c("k") % 3 == 0, c("k").cast("string")).when(c("k") % 3 == 1, c("value").cast("string"))
           .otherwise(c("event_type")))
    return M.events(t).select("event_id", X.parse_rank(raw).alias("rank"))


@query("b14_normalize_pos", f"""
WITH {S.VOCAB}
SELECT term, CASE WHEN rank % 4 = 0 THEN 'noun' WHEN rank % 4 = 1 THEN 'verb' WHEN rank % 4 = 2 THEN 'proper_noun'
  ELSE 'unknown' END AS pos FROM vocab""")
def b14(t):
    raw = (F.when(c("rank") % 4 == 0, "['NOUN', 'verb']").when(c("rank") % 4 == 1, "Verb")
           .when(c("rank") % 4 == 2, "US City"))
    return M.vocabulary(t).select("term", X.normalize_pos(raw).alias("pos"))


@query("b15_ngram_type", f"""
WITH {S.VOCAB}, {S.ngrams(2, 'bi')}, {S.ngrams(3, 'tri')}
SELECT term, 'unigram' AS ngram_type FROM vocab UNION ALL SELECT term, 'bigram' FROM bi
UNION ALL SELECT term, 'trigram' FROM tri""")
def b15(t):
    v = M.vocabulary(t).unionByName(M.ngrams(t, 2)).unionByName(M.ngrams(t, 3))
    return v.select("term", X.ngram_type(c("term"), F.lit(None).cast("string")).alias("ngram_type"))


@query("b16_location_category", f"""
WITH {S.VOCAB}
SELECT term, category IN ('en', 'fr', 'es') AS is_location, category IN ('en', 'fr') AS is_city, category = 'es' AS is_state
FROM vocab""")
def b16(t):
    name = F.create_map(*[F.lit(x) for x in ("en", "US City", "fr", "County city", "es", "us_state", "de", "Keyword")])
    v = M.vocabulary(t).select("term", F.try_element_at(name, c("category")).alias("cat"))
    return v.select("term", X.is_location(c("cat")).alias("is_location"), X.is_city(c("cat")).alias("is_city"),
                    X.is_state(c("cat")).alias("is_state"))


_STATES = [(i, k, v) for i, (k, v) in enumerate(R.US_STATES.items())]


@query("b17_state_variants", f"""
WITH s(i, name, abbrev) AS ({S.values(_STATES)})
SELECT c_custkey, array_to_string(list_sort(list_distinct(
    CASE WHEN c_custkey % 2 = 0 THEN [full_name, abbrev]
         ELSE [upper(substring(abbrev, 1, 1)) || lower(substring(abbrev, 2)), full_name] END)), ',') AS variants
FROM (SELECT c_custkey, abbrev, (SELECT string_agg(upper(substring(w, 1, 1)) || substring(w, 2), ' ' ORDER BY j)
        FROM (SELECT unnest(string_split(name, ' ')) AS w, generate_subscripts(string_split(name, ' '), 1) AS j)) AS full_name
      FROM customer JOIN s ON c_custkey % 51 = s.i)""")
def b17(t):
    names = F.array(*[F.lit(k) for _, k, _ in _STATES])
    abbr = F.array(*[F.lit(v) for _, _, v in _STATES])
    i = (c("c_custkey") % 51).cast("int")
    typed = F.when(c("c_custkey") % 2 == 0, F.get(names, i)).otherwise(F.get(abbr, i))
    return t.customer.select("c_custkey", F.array_join(X.state_variants(typed), ",").alias("variants"))


# the text is followed by dated phrases built from the row, so every pattern occurs
@query("b18_temporal_expressions", f"""
WITH d AS (SELECT doc_id, 1850 + doc_id % 150 AS y, text, lower(text) AS low FROM documents),
x AS (SELECT doc_id, text || ' in ' || y || ', ' || (y + 1) || '-' || (y + 5) || ', the ' || (y // 10 * 10) || 's, '
  || (doc_id % 20 + 1) || 'th century, Last Decade, Jazz Age' AS text FROM d),
p AS (SELECT doc_id, text,
  regexp_extract_all(text, '{R.TEMPORAL_PATTERNS['year_range']}', 1) AS a,
  regexp_extract_all(text, '{R.TEMPORAL_PATTERNS['year_range']}', 2) AS b,
  list_transform(regexp_extract_all(text, '{R.TEMPORAL_PATTERNS['decade']}', 1), lambda z: z || 's') AS dec,
  regexp_extract_all(text, '{R.TEMPORAL_PATTERNS['year']}', 1) AS yr FROM x)
SELECT doc_id,
  array_to_string(list_filter(yr, lambda z: NOT list_contains(list_concat(a, b), z) AND NOT list_contains(dec, z || 's')), ' ') AS years,
  array_to_string(dec, ' ') AS decades,
  array_to_string(list_transform(a, lambda z, i: z || ',' || b[i]), ' ') AS ranges,
  array_to_string(regexp_extract_all(text, '{R.TEMPORAL_PATTERNS['century']}', 1), ' ') AS centuries,
  array_to_string(regexp_extract_all(lower(text), '{R.TEMPORAL_PATTERNS['relative']}'), ' ') AS relative,
  array_to_string(regexp_extract_all(lower(text), '{R.TEMPORAL_PATTERNS['era']}'), ' ') AS eras,
  true AS has_temporal FROM p""")
def b18(t):
    y = F.lit(1850) + c("doc_id") % 150
    txt = F.concat("text", F.lit(" in "), y, F.lit(", "), y + 1, F.lit("-"), y + 5, F.lit(", the "),
                   (y - y % 10), F.lit("s, "), c("doc_id") % 20 + 1, F.lit("th century, Last Decade, Jazz Age"))
    d = t.documents.select("doc_id", X.temporal_expressions(txt).alias("t"))
    return d.select("doc_id", *[F.array_join(c("t")[k].cast("array<string>"), " ").alias(k) for k in
                                ("years", "decades", "ranges", "centuries", "relative", "eras")],
                    X.has_temporal_intent(c("t")).alias("has_temporal"))


@query("b19_format_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'soon' ELSE strftime(o_orderdate, '%b %d, %Y') END AS shown FROM orders""")
def b19(t):
    raw = (F.when(c("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
           .when(c("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon"))
    return t.orders.select("o_orderkey", X.format_date(raw).alias("shown"))


@query("b20_time_ago", """
WITH e AS (SELECT event_id, CAST(1706745600 - floor(epoch(ts)) AS BIGINT) AS s FROM events)
SELECT event_id, CASE WHEN s // 86400 > 30 THEN (s // 86400 // 30) || 'mo ago' WHEN s // 86400 > 0 THEN (s // 86400) || 'd ago'
  WHEN s >= 3600 THEN (s // 3600) || 'h ago' WHEN s >= 60 THEN (s // 60) || 'm ago' ELSE 'Just now' END AS time_ago FROM e""")
def b20(t):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return t.events.select("event_id", X.time_ago(c("ts"), now).alias("time_ago"))


_AGENT = {
    "chrome": "Mozilla/5.0 (Windows NT 10.0; Win64) AppleWebKit/537 Chrome/120 Safari/537",
    "edge": "Mozilla/5.0 (Windows NT 6.1) Chrome/120 Safari/537 Edg/120",
    "safari": "Mozilla/5.0 (iPhone; CPU iPhone OS) Version/17 Mobile Safari/604",
    "ipad": "Mozilla/5.0 (iPad; CPU OS) Version/17 Mobile Safari/604",
    "droid": "Mozilla/5.0 (Linux; Android 14) Chrome/120 Mobile Safari/537",
    "bot": "Mozilla/5.0 (compatible; Somebot/2.1)",
    "firefox": "Mozilla/5.0 (X11; Linux x86_64) Firefox/121",
}
_AGENT_OUT = [  # browser, device, os, version, bot, mobile, tablet, pc by k % 7
    (0, "Chrome", "Desktop", "Windows", "10", False, False, False, True),
    (1, "Edge", "Desktop", "Windows", "7", False, False, False, True),
    (2, "Safari", "Mobile", "iOS", "", False, True, False, False),
    (3, "Safari", "Tablet", "iOS", "", False, False, True, False),
    (4, "Chrome", "Mobile", "Android", "", False, True, False, False),
    (5, "Unknown", "Bot", "Unknown", "", True, False, False, False),
    (6, "Firefox", "Desktop", "Linux", "", False, False, False, True),
]


@query("b21_parse_user_agent", f"""
WITH {S.EVENTS}, m(i, browser, device_type, os, os_version, is_bot, is_mobile, is_tablet, is_pc) AS ({S.values(_AGENT_OUT)})
SELECT event_id, m.* EXCLUDE (i) FROM ev JOIN m ON k % 7 = i""")
def b21(t):
    ua = F.get(F.array(*[F.lit(a) for a in _AGENT.values()]), c("k") % 7)
    return M.events(t).select("event_id", X.parse_user_agent(ua).alias("u")).select("event_id", "u.*")


@query("b22_client_ip", f"""
WITH {S.EVENTS}
SELECT event_id, CASE k % 4 WHEN 0 THEN '8.8.8.' || k WHEN 1 THEN '9.9.9.' || k WHEN 2 THEN '7.7.7.' || k
  ELSE '10.0.0.' || k END AS ip FROM ev""")
def b22(t):
    k = c("k")

    def ip(p):
        return F.concat(F.lit(p), k)
    e = M.events(t)
    return e.select("event_id", X.client_ip(
        F.when(k % 4 == 0, F.concat(ip(" 8.8.8."), F.lit(" "))).otherwise(""),
        F.when(k % 4 <= 1, F.concat(ip("9.9.9."), F.lit(", 1.1.1.1"))),
        F.when(k % 4 == 2, ip("7.7.7.")), ip("10.0.0.")).alias("ip"))


@query("b23_resolve_location", f"""
WITH {S.EVENTS}, {S.PLACES},
x AS (SELECT ev.*, CASE WHEN k % 10 = 0 THEN 'City' || k END AS url_city, CASE WHEN k % 15 = 0 THEN 'XX' WHEN k % 2 = 0 THEN 'US' END AS header,
        location_city AS ip_city, location_country AS ip_country
      FROM ev LEFT JOIN places ON user_id = place_user),
y AS (SELECT *, last_value(url_city IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen_city FROM x)
SELECT event_id, coalesce(seen_city, ip_city) AS city, CASE WHEN seen_city IS NULL THEN ip_country END AS country,
  CASE WHEN header <> 'XX' THEN header END AS country_code FROM y""")
def b23(t):
    e = M.with_place(M.events(t), t).select(
        "event_id", "ts", "session_id",
        F.when(c("k") % 10 == 0, F.concat(F.lit("City"), "k")).alias("url_city"),
        F.lit(None).cast("string").alias("url_country"),
        F.when(c("k") % 15 == 0, "XX").when(c("k") % 2 == 0, "US").alias("header_country"),
        c("location_city").alias("ip_city"), c("location_country").alias("ip_country"))
    return enrich.resolve_location(e).select("event_id", "city", "country", "country_code")


@query("b24_private_ip", f"""
WITH {S.EVENTS}
SELECT event_id, CASE k % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN k BETWEEN 16 AND 31 WHEN 3 THEN true ELSE true END AS private
FROM ev""")
def b24(t):
    k = c("k")
    ip = (F.when(k % 5 == 0, F.concat(F.lit("10.1.1."), k)).when(k % 5 == 1, F.concat(F.lit("110.1.1."), k))
          .when(k % 5 == 2, F.concat(F.lit("172."), k, F.lit(".0.1"))).when(k % 5 == 3, "LocalHost"))
    return M.events(t).select("event_id", X.is_private_ip(ip).alias("private"))


@query("b25_extract_coords", """
WITH x AS (SELECT c_custkey, CAST(c_custkey % 200 - 99 AS DOUBLE) AS lat, c_acctbal / 50 AS lng FROM customer)
SELECT c_custkey, CASE WHEN ok THEN lat END AS lat, CASE WHEN ok THEN lng END AS lng
FROM (SELECT *, lat <> 0 AND lng <> 0 AND c_custkey % 4 <> 3 AND lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AS ok FROM x)""")
def b25(t):
    lat, lng, m = (c("c_custkey") % 200 - 99).cast("double"), c("c_acctbal") / 50, c("c_custkey") % 4
    pt = X.extract_coords(F.when(m == 0, lat), F.when(m == 0, lng), F.when(m == 1, F.array(lat, lng)),
                          F.when(m == 2, F.concat(lat.cast("string"), F.lit(", "), lng.cast("string")))
                          .when(m == 3, "here"))
    return t.customer.select("c_custkey", pt.alias("p")).select("c_custkey", "p.lat", "p.lng")


@query("b26_format_results", f"""
WITH {S.DOCS}
SELECT document_uuid AS id, CASE WHEN document_title = '' THEN 'Untitled' ELSE document_title END AS title,
  document_summary AS summary, source AS site_name, document_category AS category, document_data_type AS data_type,
  document_schema AS schema, authority_rank_score AS authority_score, CAST(len(key_facts) AS BIGINT) AS n_facts,
  primary_subject_name, primary_subject_type, primary_subject_confidence, CAST(len(secondary_subjects) AS BIGINT) AS n_secondary,
  label AS cluster, CAST(NULL AS VARCHAR) AS city, 0.5::DOUBLE AS score
FROM docs LEFT JOIN embeddings ON doc_id = vec_id""")
def b26(t):
    d = M.documents(t, embeddings=True)
    r = enrich.format_results(d)
    return r.select("id", "title", "summary", "site_name", "category", "data_type", "schema", "authority_score",
                    F.size("key_facts").cast("bigint").alias("n_facts"), "primary_subject_name",
                    "primary_subject_type", "primary_subject_confidence",
                    F.size("secondary_subjects").cast("bigint").alias("n_secondary"),
                    c("cluster_uuid").cast("int").alias("cluster"), c("location")["city"].alias("city"), "score")


@query("b27_initials_excerpts", rf"""
WITH d AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, upper(array_to_string(list_transform(w[1:2], lambda x: substring(x, 1, 1)), '')) AS initials,
  substring(text, 1, 150) AS excerpt150, substring(text, 1, 200) AS excerpt200 FROM d""")
def b27(t):
    return t.documents.select("doc_id", X.initials(c("text")).alias("initials"),
                              X.excerpt(c("text"), 150).alias("excerpt150"), X.excerpt(c("text"), 200).alias("excerpt200"))


@query("b28_has_images", f"""
WITH {S.PAGES} SELECT page_id, len(list_filter(image_url, lambda u: u <> '')) > 0 AS has_images FROM pg""")
def b28(t):
    return M.page_fields(t).select("page_id", X.has_images(c("image_url")).alias("has_images"))


@query("b29_web_handles", rf"""
WITH v AS (SELECT page_id, url AS v FROM pages UNION ALL SELECT page_id, '@' || regexp_extract(url, '//([^/?#]+)', 1) FROM pages
  UNION ALL SELECT page_id, 'https://www.instagram.com/p' || page_id FROM pages)
SELECT page_id, v, CASE WHEN {' OR '.join(f"regexp_matches(lower(v), {S.lit(p)})" for p in R.WEB_HANDLE_PATTERNS)}
  THEN 'match' ELSE 'no match' END AS verdict FROM v""")
def b29(t):
    p = t.pages.select("page_id", "url")
    host = F.regexp_extract("url", r"//([^/?#]+)", 1)
    v = (p.select("page_id", c("url").alias("v"))
         .unionAll(p.select("page_id", F.concat(F.lit("@"), host)))
         .unionAll(p.select("page_id", F.concat(F.lit("https://www.instagram.com/p"), "page_id"))))
    return v.select("page_id", "v", X.classify_web_handle(c("v")).alias("verdict"))
