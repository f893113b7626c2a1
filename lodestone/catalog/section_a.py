"""Sources, ingest and document checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.catalog import sqlkit as S
from lodestone.catalog.registry import query
from lodestone.operators import analytics as AN
from lodestone.operators import feedback as FB
from lodestone.operators import ingest as O
from lodestone.operators import vocab as V
from lodestone.session import shared_dir
from lodestone.sources import mapping as M
from lodestone.sources import partitions as P
from lodestone.sources import schemas as SC
from lodestone.streaming import streams as ST

c = F.col


def _folder(t, name):
    return f"{shared_dir(t.spark)}/sources/{name}-{uuid.uuid4().hex}"


@query("a01_document_source", f"""
WITH {S.DOCS} SELECT document_uuid, document_title, document_schema, CAST(len(primary_keywords) AS BIGINT) AS n_keywords, authority_rank_score, CAST(label AS VARCHAR) AS cluster_uuid,
  CAST(len(embedding) AS BIGINT) AS width FROM docs LEFT JOIN embeddings ON doc_id = vec_id""")
def a01(t):
    path = _folder(t, "documents")
    SC.conform(M.documents(t, embeddings=True), SC.document_schema()).write.parquet(path)
    d = SC.read_documents(t.spark, path)
    return d.select("document_uuid", "document_title", "document_schema", F.size("primary_keywords").cast("bigint").alias("n_keywords"),
                    "authority_rank_score", "cluster_uuid", F.size("embedding").cast("bigint").alias("width"))


@query("a02_question_source", f"""
WITH {S.QUESTIONS} SELECT CAST(item_id AS VARCHAR) AS question_id, document_uuid, question, question_type, CAST(len(tokens) AS BIGINT) AS n_keywords, CAST(len(embedding) AS BIGINT) AS width FROM questions""")
def a02(t):
    path = _folder(t, "questions")
    q = M.questions(t).withColumns({"question_id": c("item_id").cast("string"), "primary_keywords": c("tokens")})
    SC.conform(q, SC.T.StructType.fromDDL(SC.QUESTION_DDL)).write.parquet(path)
    r = SC.read_questions(t.spark, path)
    return r.select("question_id", "document_uuid", "question", "question_type", F.size("primary_keywords").cast("bigint").alias("n_keywords"),
                    F.size("embedding").cast("bigint").alias("width"))


def _vocab_json(t):
    """The token vocabulary as JSON maps {"term:<term>:<category>": {...}} in 64 chunks."""
    v = M.vocabulary(t)
    entry = F.struct(F.concat_ws(":", F.lit("term"), "term", "category").alias("key"), F.struct(
        "term", c("term").alias("display"), "category", F.lit("").alias("description"), F.lit("['noun']").alias("pos"), F.lit("unigram").alias("entity_type"),
        c("rank").cast("string").alias("rank")).alias("value"))
    # one small map per row: nothing is gathered, however large the vocabulary
    return v.select((F.hash("term") % 64).alias("chunk"), F.to_json(F.map_from_entries(F.array(entry))).alias("value"))


@query("a03_load_vocabulary", f"""
WITH {S.VOCAB} SELECT 'term:' || term || ':' || category AS key, term, category, pos, 'unigram' AS entity_type, rank FROM vocab""")
def a03(t):
    return O.load_vocabulary(_vocab_json(t)).select("key", "term", "category", "pos", "entity_type", "rank")


@query("a04_add_terms", f"""
WITH {S.VOCAB}, {S.ngrams(2, 'bi')}
SELECT 'key' AS part, term AS name, 1 AS n FROM vocab WHERE category IN ('en', 'fr') UNION ALL SELECT 'key', term, 1 FROM vocab WHERE category NOT IN ('en', 'fr')
UNION ALL SELECT 'key', term, 1 FROM bi UNION ALL SELECT 'added:unigram', '', count(*) FROM vocab WHERE category NOT IN ('en', 'fr')
UNION ALL SELECT 'added:bigram', '', count(*) FROM bi UNION ALL SELECT 'skipped:unigram', '', count(*) FROM vocab WHERE category = 'fr'""")
def a04(t):
    v = M.vocabulary(t).select(c("term").alias("key"), "term", "category", "rank")
    b = v.where(c("category") != "en").unionByName(M.ngrams(t, 2).select(c("term").alias("key"), "term", "category", "rank"))
    merged, stats = O.add_terms(v.where(c("category").isin("en", "fr")), b)
    return (merged.select(F.lit("key").alias("part"), c("key").alias("name"), F.lit(1).cast("bigint").alias("n"))
            .unionByName(stats.select(F.concat_ws(":", "outcome", "ngram_type").alias("part"), F.lit("").alias("name"), "n")))


@query("a05_ingest_chunks", f"""
WITH {S.VOCAB} SELECT 'term:' || term || ':' || category AS key, term, category, rank FROM vocab""")
def a05(t):
    path = _folder(t, "chunks")
    _vocab_json(t).write.json(path)
    return O.ingest_vocab_chunks(t.spark.read.schema("chunk int, value string").json(path)).select("key", "term", "category", "rank")


_NVC = f"nvc AS (SELECT term, {S._by_lang('lang', S.CAT_LANG)} AS category, n AS rank FROM voctok)"


# the stored vocabulary and phrase tables; the first query of a session that needs one builds it
@query("a05_build_vocabulary", f"""
WITH {S.VOCTOK}, {S.ngrams(2, 'bi', 2)}, {S.ngrams(3, 'tri', 2)}
SELECT 'vocabulary' AS part, count(*) AS n, CAST(sum(n) AS BIGINT) AS occurrences FROM voctok UNION ALL SELECT 'bigrams', count(*), CAST(sum(rank) AS BIGINT) FROM bi
UNION ALL SELECT 'trigrams', count(*), CAST(sum(rank) AS BIGINT) FROM tri""")
def a05_build(t):
    tables = {"vocabulary": M.vocabulary_tokens(t).withColumnRenamed("n", "rank"), "bigrams": M.ngrams(t, 2, 2), "trigrams": M.ngrams(t, 3, 2)}
    parts = [d.agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("occurrences")).select(F.lit(k).alias("part"), "n", "occurrences") for k, d in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a06_vocab_status", f"""
WITH {S.VOCTOK}, {_NVC}, p AS (SELECT term, count(*) AS n, count(DISTINCT category) AS k, bool_or(category = 'US City') AS ci, bool_or(category = 'US State') AS st FROM nvc GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS entries, count(*) AS terms, count(*) FILTER (ci) AS cities, count(*) FILTER (st) AS states, count(*) FILTER (ci OR st) AS locations,
  count(*) AS unigrams, 0 AS bigrams, 0 AS trigrams, 0 AS quadgrams, count(*) FILTER (k > 1) AS multi_category FROM p""")
def a06(t):
    return V.vocab_status(M.vocabulary_by_category(t).withColumn("category", M.category_by_language(c("category"))))


def _batch(t):
    """Documents as an import batch with the errors real batches have."""
    d = M.documents(t)
    n = c("doc_id")
    return d.select(
        "doc_id", "document_uuid", F.when(n % 17 != 0, c("document_title")).alias("document_title"), "document_summary", c("lang").alias("document_category"),
        F.when(n % 5 != 0, "article").alias("document_data_type"), "document_schema",
        F.when(n % 13 == 0, "not a url").otherwise(F.concat(F.lit("https://example.com/"), n)).alias("document_url"),
        "primary_keywords", (n % 120).cast("double").alias("authority_score"),
        F.when(n % 3 == 0, "current").when(n % 3 == 1, "sometime").alias("temporal_relevance"))


_BATCH = f"""{S.DOCS}, bt AS (SELECT doc_id, document_uuid, CASE WHEN doc_id % 17 <> 0 THEN document_title END AS title, text AS summary, lang AS category, CASE WHEN doc_id % 5 <> 0 THEN 'article' END AS dt,
  document_schema, doc_id % 13 = 0 AS badurl, len(primary_keywords) AS nk, list_max(list_transform(primary_keywords, lambda z: length(z))) AS mk, doc_id % 120 AS au, doc_id % 3 = 1 AS badtemp FROM docs)"""


def _errors_sql(need_type=True, extra=""):
    t = "CASE WHEN dt IS NULL THEN 'document_data_type required' END" if need_type else "NULL"
    return f"""list_filter([CASE WHEN coalesce(title, '') = '' THEN 'document_title required' END, CASE WHEN length(title) > 500 THEN 'document_title longer than 500' END,
  CASE WHEN {S.strip('summary')} = '' THEN 'document_summary required' END, CASE WHEN length(summary) > 10000 THEN 'document_summary longer than 10000' END, {t},
  CASE WHEN badurl THEN 'document_url not a URL' END, CASE WHEN nk NOT BETWEEN 1 AND 10 THEN 'primary_keywords size' END,
  CASE WHEN mk > 100 THEN 'primary_keywords item longer than 100' END, CASE WHEN au > 100 THEN 'authority_score out of range' END,
  CASE WHEN badtemp THEN 'temporal_relevance not allowed' END{extra}], lambda z: z IS NOT NULL)"""


@query("a07_validate_documents", f"""
WITH {_BATCH} SELECT doc_id, array_to_string({_errors_sql()}, '; ') AS errors FROM bt""")
def a07(t):
    return O.check_documents(_batch(t)).select("doc_id", F.array_join("errors", "; ").alias("errors"))


@query("a08_schema_rules", f"""
WITH {_BATCH}, nb AS (SELECT * REPLACE (CASE doc_id % 4 WHEN 0 THEN 'news' ELSE document_schema END AS document_schema, CASE WHEN doc_id % 3 = 0 THEN 'sports' ELSE category END AS category) FROM bt)
SELECT doc_id, array_to_string({_errors_sql(False, ", CASE WHEN category <> 'sports' THEN 'document_category not allowed' END, CASE WHEN document_schema <> 'news' THEN 'document_schema must be news' END")}, '; ') AS errors FROM nb""")
def a08(t):
    b = _batch(t).withColumns({"document_schema": F.when(c("doc_id") % 4 == 0, "news").otherwise(c("document_schema")),
                               "document_category": F.when(c("doc_id") % 3 == 0, "sports").otherwise(c("document_category"))})
    return O.check_documents(b, schema="news").select("doc_id", F.array_join("errors", "; ").alias("errors"))


@query("a09_default_identity", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'p' || page_id ELSE md5(url || '|' || page_id) END AS id, CASE WHEN page_id % 3 = 0 THEN page_id ELSE 1700000000 END AS created_at FROM pages""")
def a09(t):
    p = t.pages.select("page_id", "url", F.when(c("page_id") % 2 == 0, F.concat(F.lit("p"), "page_id")).otherwise("").alias("document_uuid"),
                       F.when(c("page_id") % 3 == 0, c("page_id")).alias("created_at"))
    return O.fill_document_defaults(p, F.lit(1700000000).cast("bigint"), ["url", "page_id"]).select("page_id", "id", "created_at")


@query("a10_prune_empty", f"""
WITH {S.DOCS} SELECT document_uuid, nullif(document_title, '') AS document_title, CASE WHEN len(entity_names) > 0 THEN array_to_string(entity_names, '|') END AS entity_names,
  CASE WHEN doc_id % 2 = 0 THEN lang END AS lang FROM docs""")
def a10(t):
    d = M.documents(t).select("document_uuid", "document_title", "entity_names", F.when(c("doc_id") % 2 == 0, c("lang")).otherwise("").alias("lang"))
    return O.prune_empty(d).withColumn("entity_names", F.array_join("entity_names", "|"))


@query("a11_import_report", f"""
WITH {_BATCH}, e AS (SELECT document_schema, len({_errors_sql()}) = 0 AS ok FROM bt)
SELECT document_schema, count(*) AS total_received, count(*) FILTER (ok) AS validated, count(*) FILTER (ok) AS imported, count(*) FILTER (NOT ok) AS failed,
  CASE WHEN bool_and(ok) THEN 'created' WHEN bool_or(ok) THEN 'partial' ELSE 'bad request' END AS status FROM e GROUP BY 1""")
def a11(t):
    return O.import_report(O.check_documents(_batch(t)), ["document_schema"])


# updates: every third order comes again with twice its price, every ninth a third time
_UPD = """base AS (SELECT o_orderkey, o_orderstatus, o_totalprice, 1 AS version FROM orders), upd AS (SELECT o_orderkey, 'U' AS o_orderstatus, o_totalprice * 2 AS o_totalprice, 2 AS version FROM orders WHERE o_custkey % 3 = 0
  UNION ALL SELECT o_orderkey, 'V', o_totalprice * 3, 3 FROM orders WHERE o_custkey % 9 = 0)"""


_LAST = f"""
WITH {_UPD} SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(version AS BIGINT) AS version FROM (SELECT * FROM base UNION ALL SELECT * FROM upd) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY version DESC) = 1"""


def _versions(t):
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    def ver(d, s, k, n):
        return d.select("o_orderkey", s.alias("o_orderstatus"), (c("o_totalprice") * k).alias("o_totalprice"), F.lit(n).cast("bigint").alias("version"))
    u = ver(o.where(c("o_custkey") % 3 == 0), F.lit("U"), 2, 2).unionByName(ver(o.where(c("o_custkey") % 9 == 0), F.lit("V"), 3, 3))
    return ver(o, c("o_orderstatus"), 1, 1), u


@query("a12_upsert", _LAST)
def a12(t):
    return O.upsert(*_versions(t), "o_orderkey", "version")


# the same into a stored table, of which only touched partitions are written anew
@query("a12_upsert_stored", _LAST)
def a12_stored(t):
    base, u = (d.withColumn("part", P.bucket_of("o_orderkey", 16)) for d in _versions(t))
    table = P.PartitionedTable.create(base, _folder(t, "orders"), "part")
    table.upsert(u, "o_orderkey", "version")
    return table.read().drop("part")


_KEPT = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"


# orders in a stored table by month; months without a returned line keep their files
@query("a13_delete_stored", _KEPT)
def a13_stored(t):
    days = t.orders.select("o_orderkey", "o_orderstatus", F.date_trunc("month", "o_orderdate").cast("date").alias("month"))
    table = P.PartitionedTable.create(days, _folder(t, "orders"), "month")
    table.delete(t.lineitem.where(c("l_returnflag") == "R").select(c("l_orderkey").alias("o_orderkey")), "o_orderkey")
    return table.read().drop("month")


@query("a13_delete_by_id", _KEPT)
def a13(t):
    gone = t.lineitem.where(c("l_returnflag") == "R").select(c("l_orderkey").alias("o_orderkey"))
    return O.delete_by_id(t.orders.select("o_orderkey", "o_orderstatus"), gone, "o_orderkey")


# ids spread over all documents
_FETCH = f"""
WITH {S.EVENTS}, r AS (SELECT user_id AS qid, event_id // 10 AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM ev WHERE event_type = 'click')
SELECT qid, pos, doc_id, lang, n_chars FROM r JOIN documents USING (doc_id)"""


@query("a14_fetch_by_ids", _FETCH)
@query("a14_fetch_by_ids_all", _FETCH)
def a14(t):
    from pyspark.sql import Window as W
    r = M.clicks(t).select(c("user_id").alias("qid"), F.expr("event_id div 10").alias("doc_id"),
                           F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("pos"))
    return O.fetch_by_ids(t.documents.select("doc_id", "lang", "n_chars"), r, "doc_id").select("qid", "pos", "doc_id", "lang", "n_chars")


@query("a15_search_events", rf"""
WITH {S.SEARCHES}, q AS (SELECT *, ' Query ' || k || '  text ' AS qtext, CASE WHEN k % 4 = 0 THEN 'query fixed' ELSE '' END AS fixed FROM searches)
SELECT event_id, substring({S.strip('lower(qtext)')}, 1, 500) AS query_normalized, substring(md5(substring({S.strip('lower(qtext)')}, 1, 500)), 1, 12) AS query_hash,
  length(qtext) AS query_length, CAST(3 AS BIGINT) AS query_word_count, CAST(results_count AS BIGINT) AS results_count, results_count > 0 AS has_results, fixed <> '' AS was_corrected,
  CAST(user_id AS VARCHAR) AS user_id, 'unknown' AS device_type, mode AS alt_mode, {"strftime(event_date, '%Y-%m-%d')"} AS event_date FROM q""")
def a15(t):
    s = M.searches(t).withColumns({"query": F.concat(F.lit(" Query "), "k", F.lit("  text ")), "alt_mode": c("mode"),
                                   "corrected_query": F.when(c("k") % 4 == 0, "query fixed")})
    e = AN.build_search_events(s.withColumn("request_id", c("event_id").cast("string")))
    return e.select(c("request_id").cast("bigint").alias("event_id"), "query_normalized", "query_hash", c("query_length").cast("bigint").alias("query_length"),
                    c("query_word_count").cast("bigint").alias("query_word_count"), c("results_count").cast("bigint").alias("results_count"), "has_results",
                    "was_corrected", "user_id", "device_type", "alt_mode", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"))


@query("a16_click_events", f"""
WITH {S.EVENTS}, {S.CLICKS} SELECT session_id, query, clicked_url, CAST(clicked_position AS BIGINT) AS clicked_position, CAST(event_id AS VARCHAR) AS result_id, time_to_click_ms, substring(repeat('t', 600), 1, 500) AS result_title,
  k % 4 = 0 AS was_corrected FROM clicks""")
def a16(t):
    k = M.clicks(t).withColumns({"result_id": c("event_id"), "result_title": F.repeat(F.lit("t"), 600), "was_corrected": c("k") % 4 == 0})
    e = AN.build_click_events(k)
    return e.select("session_id", "query", "clicked_url", c("clicked_position").cast("bigint").alias("clicked_position"), "result_id",
                    "time_to_click_ms", "result_title", "was_corrected")


@query("a17_custom_events", f"""
WITH {S.EVENTS} SELECT event_id, event_type, CAST(k AS VARCHAR) AS k, repeat('x', 1000) AS long_text, '{{"a":"' || k || '"}}' AS nested, 3 AS n_keys FROM ev""")
def a17(t):
    e = M.events(t)
    raw = e.withColumn("props", F.to_json(F.struct(c("k").alias("k"), F.repeat(F.lit("x"), 1500).alias("long"), F.struct(c("k").cast("string").alias("a")).alias("nest"))))
    r = AN.build_custom_events(raw)
    return r.select("event_id", "event_type", c("props")["k"].alias("k"), c("props")["long"].alias("long_text"), c("props")["nest"].alias("nested"),
                    F.size("props").cast("bigint").alias("n_keys"))


@query("a18_event_log", f"""
WITH {S.EVENTS} SELECT event_id, event_type, user_id, strftime(event_date, '%Y-%m-%d') AS event_date FROM ev""")
def a18(t):
    path = _folder(t, "event_log")
    q = ST.write_event_log(ST.event_stream(t.spark, t.folder, glob="events.parquet"), path + "/log", path + "/state")
    q.awaitTermination()
    d = t.spark.read.schema("event_id bigint, event_type string, user_id bigint, event_date date").parquet(path + "/log")
    return d.select("event_id", "event_type", "user_id", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"))


@query("a19_load_feed", f"""
WITH {S.PAGES} SELECT page_id, 0 AS item_no, title, url FROM pg UNION ALL SELECT page_id, 1, 'plain', '' FROM pg""")
def a19(t):
    p = M.page_fields(t)
    items = F.array(F.struct("title", "url"), F.struct(F.lit("plain").alias("title"), F.lit("").alias("url")),
                    F.struct(F.lit("bad").alias("title"), F.concat(F.lit("ftp://"), "host").alias("url")))
    r = O.load_feed(p.select("page_id", F.to_json(items).alias("value")), "facts")
    return r.select("page_id", c("item_no").cast("bigint").alias("item_no"), "title", "url")


_SHUF = "md5('2024-01-31|videos|' || page_id)"


@query("a20_one_per_channel", f"""
WITH {S.PAGES} SELECT host, page_id FROM pg QUALIFY row_number() OVER (PARTITION BY host ORDER BY {_SHUF}, page_id) = 1""")
def a20(t):
    return FB.daily_sample(M.page_fields(t), "page_id", "2024-01-31", "videos", per="host").select("host", "page_id")


@query("a21_daily_sample", f"""
WITH p AS (SELECT page_id, md5('2024-01-31|news|' || page_id) AS k FROM pages) SELECT page_id, k AS shuffle_key FROM p ORDER BY k, page_id LIMIT 20""")
def a21(t):
    return FB.daily_sample(t.pages.select("page_id"), "page_id", "2024-01-31", "news", 20)


@query("a22_profiles", """
SELECT c_name AS business_name, CAST(CAST(c_acctbal / 100 AS DECIMAL(9,6)) AS VARCHAR) AS latitude, c_mktsegment || ',' || n_name AS categories
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def a22(t):
    path = _folder(t, "profiles")
    cu = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey"))
    cu.select(c("c_name").alias("business_name"), F.lit("").alias("business_website"), (c("c_acctbal") / 100).cast("decimal(9,6)").alias("latitude"),
              F.lit(0).cast("decimal(9,6)").alias("longitude"), F.to_json(F.array("c_mktsegment", "n_name")).alias("categories")).write.parquet(path)
    p = SC.read_profiles(t.spark, path, "business")
    return p.select("business_name", c("latitude").cast("string").alias("latitude"), F.array_join("categories", ",").alias("categories"))


