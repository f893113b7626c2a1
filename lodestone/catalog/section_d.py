"""Joins and retrieval."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F

from lodestone.catalog import sqlkit as S
from lodestone.catalog.registry import query
from lodestone.functions import text as X
from lodestone.operators import index as IX
from lodestone.operators import retrieve as O
from lodestone.rules import fixed as RF
from lodestone.rules import scoring as R
from lodestone.session import materialize
from lodestone.sources import mapping as M

c = F.col


def _rank(df, col="rank"):
    return df.withColumn(col, c(col).cast("bigint"))


# what the stored index holds; the first query of a session that needs the index builds it
@query("d01_build_index", f"""
WITH {S.DOCS}, {S.POST}, tk AS (SELECT token, count(*) AS df, max(weight) AS top FROM post GROUP BY 1)
SELECT weight, count(DISTINCT token) AS tokens, count(*) AS postings, CAST(max(df) AS BIGINT) AS most_documents FROM post JOIN tk USING (token) GROUP BY 1""")
def d01_build(t):
    index = M.keyword_index(t)
    terms = index.terms().select("token", "df")
    return index.heads.groupBy("token", "weight").agg(F.sum("n").alias("n")).join(terms, "token").groupBy("weight").agg(
        F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("postings"), F.max("df").alias("most_documents"))


@query("d01_keyword_candidates", f"WITH {S.CAND} SELECT query_id, document_uuid, text_match, candidate_rank FROM cand")
def d01(t):
    return _rank(O.keyword_candidates(M.query_log(t), M.documents(t), index=M.keyword_index(t)), "candidate_rank")


def _cut(src, col):
    """Each word with none or one of its characters left out."""
    return f"SELECT {col}, {col} AS key FROM {src} UNION SELECT {col}, substring({col}, 1, i - 1) || substring({col}, i + 1) FROM (SELECT {col}, unnest(range(1, length({col}) + 1)) AS i FROM {src})"


# one edit in any token; of several variants of a token the one of the largest weight counts
@query("d02_typo_candidates", f"""
WITH {S.QLOG}, {S.DOCS}, {S.POST}, {S.QT}, {S.STAR}, ask AS (SELECT DISTINCT token FROM qtok), idx AS (SELECT DISTINCT token AS alt FROM post),
ak AS ({_cut('ask', 'token')}), ik AS ({_cut('idx', 'alt')}),
va AS (SELECT DISTINCT token, alt FROM ak JOIN ik USING (key) WHERE abs(length(token) - length(alt)) <= 1 AND {S.lev('token', 'alt')} <= 1),
hw AS (SELECT query_id, document_uuid, need, q.token, max(weight) AS w FROM qtok q JOIN va ON q.token = va.token JOIN post ON post.token = alt GROUP BY 1, 2, 3, 4),
al AS (SELECT query_id, document_uuid, CAST(sum(w) AS BIGINT) AS text_match FROM hw GROUP BY query_id, document_uuid, need HAVING count(*) = need UNION ALL SELECT * FROM star)
SELECT query_id, document_uuid, text_match, row_number() OVER (PARTITION BY query_id ORDER BY text_match DESC, authority_rank_score DESC, document_uuid) AS candidate_rank
FROM al JOIN docs USING (document_uuid)""")
def d02(t):
    return _rank(O.keyword_candidates(M.query_log(t), M.documents(t), num_typos=1, index=M.keyword_index(t)), "candidate_rank")


_ORD = S.token_list("query")


@query("d03_drop_tokens", f"""
WITH {S.QLOG}, {S.DOCS}, {S.POST}, {S.QT}, {S.STAR},
o AS (SELECT query_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS ts FROM (SELECT query_id, {_ORD} AS l FROM qlog)),
lv AS (SELECT query_id, m, len(ts) AS n, ts[1:m] AS pre FROM (SELECT query_id, ts, unnest(range(1, len(ts) + 1)) AS m FROM o)),
tk AS (SELECT query_id, m, n, unnest(pre) AS token FROM lv),
ph AS (SELECT query_id, m, n, document_uuid, CAST(sum(weight) AS BIGINT) AS text_match FROM tk JOIN post USING (token) GROUP BY 1, 2, 3, 4 HAVING count(*) = m),
ct AS (SELECT query_id, m, n, count(*) AS c FROM ph GROUP BY 1, 2, 3),
pick AS (SELECT query_id, CASE WHEN max(m) FILTER (c >= 2) IS NOT NULL THEN max(m) FILTER (c >= 2) WHEN max(n) = 1 THEN max(m) ELSE coalesce(min(m) FILTER (m < n), NULL) END AS m FROM ct GROUP BY 1),
al AS (SELECT query_id, document_uuid, text_match FROM ph JOIN pick USING (query_id, m) UNION ALL SELECT * FROM star)
SELECT query_id, document_uuid, text_match, row_number() OVER w AS candidate_rank FROM al JOIN docs USING (document_uuid)
WINDOW w AS (PARTITION BY query_id ORDER BY text_match DESC, authority_rank_score DESC, document_uuid)""")
def d03(t):
    return _rank(O.keyword_candidates(M.query_log(t), M.documents(t), drop_tokens=2, index=M.keyword_index(t)), "candidate_rank")


_META = ["document_data_type", "document_category", "document_schema", "document_title", "primary_subject_name", "primary_subject_type", "primary_subject_confidence",
         "document_summary", "content_depth_score", "authority_rank_score", "word_count"]
_META_LISTS = ["secondary_subjects", "entity_names", "primary_keywords", "key_facts", "topic_tags", "semantic_keywords"]


@query("d04_keyword_with_metadata", f"""
WITH {S.CAND} SELECT query_id, candidate_rank, document_uuid, {', '.join(x for x in _META if x != 'document_summary')}, md5(document_summary) AS document_summary,
  {', '.join(f"md5(array_to_string({x}, '|')) AS {x}" for x in _META_LISTS if x != 'primary_keywords')}, md5(array_to_string(list_sort(primary_keywords), '|')) AS primary_keywords
FROM cand JOIN docs USING (document_uuid)""")
def d04(t):
    d = M.documents(t)
    r = O.attach_metadata(O.keyword_candidates(M.query_log(t), d, index=M.keyword_index(t)), d)
    # long texts and lists are compared by their hashes
    lists = [F.md5(F.array_join(F.array_sort(x) if x == "primary_keywords" else x, "|")).alias(x) for x in _META_LISTS]
    return _rank(r.select("query_id", "candidate_rank", "document_uuid", *[F.md5(x).alias(x) if x == "document_summary" else c(x) for x in _META], *lists), "candidate_rank")


def _place_requests(t, none_key, none_keys):
    """Requests over suppliers; one without a place asks ``none_key``, a supplier carries ``none_keys`` for it."""
    place = t.nation.join(t.region, c("n_regionkey") == c("r_regionkey"))
    rid, none = c("n_nationkey"), F.array().cast("array<string>")
    sup = t.supplier.join(place, c("s_nationkey") == rid).select(
        "s_suppkey", c("n_name").alias("location_city"), c("r_name").alias("location_state"),
        F.when(c("s_suppkey") % 2 == 0, "business").otherwise("place").alias("document_data_type"), F.concat(F.lit("cat"), c("s_suppkey") % 3).alias("document_category"))
    prof = place.select(rid.cast("string").alias("query_id"), F.when(rid % 3 == 0, F.array("n_name")).otherwise(none).alias("cities"),
                        F.when(rid % 3 == 1, F.array("r_name")).otherwise(none).alias("state_variants"),
                        (rid % 3 != 2).alias("filters_place"), F.when(rid % 2 == 0, "business").alias("required_type"),
                        F.when(rid % 4 == 1, F.array(F.lit("cat1"))).otherwise(none).alias("chosen_category"))
    # each request meets the suppliers of its place; a request without a place, those of its key
    key = F.when(rid % 3 == 0, F.array(F.concat(F.lit("c"), "n_name"))).when(rid % 3 == 1, F.array(F.concat(F.lit("s"), "r_name"))) \
        .otherwise(none_key(rid))
    keys = F.array(F.concat(F.lit("c"), "location_city"), F.concat(F.lit("s"), "location_state"), *none_keys)
    req = place.select(rid.cast("string").alias("query_id"), F.explode(key).alias("key"))
    cand = req.join(sup.withColumn("key", F.explode(F.array_compact(keys))), "key").drop("key").distinct()
    return O.apply_filters(cand.withColumn("document_uuid", c("s_suppkey").cast("string")), prof).select("query_id", "document_uuid")


# suppliers asked for by place: a request per customer nation, for the nation, its region, or without a place;
# at most 25 requests, so the output is linear in supplier
_PLACES = """
WITH sup AS (SELECT s_suppkey, n_name AS city, r_name AS state, CASE WHEN s_suppkey % 2 = 0 THEN 'business' ELSE 'place' END AS dtype, 'cat' || (s_suppkey % 3) AS category
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
req AS (SELECT n_nationkey AS rid, n_name AS city, r_name AS state FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT CAST(rid AS VARCHAR) AS query_id, CAST(s_suppkey AS VARCHAR) AS document_uuid FROM req JOIN sup
ON (CASE rid % 3 WHEN 0 THEN sup.city = req.city WHEN 1 THEN sup.state = req.state ELSE true END)
  AND (rid % 2 = 1 OR dtype = 'business') AND (rid % 4 <> 1 OR category = 'cat1')"""


@query("d05_place_filters", _PLACES)
@query("d05_place_filters_all", _PLACES)
def d05(t):
    return _place_requests(t, lambda rid: F.array(F.lit("a")), [F.lit("a")])


# --- synonym rules of the fixture: one way only
SYN = [("red", "crimson"), ("bolt", "screw"), ("widget", "gadget"), ("small", "tiny"), ("cold", "icy"), ("ring", "band"), ("large", "big")]


@query("d06_expand_synonyms", f"""
WITH s(root, synonym) AS ({S.values(SYN)}), w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT DISTINCT p_partkey, word, false AS is_synonym FROM w UNION ALL SELECT DISTINCT p_partkey, synonym, true FROM w JOIN s ON word = root""")
def d06(t):
    words = t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    syn = t.spark.createDataFrame(SYN, "root string, synonym string")
    return O.expand_synonyms(words, syn)


# every document vector asks the question vectors
@query("d07_vector_topk", f"""
WITH q AS (SELECT CAST(vec_id AS VARCHAR) AS qid, embedding AS a FROM embeddings), i AS (SELECT CAST(item_id AS VARCHAR) AS iid, embedding AS b FROM benchmark JOIN embeddings ON item_id = vec_id),
p AS (SELECT qid, iid, {S.dist('a', 'b')} AS distance FROM q, i)
SELECT qid, iid, round(distance, 6) AS distance, row_number() OVER w AS rank FROM p WINDOW w AS (PARTITION BY qid ORDER BY distance, iid) QUALIFY row_number() OVER w <= 10""")
def d07(t):
    q = t.embeddings.select(c("vec_id").alias("qid"), c("embedding").alias("qvec"))
    i = M.questions(t).select(c("item_id").alias("iid"), c("embedding").alias("ivec"))
    return _rank(O.vector_topk(q, i, 10).withColumn("distance", F.round("distance", 6)))


@query("d08_filter_relaxation", f"""
WITH q AS (SELECT CAST(vec_id AS VARCHAR) AS qid, embedding AS a, label + CASE WHEN vec_id % 10 = 7 THEN 1000 ELSE 0 END AS l1, label * 100 + vec_id % 15 + CASE WHEN vec_id % 5 = 2 THEN 5000 ELSE 0 END AS l0 FROM embeddings),
i AS (SELECT CAST(vec_id AS VARCHAR) AS iid, embedding AS b, label AS l1, label * 100 + vec_id % 15 AS l0 FROM embeddings),
n AS (SELECT qid, (SELECT count(*) FROM i WHERE i.l0 = q.l0) AS n0, (SELECT count(*) FROM i WHERE i.l1 = q.l1) AS n1 FROM q),
p AS (SELECT q.qid, iid, CASE WHEN n0 >= 5 THEN '0' WHEN n1 >= 5 THEN '1' ELSE '*' END AS level, {S.dist('a', 'b')} AS distance FROM q JOIN n USING (qid)
  JOIN i ON CASE WHEN n0 >= 5 THEN i.l0 = q.l0 WHEN n1 >= 5 THEN i.l1 = q.l1 ELSE true END)
SELECT qid, iid, level, row_number() OVER w AS rank FROM p WINDOW w AS (PARTITION BY qid ORDER BY distance, iid) QUALIFY row_number() OVER w <= 10""")
def d08(t):
    l0, n = c("label") * 100 + c("vec_id") % 15, c("vec_id")
    # some queries ask for keys that no item has, so that each level of relaxation is met
    q = t.embeddings.select(n.alias("qid"), c("embedding").alias("qvec"), (l0 + F.when(n % 5 == 2, 5000).otherwise(0)).alias("l0"),
                            (c("label") + F.when(n % 10 == 7, 1000).otherwise(0)).alias("l1"))
    i = t.embeddings.select(n.alias("iid"), c("embedding").alias("ivec"), l0.alias("l0"), c("label").alias("l1"))
    return _rank(O.relaxed_topk(q, i, ["l0", "l1"], 10).select("qid", "iid", "level", "rank"))


# every fourth query asks for the city of its session, every third asks who or what
@query("d09_question_filter", f"""
WITH {S.QLOG}, {S.QUESTIONS}, q AS (SELECT query_id, l AS kw, l[4:6] AS en, CASE WHEN length(query) % 4 = 0 THEN 'c' || (session_id % 3) END AS city,
    CASE length(query) % 9 WHEN 0 THEN 'PERSON' WHEN 3 THEN 'FACTUAL' END AS qt FROM (SELECT *, list_filter(l0, lambda x, i: list_position(l0, x) = i) AS l FROM (SELECT *, {_ORD} AS l0 FROM qlog))),
b AS (SELECT item_id, {S.token_set('question')} AS tk, question_type, 'c' || (item_id % 3) AS city FROM questions),
r AS (SELECT query_id, item_id, 'keyword' AS reason, q.city AS asked, b.city AS found FROM q JOIN b ON len(list_intersect(kw[1:3], tk)) > 0
  UNION ALL SELECT query_id, item_id, 'entity', q.city, b.city FROM q JOIN b ON len(list_intersect(en, tk)) > 0
  UNION ALL SELECT query_id, item_id, 'type', q.city, b.city FROM q JOIN b ON qt = question_type)
SELECT query_id, CAST(item_id AS VARCHAR) AS question_id, reason FROM r WHERE asked IS NULL OR asked = found""")
def d09(t):
    log = M.query_log(t)
    n = F.length("query")
    none = F.array().cast("array<string>")
    extra = log.select("query_id", F.when(n % 4 == 0, F.array(F.concat(F.lit("c"), c("session_id") % 3))).otherwise(none).alias("cities"),
                       F.when(n % 9 == 0, "who").when(n % 9 == 3, "what").alias("question_word"))
    q = O.query_tokens(log).select("query_id", c("tokens").alias("keywords"), F.slice("tokens", 4, 3).alias("entities")).join(extra, "query_id")
    b = M.questions(t).select(c("document_uuid").alias("question_id"), c("tokens").alias("q_keywords"), c("tokens").alias("q_entities"), "question_type",
                              F.concat(F.lit("c"), c("item_id") % 3).alias("location_city"))
    return O.question_filter(q, b)


# pairs that share a token, with the vector of the conversation as query vector

_TQ, _TB = S.token_set("query", RF.SIGNAL_STOPWORDS), S.token_set("text", RF.SIGNAL_STOPWORDS)


@query("d10_validate_question_hits", f"""
WITH {S.QLOG}, q AS (SELECT query_id, session_id, lower({S.strip('query')}) AS ph, {_TQ} AS ts FROM qlog),
b AS (SELECT item_id, lower(text) AS ct, {_TB} AS tk FROM benchmark),
p AS (SELECT query_id, item_id, ph, ct, ts, tk, {S.dist('a.embedding', 'e.embedding')} AS distance FROM q JOIN b ON len(list_intersect(ts, tk)) > 0
  JOIN embeddings a ON a.vec_id = session_id JOIN embeddings e ON e.vec_id = item_id),
m AS (SELECT *, len(list_intersect(ts, tk)) + len(list_filter(ts, lambda x: NOT list_contains(tk, x) AND len(list_filter(tk, lambda y: contains(y, x) OR contains(x, y))) > 0))
    + CAST(length(ph) >= 3 AND (contains(ct, ph) OR contains(ph, ct)) AS INT) AS match_count FROM p WHERE distance < 1.05)
SELECT query_id, CAST(item_id AS VARCHAR) AS question_id, CAST(match_count AS BIGINT) AS match_count FROM m
WHERE len(ts) < 3 OR list_contains(tk, ts[1]) OR len(list_filter(tk, lambda y: contains(y, ts[1]) OR contains(ts[1], y))) > 0""")
def d10(t):
    q = M.query_log(t).select("query_id", "session_id", X.strip(F.lower("query")).alias("ph"), F.array_sort(X.signal_tokens(c("query"))).alias("q_tokens"))
    b = t.benchmark.select("item_id", F.lower("text").alias("ct"), F.array_sort(X.signal_tokens(c("text"))).alias("c_tokens"))
    pairs = (q.select("query_id", F.explode("q_tokens").alias("tok")).join(b.select("item_id", F.explode("c_tokens").alias("tok")), "tok")
             .select("query_id", "item_id").distinct())
    e = t.embeddings.select("vec_id", "embedding")
    h = (pairs.join(q, "query_id").join(b, "item_id").join(e.select(c("vec_id").alias("session_id"), c("embedding").alias("a")), "session_id")
         .join(e.select(c("vec_id").alias("item_id"), c("embedding").alias("b")), "item_id"))
    # the fixture vectors lie far apart: the gate of .40 is applied to distance - .65
    h = h.withColumns({"distance": F.round(O.cosine_distance(c("a"), c("b")), 9) - 0.65, "q_phrases": F.array("ph"), "c_phrases": F.array("ct"),
                       "q_subject": F.slice("q_tokens", 1, 1), "location_tokens": F.array().cast("array<string>")})
    v = O.validate_question_hits(h)
    return v.select("query_id", c("item_id").cast("string").alias("question_id"), c("match_count").cast("bigint").alias("match_count"))


_QHITS = """qh AS (SELECT query_id, document_uuid, row_number() OVER (PARTITION BY query_id ORDER BY text_match, document_uuid DESC) AS qr FROM hits)"""


@query("d11_merge_candidates", f"""
WITH {S.CAND}, {_QHITS}, k AS (SELECT query_id, document_uuid, candidate_rank AS kr FROM cand), j AS (
  SELECT coalesce(k.query_id, q.query_id) AS query_id, coalesce(k.document_uuid, q.document_uuid) AS document_uuid, kr, qr,
    CASE WHEN kr IS NOT NULL AND qr IS NOT NULL THEN 0 WHEN kr IS NOT NULL THEN 1 ELSE 2 END AS source
  FROM k FULL JOIN qh q ON k.query_id = q.query_id AND k.document_uuid = q.document_uuid)
SELECT query_id, document_uuid, source, row_number() OVER (PARTITION BY query_id ORDER BY source, coalesce(kr, qr), document_uuid) AS candidate_rank FROM j""")
def d11(t):
    d, index = M.documents(t), M.keyword_index(t)
    q = materialize(O.query_tokens(M.query_log(t)), "merge-tokens")
    found = materialize(IX.all_hits(q, index), "merge-hits")  # ranked in two ways
    kw = O.keyword_candidates(M.query_log(t), d, index=index, hits=found)
    hits = q.select("query_id", "token_key").join(found, "token_key")
    qn = O.top_k(hits, ["query_id"], [F.asc("text_match"), F.desc("document_uuid")], None, rank="candidate_rank")
    return _rank(O.merge_candidates(kw, qn).select("query_id", "document_uuid", c("source").cast("bigint").alias("source"), "candidate_rank"), "candidate_rank")


_RR = f"""{S.CAND}, dv AS (SELECT CAST(vec_id AS VARCHAR) AS document_uuid, embedding FROM embeddings), qv AS (SELECT query_id, embedding AS qe FROM qlog LEFT JOIN embeddings ON session_id = vec_id),
rr AS (SELECT query_id, document_uuid, candidate_rank, CASE WHEN embedding IS NULL OR qe IS NULL THEN 1.0 ELSE {S.dist('embedding', 'qe')} END AS vector_distance
  FROM cand LEFT JOIN dv USING (document_uuid) LEFT JOIN qv USING (query_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector_distance, candidate_rank, document_uuid) AS semantic_rank FROM rr)"""


def _vectors(t):
    dv = t.embeddings.select(c("vec_id").cast("string").alias("document_uuid"), "embedding")
    qv = M.query_log(t).join(t.embeddings.select(c("vec_id").alias("session_id"), c("embedding").alias("query_embedding")), "session_id", "left")
    return dv, qv.select("query_id", "query_embedding")


def _reranked(t, fields=False):
    dv, qv = _vectors(t)
    return O.rerank(O.keyword_candidates(M.query_log(t), M.documents(t), index=M.keyword_index(t), fields=fields, carry=O.query_side(qv)), dv, qv)


@query("d12_rerank", f"WITH {_RR} SELECT query_id, document_uuid, round(vector_distance, 6) AS vector_distance, semantic_rank FROM rk")
def d12(t):
    return _reranked(t).select("query_id", "document_uuid", F.round("vector_distance", 6).alias("vector_distance"), c("semantic_rank").cast("bigint").alias("semantic_rank"))


_MODES = ["answer", "explore", "compare", "browse", "local", "shop", "other"]
_MODE_SQL = "CASE length(query_id) % 7 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MODES)) + " END"


def _mode(col="query_id"):
    return F.get(F.array(*[F.lit(m) for m in _MODES]), F.length(col) % 7)


@query("d13_prune_by_distance", f"""
WITH {_RR}, m(mode, lim) AS ({S.values(list(R.DISTANCE_LIMITS.items()))})
SELECT query_id, document_uuid FROM rk LEFT JOIN m ON mode = {_MODE_SQL} WHERE vector_distance <= coalesce(lim, 0.75)""")
def d13(t):
    return O.prune_by_distance(_reranked(t).withColumn("query_mode", _mode())).select("query_id", "document_uuid")


@query("d14_attach_metadata", f"""
WITH {_RR} SELECT query_id, semantic_rank, document_uuid, document_title, source, authority_rank_score FROM rk JOIN docs USING (document_uuid)""")
def d14(t):
    r = O.attach_metadata(_reranked(t), M.documents(t), ["document_title", "source", "authority_rank_score"])
    return _rank(r.select("query_id", "semantic_rank", "document_uuid", "document_title", "source", "authority_rank_score"), "semantic_rank")


@query("d15_apply_rank", f"""
WITH {_RR}, x AS (SELECT c.query_id, c.document_uuid, coalesce(r.semantic_rank, 999999) AS sr, coalesce(r.vector_distance, 1.0) AS vd
  FROM cand c LEFT JOIN (SELECT * FROM rk WHERE vector_distance < 1.0) r ON c.query_id = r.query_id AND c.document_uuid = r.document_uuid)
SELECT query_id, document_uuid, sr AS semantic_rank, row_number() OVER (PARTITION BY query_id ORDER BY sr, document_uuid) AS rank FROM x""")
def d15(t):
    dv, qv = _vectors(t)
    d, index = M.documents(t), M.keyword_index(t)
    found = materialize(IX.all_hits(O.query_tokens(M.query_log(t)), index), "rank-hits")  # ranked in two ways
    cands, lying = (O.keyword_candidates(M.query_log(t), d, index=index, hits=found, carry=x) for x in (None, O.query_side(qv)))
    r = O.apply_rank(cands, O.rerank(lying, dv, qv).where(c("vector_distance") < 1.0))
    return _rank(r.select("query_id", "document_uuid", c("semantic_rank").cast("bigint").alias("semantic_rank"), "rank"))


def _group_sql(key, k, src="docs"):
    return f"""SELECT s.document_uuid AS seed_id, d.document_uuid, row_number() OVER w AS rank FROM {src} s JOIN {src} d ON s.{key} = d.{key} AND s.document_uuid <> d.document_uuid
WHERE s.{key} IS NOT NULL AND CAST(s.{key} AS VARCHAR) <> '' WINDOW w AS (PARTITION BY s.document_uuid ORDER BY d.authority_rank_score DESC, d.document_uuid) QUALIFY row_number() OVER w <= {k}"""


@query("d16_same_subject", f"WITH {S.DOCS} {_group_sql('source', 20)}")
def d16(t):
    d = M.documents(t).select("document_uuid", "source", "authority_rank_score")
    return _rank(O.same_group(d, d, "source", 20).select("seed_id", "document_uuid", "rank"))


_DE = f"{S.DOCS}, de AS (SELECT docs.*, label AS grp, label % 4 AS cl, embedding FROM docs LEFT JOIN embeddings ON doc_id = vec_id)"


def _de(t):
    return M.documents(t, embeddings=True).withColumns({"grp": c("cluster_uuid"), "cl": (c("cluster_uuid").cast("int") % 4)})


@query("d17_same_group", f"WITH {_DE} {_group_sql('grp', 5, 'de')}")
def d17(t):
    d = _de(t).select("document_uuid", "grp", "authority_rank_score")
    return _rank(O.same_group(d, d, "grp", 5).select("seed_id", "document_uuid", "rank"))


@query("d18_same_cluster", f"WITH {_DE} {_group_sql('cl', 5, 'de')}")
def d18(t):
    d = _de(t).select("document_uuid", "cl", "authority_rank_score")
    return _rank(O.same_group(d, d, "cl", 5).select("seed_id", "document_uuid", "rank"))


_SEM = f"""{S.DOCS}, sm AS (SELECT document_uuid, 'p' || (doc_id % 10) || '-' || (doc_id % 3) || '-' || lpad(CAST(doc_id AS VARCHAR), 4, '0') AS su, 'p' || (doc_id % 10) || '-' || (doc_id % 3) AS cl, embedding
  FROM docs LEFT JOIN embeddings ON doc_id = vec_id)"""
_CM = """cm AS (SELECT s.document_uuid AS seed_id, d.document_uuid, d.su, row_number() OVER (PARTITION BY s.document_uuid ORDER BY d.su, d.document_uuid) AS rank
  FROM sm s JOIN sm d ON s.cl = d.cl AND s.document_uuid <> d.document_uuid QUALIFY rank <= {k})"""


def _sem(t):
    d = t.documents.select("doc_id").join(t.embeddings, c("doc_id") == c("vec_id"), "left")
    return d.select(c("doc_id").cast("string").alias("document_uuid"), F.concat_ws(
        "-", F.concat(F.lit("p"), c("doc_id") % 10), c("doc_id") % 3, F.lpad(c("doc_id").cast("string"), 4, "0")).alias("semantic_uuid"), "embedding")


@query("d19_cluster_members", f"WITH {_SEM}, {_CM.format(k=10)} SELECT seed_id, document_uuid, su AS semantic_uuid, rank FROM cm")
def d19(t):
    d = _sem(t)
    return _rank(O.cluster_members(d, d, 10))


@query("d20_similar_documents", f"""
WITH {_SEM}, {_CM.format(k=24)}, v AS (SELECT s.document_uuid AS seed_id, d.document_uuid, row_number() OVER (PARTITION BY s.document_uuid ORDER BY {S.dist('s.embedding', 'd.embedding')}, d.document_uuid) AS r
  FROM sm s JOIN sm d ON s.document_uuid <> d.document_uuid WHERE s.embedding IS NOT NULL AND d.embedding IS NOT NULL),
o AS (SELECT seed_id, document_uuid, min((source, r)) AS m FROM (SELECT seed_id, document_uuid, 0 AS source, rank AS r FROM cm UNION ALL SELECT seed_id, document_uuid, 1, r FROM v WHERE r <= 48) GROUP BY 1, 2)
SELECT seed_id, document_uuid, CAST(m[1] AS BIGINT) AS source, row_number() OVER (PARTITION BY seed_id ORDER BY m) AS rank FROM o QUALIFY rank <= 24""")
def d20(t):
    d = _sem(t)
    return _rank(O.similar_documents(d, d, 24).withColumn("source", c("source").cast("bigint")))


# the results of a query are its session's documents; a question belongs to the document of its number modulo 20
@query("d21_related_questions", f"""
WITH {S.QLOG}, r AS (SELECT query_id, query, session_id % 20 AS doc, 1 AS rr FROM qlog UNION ALL SELECT query_id, query, (session_id + 1) % 20, 2 FROM qlog)
SELECT query_id, item_id AS question_id, row_number() OVER w AS rank FROM r JOIN benchmark ON doc = item_id % 20
WHERE {S.normalize_query('text')} <> {S.normalize_query('query')} WINDOW w AS (PARTITION BY query_id ORDER BY rr, item_id) QUALIFY row_number() OVER w <= 10""")
def d21(t):
    q = M.query_log(t)
    r = q.select("query_id", "query", (c("session_id") % 20).alias("document_uuid"), F.lit(1).alias("rank")).unionAll(
        q.select("query_id", "query", (c("session_id") + 1) % 20, F.lit(2)))
    qs = t.benchmark.select((c("item_id") % 20).alias("document_uuid"), c("item_id").alias("question_id"), c("text").alias("question"))
    return _rank(O.related_questions(r, qs, 10))


@query("d22_question_answer_set", f"""
WITH {_DE}, s AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS document_uuid FROM benchmark),
sub AS ({_group_sql('primary_subject_name', 20, 'de')}), cl AS ({_group_sql('grp', 5, 'de')}),
al AS (SELECT document_uuid AS seed_id, document_uuid, 0 AS source, 0 AS r FROM s UNION ALL SELECT seed_id, document_uuid, 1, rank FROM sub WHERE seed_id IN (SELECT document_uuid FROM s)
  UNION ALL SELECT seed_id, document_uuid, 2, rank FROM cl WHERE seed_id IN (SELECT document_uuid FROM s))
SELECT seed_id, document_uuid, CAST(min((source, r))[1] AS BIGINT) AS source, CAST(min((source, r))[2] AS BIGINT) AS r FROM al GROUP BY 1, 2""")
def d22(t):
    d = _de(t).select("document_uuid", "primary_subject_name", c("grp").alias("cluster_uuid"), "authority_rank_score")
    clicks = t.benchmark.select(c("item_id").cast("string").alias("document_uuid"))
    a = O.answer_set(clicks, d)
    return a.withColumns({"source": c("source").cast("bigint"), "r": c("r").cast("bigint")})


@query("d23_quick_search", f"""
WITH {S.QLOG}, {S.DOCS}, {S.posting_sql({'document_title': 2, 'key_facts': 1})}, {S.QT}, {S.HITS}, {S.STAR},
qv AS (SELECT query_id, CASE WHEN session_id % 2 = 0 THEN embedding END AS qe FROM qlog LEFT JOIN embeddings ON session_id = vec_id),
v AS (SELECT query_id, document_uuid, row_number() OVER (PARTITION BY query_id ORDER BY {S.dist('embedding', 'qe')}, document_uuid) AS rank
  FROM qv, (SELECT document_uuid, embedding FROM docs JOIN embeddings ON doc_id = vec_id) WHERE qe IS NOT NULL),
k AS (SELECT query_id, h.document_uuid, row_number() OVER (PARTITION BY query_id ORDER BY text_match DESC, authority_rank_score DESC, h.document_uuid) AS rank
  FROM (SELECT * FROM hits UNION ALL SELECT * FROM star) h JOIN docs USING (document_uuid) WHERE query_id IN (SELECT query_id FROM qv WHERE qe IS NULL))
SELECT query_id, document_uuid, 'vector' AS how, rank FROM v WHERE rank <= 10 UNION ALL SELECT query_id, document_uuid, 'keyword', rank FROM k WHERE rank <= 10""")
def d23(t):
    q = M.query_log(t).join(_vectors(t)[1], "query_id").withColumn("query_embedding", F.when(c("session_id") % 2 == 0, c("query_embedding")))
    return _rank(O.quick_search(q, M.documents(t, embeddings=True), 10, M.keyword_index(t, O.QUICK_WEIGHTS, "quick", bits=())))


@query("d24_attach_embeddings", f"""
WITH h AS (SELECT substring(md5({S.normalize_query('text')}), 1, 16) AS text_hash, any_value(embedding) AS e FROM benchmark JOIN embeddings ON item_id = vec_id GROUP BY 1)
SELECT item_id, round(CAST(e[1] AS DOUBLE), 6) AS first_value, CAST(len(e) AS BIGINT) AS width FROM benchmark
LEFT JOIN h ON substring(md5({S.normalize_query('text')}), 1, 16) = text_hash""")
def d24(t):
    vec = M.questions(t).where(c("embedding").isNotNull()).select(X.store_hash(c("question")).alias("text_hash"), "embedding").dropDuplicates(["text_hash"])
    r = O.attach_embeddings(t.benchmark, "text", vec)
    return r.select("item_id", F.round(c("embedding")[0].cast("double"), 6).alias("first_value"), F.size("embedding").cast("bigint").alias("width"))


def hash_embed(frames):
    """Stand-in for a model: four numbers from the text's digest."""
    for f in frames:
        yield pd.DataFrame({"text_hash": f.text_hash, "embedding": [
            [b / 255 for b in hashlib.md5(x.encode()).digest()[:4]] for x in f.text]})


# a model function is applied only to texts without a stored vector
@query("d24_attach_embeddings_model", f"""
WITH h AS (SELECT DISTINCT substring(md5({S.normalize_query('text')}), 1, 16) AS text_hash, len(embedding) AS n FROM benchmark JOIN embeddings ON item_id = vec_id WHERE item_id % 2 = 0)
SELECT item_id, CAST(coalesce(n, 4) AS BIGINT) AS width FROM benchmark LEFT JOIN h ON substring(md5({S.normalize_query('text')}), 1, 16) = text_hash""")
def d24_model(t):
    vec = M.questions(t).where((c("item_id") % 2 == 0) & c("embedding").isNotNull()).select(X.store_hash(c("question")).alias("text_hash"), "embedding").dropDuplicates(["text_hash"])
    return O.attach_embeddings(t.benchmark, "text", vec, embed=hash_embed).select("item_id", F.size("embedding").cast("bigint").alias("width"))


@query("d25_related_business", """
SELECT s.p_partkey AS seed_id, d.p_partkey, row_number() OVER w AS rank FROM part s JOIN part d ON s.p_type = d.p_type AND s.p_partkey <> d.p_partkey
WINDOW w AS (PARTITION BY s.p_partkey ORDER BY d.p_retailprice DESC, d.p_partkey) QUALIFY row_number() OVER w <= 4""")
def d25(t):
    p = t.part.select("p_partkey", "p_type", "p_retailprice")
    return _rank(O.same_group(p, p, "p_type", 4, [F.desc("p_retailprice"), F.asc("p_partkey")], "p_partkey").select("seed_id", "p_partkey", "rank"))


@query("d26_map_locations", """
WITH x AS (SELECT c_nationkey AS query_id, c_custkey, CAST(c_custkey % 200 - 99 AS DOUBLE) AS lat, c_acctbal / 50 AS lng, c_custkey AS rank FROM customer),
v AS (SELECT * FROM x WHERE lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180)
SELECT query_id, c_custkey, 'https://www.google.com/maps/search/?api=1&query=' || printf('%.6f', lat) || ',' || printf('%.6f', lng) AS map_url,
  'https://www.google.com/maps/dir/?api=1&destination=' || printf('%.6f', lat) || ',' || printf('%.6f', lng) AS directions_url,
  rank = min(rank) OVER (PARTITION BY query_id) AS is_card FROM v""")
def d26(t):
    r = t.customer.select(c("c_nationkey").alias("query_id"), "c_custkey", (c("c_custkey") % 200 - 99).cast("double").alias("lat"),
                          (c("c_acctbal") / 50).alias("lng"), c("c_custkey").alias("rank"))
    return O.map_locations(r).select("query_id", "c_custkey", "map_url", "directions_url", "is_card")
