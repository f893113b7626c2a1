"""Scores of candidate rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import sqlkit as S
from lodestone.catalog.registry import query
from lodestone.catalog.section_d import _MODE_SQL, _RR, _mode, _reranked
from lodestone.functions import text as X
from lodestone.operators import retrieve as RT
from lodestone.operators import score as O
from lodestone.plans import jobs as J
from lodestone.rules import scoring as R
from lodestone.sources import mapping as M

c = F.col


def _r(e, n=6):
    return f"round({e}, {n})"


@query("e01_cosine_similarity", """
SELECT a.vec_id, round(greatest(0, least(1, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def e01(t):
    b = t.embeddings.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("e2"))
    return t.embeddings.join(b, "vec_id").select("vec_id", F.round(O.cosine_similarity(c("embedding"), c("e2")), 6).alias("similarity"))


@query("e02_semantic_score", f"""
WITH {_RR} SELECT query_id, document_uuid, round(CASE WHEN vector_distance >= 0.65 THEN 0 ELSE 1 - vector_distance / 0.65 END, 6) AS sem_score FROM rr""")
def e02(t):
    return _reranked(t).select("query_id", "document_uuid", F.round(O.semantic_score(c("vector_distance")), 6).alias("sem_score"))


_RICH = ("least(least(content_depth_score / 100, 1) * 0.35 + least(word_count / 3000.0::DOUBLE, 1) * 0.05 "
         "+ CASE WHEN len(key_facts) >= 3 THEN 0.05 ELSE 0 END, 1)")
_AUTH = "least(least(authority_rank_score / 100, 1) * 0.35 + least(content_depth_score / 100, 1) * 0.20, 1)"


@query("e03_richness", f"WITH {S.DOCS} SELECT document_uuid, {_r(_RICH)} AS richness FROM docs")
def e03(t):
    d = M.documents(t).withColumn("n_facts", F.size("key_facts"))
    return d.select("document_uuid", F.round(O.richness(d), 6).alias("richness"))


@query("e04_authority", f"""
WITH {S.PRODUCTS}, {S.EATERIES}, {S.DOCS}
SELECT 'p' || p_partkey AS id, round(CASE WHEN product_rating > 0 AND product_review_count > 0
  THEN least(product_rating / 5 * least(ln(1 + product_review_count) / ln(501), 1), 1) ELSE 0 END, 6) AS auth_score FROM products
UNION ALL SELECT 's' || s_suppkey, round(CASE WHEN service_rating > 0 AND service_review_count > 0
  THEN least(service_rating / 5 * least(ln(1 + service_review_count) / ln(501), 1), 1) ELSE 0 END, 6) FROM eateries
UNION ALL SELECT 'd' || document_uuid, {_r(_AUTH)} FROM docs""")
def e04(t):
    p = M.products(t).withColumn("document_data_type", F.lit("product"))
    s = M.eateries(t).withColumn("document_data_type", F.lit("business"))
    d = M.documents(t)
    outs = [(p, "p", "p_partkey"), (s, "s", "s_suppkey"), (d, "d", "document_uuid")]
    parts = [x.select(F.concat(F.lit(k), c(i)).alias("id"), F.round(O.authority(x), 6).alias("auth_score")) for x, k, i in outs]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _toks(f):
    return f"{S.token_set(S.field_text(f))} AS t_{f}"


_LOWER = "list_transform({}, lambda z: lower(z))"
FEAT = f"""ft AS (SELECT document_uuid, lang AS document_data_type, source AS document_category, source AS document_schema, primary_subject_type, primary_subject_confidence,
  {_RICH} AS richness, {_AUTH} AS auth_score, {S.token_set('primary_subject_name')} AS t_subject, {S.token_set("array_to_string(secondary_subjects, ' ')")} AS t_secondary,
  lower(primary_subject_name) AS l_subject, {_LOWER.format('secondary_subjects')} AS l_secondary, lower(document_title) AS l_title,
  lower(array_to_string(entity_names, ' ')) AS l_entities, {_LOWER.format('primary_keywords')} AS l_keywords, {', '.join(_toks(f) for f in R.FIELD_WEIGHTS)} FROM docs),
qs AS (SELECT q.query_id, ts, CASE WHEN contains(lower(query), ' ') THEN lower(query) END AS ph, {_MODE_SQL.replace('query_id', 'q.query_id')} AS query_mode,
  CASE length(query) % 3 WHEN 0 THEN 'who' WHEN 1 THEN 'where' ELSE 'what' END AS question_word,
  CASE length(query) % 2 WHEN 0 THEN 'food' END AS primary_domain, length(query) % 5 = 0 AS has_unknown_terms, length(query) % 4 = 0 AS has_superlative,
  length(query) % 7 = 0 AS has_rating_signal, length(query) % 2 = 0 AS wants_single_result FROM qlog q JOIN qt ON q.query_id = qt.query_id),
sm0 AS (SELECT r.query_id, r.document_uuid, r.candidate_rank - 1 AS cr, vector_distance, count(*) OVER (PARTITION BY r.query_id) AS pool, ft.* EXCLUDE (document_uuid), qs.* EXCLUDE (query_id),
  len(list_intersect(t_subject, ts)) > 0 OR (l_subject <> '' AND ph IS NOT NULL AND (contains(l_subject, ph) OR contains(ph, l_subject))) AS prim,
  len(list_intersect(t_secondary, ts)) > 0 OR (ph IS NOT NULL AND len(list_filter(l_secondary, lambda z: contains(z, ph) OR contains(ph, z))) > 0) AS sec,
  len(list_intersect(ts, list_concat(t_primary_keywords, t_entity_names, t_document_title, t_key_facts, t_semantic_keywords, t_topic_tags))) > 0 AS mixed,
  (question_word = 'who' AND primary_subject_type = 'PERSON') OR (question_word = 'where' AND primary_subject_type IN ('PLACE', 'LANDMARK'))
    OR (question_word = 'what' AND primary_subject_type IN ('CONCEPT', 'WORK', 'PRODUCT')) AS aligned
  FROM rr r JOIN ft USING (document_uuid) JOIN qs ON r.query_id = qs.query_id),
sm AS (SELECT *, CASE WHEN len(ts) = 0 AND ph IS NULL THEN 1.0::DOUBLE WHEN prim THEN CASE primary_subject_confidence WHEN 'HIGH' THEN 1.6 WHEN 'LOW' THEN 1.1 ELSE 1.3 END * CASE WHEN aligned THEN 1.2 ELSE 1 END
    WHEN sec THEN 1.15 WHEN mixed THEN 0.7 ELSE 1.0 END AS mult,
  CASE WHEN len(ts) = 0 AND ph IS NULL THEN 'neutral_no_query' WHEN prim THEN 'primary_' || lower(primary_subject_confidence) || CASE WHEN aligned THEN '+type_match' ELSE '' END
    WHEN sec THEN 'secondary' WHEN mixed THEN 'no_subject_match_penalty' ELSE 'neutral' END AS reason,
  CASE WHEN len(ts) > 0 THEN ({' + '.join(f'len(list_intersect(ts, t_{f})) / len(ts) * {w}' for f, w in R.FIELD_WEIGHTS.items())}) / {sum(R.FIELD_WEIGHTS.values())}::DOUBLE END AS ov FROM sm0),
t1 AS (SELECT *, least(ov + CASE WHEN ph IS NOT NULL AND (contains(l_title, ph) OR contains(l_entities, ph)) THEN 0.15 ELSE 0 END, 1) AS m1 FROM sm),
t2 AS (SELECT *, least(least(m1 + (1 - cr / greatest(pool, 1)) * 0.05, 1) + least(len(list_intersect(l_keywords, ts)) * 0.05, 0.15), 1) AS m2 FROM t1),
tx AS (SELECT *, least((CASE WHEN len(ts) = 0 THEN 1 - cr / greatest(pool, 1) * 0.5 WHEN richness < 0.3 THEN least(m2, 0.5) ELSE m2 * (0.7 + 0.3 * richness) END) * mult, 1) AS text_score FROM t2)"""
FULL = f"{_RR}, {FEAT}"


def _phrases(t):
    q = M.query_log(t)
    low = F.lower("query")
    return q.select("query_id", F.when(low.contains(" "), F.array(low)).otherwise(F.array().cast("array<string>")).alias("q_phrases"),
                    X.match_tokens(c("query")).alias("q_keywords"))


def _sig(t):
    n = F.length("query")
    return M.query_log(t).select(
        "query_id", _mode().alias("query_mode"), F.when(n % 3 == 0, "who").when(n % 3 == 1, "where").otherwise("what").alias("question_word"),
        F.when(n % 2 == 0, "food").alias("primary_domain"), (n % 5 == 0).alias("has_unknown_terms"), (n % 4 == 0).alias("has_superlative"),
        (n % 7 == 0).alias("has_rating_signal"), (n % 2 == 0).alias("wants_single_result"), F.lit(False).alias("has_black_owned"))


def _scored(t):
    cands = _reranked(t, fields=True).select("query_id", "document_uuid", "candidate_rank", "vector_distance", "fields")
    return J.score_candidates(cands, M.documents(t), M.query_log(t), _sig(t), _phrases(t))


@query("e05_subject_multiplier", f"WITH {FULL} SELECT query_id, document_uuid, {_r('mult')} AS subject_multiplier, reason AS subject_match_reason FROM sm")
def e05(t):
    return _scored(t).select("query_id", "document_uuid", F.round("subject_multiplier", 6).alias("subject_multiplier"), "subject_match_reason")


@query("e06_text_score", f"WITH {FULL} SELECT query_id, document_uuid, {_r('coalesce(ov, 0)')} AS field_overlap, {_r('text_score + 1e-12')} AS text_score FROM tx")
def e06(t):
    return _scored(t).select("query_id", "document_uuid", F.round("field_overlap", 6).alias("field_overlap"), F.round(c("text_score") + 1e-12, 6).alias("text_score"))


# sources stand for categories: four of them named after categories of the domain table
_CATS = {"src1": "dining", "src2": "food_recipes", "src3": "seafood"}
_CAT = "CASE source " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CATS.items()) + " ELSE source END"


@query("e07_domain_relevance", f"""
SELECT doc_id, CASE WHEN lang = 'en' THEN 1.0 WHEN lang = 'fr' THEN CASE WHEN {_CAT} IN ('food_recipes', 'dining', 'lifestyle') OR doc_id % 5 = 0 THEN 1.15 WHEN contains({_CAT}, 'food') THEN 1.10 ELSE 0.75 END
  WHEN lang = 'de' THEN 0.75 ELSE 1.0 END::DOUBLE AS relevance FROM documents""")
def e07(t):
    cat = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _CATS.items() for x in kv]), c("source")), c("source"))
    dom = F.when(c("lang") == "fr", "food").when(c("lang") == "de", "music").when(c("lang") == "es", "unheard")
    serv = F.when((c("doc_id") % 5 == 0) & (c("lang") == "fr"), F.array(F.lit("Food Truck"))).otherwise(F.array(F.lit("none")))
    return t.documents.select("doc_id", O.domain_relevance(dom, cat, cat, serv).alias("relevance"))


_CI = "CASE source WHEN 'src1' THEN 'informational' WHEN 'src2' THEN 'transactional' WHEN 'src3' THEN '' ELSE 'commercial' END"


@query("e08_intent_match", f"""
WITH p(mode, want) AS ({S.values([(m, w) for m, ws in R.INTENT_CONTENT.items() for w in ws])}),
d AS (SELECT doc_id, {_CI} AS ci, CASE doc_id % 7 {' '.join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(['answer', 'explore', 'compare', 'browse', 'local', 'shop', 'other']))} END AS mode FROM documents)
SELECT doc_id, CASE WHEN ci = '' OR mode = 'other' THEN 1.0 WHEN EXISTS (SELECT 1 FROM p WHERE p.mode = d.mode AND want = ci) THEN 1.10 ELSE 0.85 END::DOUBLE AS factor FROM d""")
def e08(t):
    ci = F.when(c("source") == "src1", "informational").when(c("source") == "src2", "transactional").when(c("source") == "src3", "").otherwise("commercial")
    mode = F.get(F.array(*[F.lit(m) for m in ("answer", "explore", "compare", "browse", "local", "shop", "other")]), (c("doc_id") % 7).cast("int"))
    return t.documents.select("doc_id", O.intent_match(mode, ci).alias("factor"))


@query("e09_pool_multiplier", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN lang IN ('en', 'fr') THEN 1.0 ELSE 0.5 END ELSE CASE WHEN lang = 'en' THEN 1.0 ELSE 0.5 END END::DOUBLE AS factor FROM documents""")
def e09(t):
    dt = F.when(c("lang") == "en", "article").when(c("lang") == "fr", "Person").when(c("lang") == "de", "business").otherwise("recipe")
    mode = F.when(c("doc_id") % 2 == 0, "explore").otherwise("answer")
    dt = F.when((c("doc_id") % 2 == 1) & (c("lang") == "fr"), "product").otherwise(dt)
    return t.documents.select("doc_id", O.pool_multiplier(mode, dt).alias("factor"))


_BASE = ["CASE query_mode " + " ".join(f"WHEN '{m}' THEN {v[i]}" for m, v in R.BLEND_RATIOS.items()) + f" ELSE {R.BLEND_RATIOS['explore'][i]} END::DOUBLE" for i in range(3)]
BLEND = f"""av AS (SELECT query_id, avg(auth_score) FILTER (cr < 20) AS a FROM sm0 GROUP BY 1),
b0 AS (SELECT qs.*, coalesce(a, 0) >= 0.05 AS live, {_BASE[0]} AS t0, {_BASE[1]} AS s0, {_BASE[2]} AS a0 FROM qs LEFT JOIN av ON qs.query_id = av.query_id),
b1 AS (SELECT *, CASE WHEN live THEN s0 ELSE s0 + a0 END AS s1, CASE WHEN live THEN a0 ELSE 0 END AS a1, CASE WHEN has_unknown_terms THEN least(0.15, t0) ELSE 0 END AS x1 FROM b0),
b2 AS (SELECT *, t0 - x1 AS t2, s1 + x1 AS s2, CASE WHEN has_superlative AND live THEN least(0.10, s1 + x1) ELSE 0 END AS x2 FROM b1),
b3 AS (SELECT *, s2 - x2 AS s3, a1 + x2 AS a3, CASE WHEN has_rating_signal AND live THEN least(0.10, t2) ELSE 0 END AS x3 FROM b2),
bl AS (SELECT query_id, CASE WHEN query_mode = 'answer' AND wants_single_result THEN 0.65 ELSE t2 - x3 END AS wt,
  CASE WHEN query_mode = 'answer' AND wants_single_result THEN 0.25 ELSE s3 END AS ws, CASE WHEN query_mode = 'answer' AND wants_single_result THEN 0.10 ELSE a3 + x3 END AS wa FROM b3)"""


@query("e10_resolve_blend", f"WITH {FULL}, {BLEND} SELECT query_id, {_r('wt')} AS w_text, {_r('ws')} AS w_semantic, {_r('wa')} AS w_authority FROM bl")
def e10(t):
    cands = _reranked(t).select("query_id", "document_uuid", (c("candidate_rank") - 1).alias("candidate_rank"))
    feats = O.document_features(M.documents(t)).select("document_uuid", "auth_score")
    b = O.resolve_blend(cands.join(feats, "document_uuid"), _sig(t))
    return b.select("query_id", *[F.round(x, 6).alias(x) for x in ("w_text", "w_semantic", "w_authority")])


FINAL = f"""sc0 AS (SELECT tx.*, wt * text_score + ws * CASE WHEN vector_distance >= 0.65 THEN 0 ELSE 1 - vector_distance / 0.65 END + wa * auth_score AS b FROM tx JOIN bl ON tx.query_id = bl.query_id),
sc AS (SELECT *, b * CASE WHEN primary_domain IS NULL THEN 1 ELSE 0.75 END * CASE WHEN query_mode = 'other' THEN 1 ELSE 0.5 END AS b1 FROM sc0),
fin AS (SELECT *, CASE WHEN has_superlative AND auth_score = 0 THEN least(b1, 0.7) ELSE b1 END AS blended,
  row_number() OVER (PARTITION BY query_id ORDER BY round(CASE WHEN has_superlative AND auth_score = 0 THEN least(b1, 0.7) ELSE b1 END, 9) DESC, document_uuid) AS rank FROM sc)"""


@query("e11_score_documents", f"WITH {FULL}, {BLEND}, {FINAL} SELECT query_id, document_uuid, {_r('blended + 1e-12', 9)} AS blended_score FROM fin")
def e11(t):
    return _scored(t).select("query_id", "document_uuid", F.round(c("blended_score") + 1e-12, 9).alias("blended_score"))


# ranked by the text score, which the SQL can state without the order depending on the last digit
@query("e12_rank_results", f"""
WITH {FULL} SELECT query_id, document_uuid, row_number() OVER (PARTITION BY query_id ORDER BY round(text_score, 9) DESC, document_uuid) AS rank FROM tx""")
def e12(t):
    return O.rank_results(_scored(t).drop("rank"), "text_score").select("query_id", "document_uuid", c("rank").cast("bigint").alias("rank"))


@query("e13_subject_floor", f"""
WITH {FULL} SELECT query_id, document_uuid, split_part(reason, '+', 1) <> 'no_subject_match_penalty'
  AND (split_part(reason, '+', 1) LIKE 'primary_%' OR split_part(reason, '+', 1) = 'secondary' OR text_score >= 0.08) AS floor_keep FROM tx""")
def e13(t):
    return O.subject_floor(_scored(t)).select("query_id", "document_uuid", "floor_keep")


@query("e14_subject_routing", f"""
WITH {FULL} SELECT 'reason' AS dim, split_part(reason, '+', 1) AS value, count(*) AS n FROM tx GROUP BY 2
UNION ALL SELECT 'type', primary_subject_type, count(*) FROM tx GROUP BY 2 UNION ALL SELECT 'confidence', primary_subject_confidence, count(*) FROM tx GROUP BY 2""")
def e14(t):
    return O.subject_routing_summary(_scored(t))


@query("e15_legacy_blend", f"""
WITH {_RR}, x AS (SELECT rk.*, authority_rank_score AS au, count(*) OVER w AS n, min(vector_distance) FILTER (vector_distance < 1) OVER w AS best FROM rk JOIN docs USING (document_uuid)
  WINDOW w AS (PARTITION BY query_id))
SELECT query_id, document_uuid, round(0.3 * (1 - (candidate_rank - 1) / n) + 0.5 * (1 - semantic_rank / n) + 0.2 * least(au / 100, 1)
  - CASE WHEN vector_distance > least(coalesce(best, 1.0) * 2, 0.85) THEN 1 ELSE 0 END + 1e-12, 6) AS legacy_score FROM x""")
def e15(t):
    r = RT.attach_metadata(_reranked(t), M.documents(t), ["authority_rank_score"]).withColumns({
        "candidate_rank": c("candidate_rank") - 1, "authority_score": c("authority_rank_score"),
        "w_text": F.lit(0.3), "w_semantic": F.lit(0.5), "w_authority": F.lit(0.2)})
    return O.legacy_blend(r).select("query_id", "document_uuid", F.round(c("legacy_score") + 1e-12, 6).alias("legacy_score"))


@query("e16_hybrid_score", f"""
WITH {_RR}, x AS (SELECT query_id, document_uuid, greatest(0, 1 - vector_distance) AS s, text_match * 1000003 / 100000000 AS tm, authority_rank_score / 100 AS a
  FROM rk JOIN cand USING (query_id, document_uuid) JOIN docs USING (document_uuid))
SELECT query_id, document_uuid, round(least(1, CASE WHEN tm > 0 THEN s * 0.5 + tm * 0.3 + a * 0.2 ELSE s * 0.7 + a * 0.3 END), 4) AS score FROM x""")
def e16(t):
    r = RT.attach_metadata(_reranked(t), M.documents(t), ["authority_rank_score"])
    return r.select("query_id", "document_uuid", O.hybrid_score(c("vector_distance"), c("text_match") * 1000003, c("authority_rank_score")).alias("score"))
