"""Facets, grouping, sorts, limits and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import sqlkit as S
from lodestone.catalog.registry import query
from lodestone.functions import text as X
from lodestone.operators import facets as O
from lodestone.rules import scoring as R
from lodestone.sources import mapping as M

c = F.col
TYPES = {"en": "article", "fr": "video", "de": "person", "es": "location"}


@query("f01_facet_counts", """
SELECT field, value, n, CASE WHEN field = 'document_schema' THEN value ELSE upper(value[1]) || value[2:] END AS label FROM (
  SELECT 'document_data_type' AS field, lang AS value, count(*) AS n FROM documents GROUP BY 2
  UNION ALL SELECT 'document_category', source, count(*) FROM documents GROUP BY 2
  UNION ALL SELECT 'document_schema', source, count(*) FROM documents GROUP BY 2)""")
def f01(t):
    d = M.documents(t)
    return O.facet_labels(O.facet_counts(d, ["document_data_type", "document_category", "document_schema"]))


@query("f02_facet_top_values", f"""
WITH {S.PRODUCTS}, u AS (
  SELECT 'product_brand' AS field, product_brand AS value, count(*) AS n FROM products GROUP BY 2
  UNION ALL SELECT 'product_category', product_category, count(*) FROM products GROUP BY 2
  UNION ALL SELECT 'product_name', product_name, count(*) FROM products GROUP BY 2)
SELECT field, value, n FROM u QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= 20""")
def f02(t):
    return O.facet_counts(M.products(t), ["product_brand", "product_category", "product_name"], max_values=20)


@query("f03_array_facets", f"""
WITH {S.DOCS}
SELECT 'primary_keywords' AS field, value, count(*) AS n FROM (SELECT unnest(primary_keywords) AS value FROM docs) GROUP BY 2
UNION ALL SELECT 'semantic_keywords', value, count(*) FROM (SELECT unnest(semantic_keywords) AS value FROM docs) GROUP BY 2""")
def f03(t):
    return O.facet_counts(M.documents(t), ["primary_keywords", "semantic_keywords"])


@query("f04_tab_facets", """
SELECT 'lang' AS field, lang AS value, count(*) AS n_all, count(*) FILTER (lang = 'en') AS n_active FROM documents GROUP BY lang
UNION ALL SELECT 'source', source, count(*), count(*) FILTER (lang = 'en') FROM documents GROUP BY source""")
def f04(t):
    return O.tab_facets(t.documents.select("lang", "source"), ["lang", "source"], c("lang") == "en")


@query("f05_count_all", f"""
WITH {S.PAGES}
SELECT count(*) AS total, count(*) FILTER (len(list_filter(image_url, lambda u: u <> '')) > 0) AS total_image_count,
  count(*) FILTER (lang <> '') AS facet_total FROM pg""")
def f05(t):
    return O.count_all(M.page_fields(t), X.has_images(c("image_url")), "lang")


@query("f06_filter_results", """
SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src3'""")
def f06(t):
    d = t.documents.select("doc_id", "lang", "source")
    return O.filter_results(d, lang="en", source="src3", text=None)


@query("f07_paginate", """
SELECT lang, doc_id, n_chars, row_number() OVER w AS rank, count(*) OVER (PARTITION BY lang) AS total FROM documents
WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC, doc_id)
QUALIFY row_number() OVER w BETWEEN 21 AND 40""")
def f07(t):
    d = t.documents.select("lang", "doc_id", "n_chars")
    return O.paginate(d, ["lang"], [F.desc("n_chars"), F.asc("doc_id")], 2, 20).withColumn("rank", c("rank").cast("bigint"))


@query("f08_pagination_numbers", """
WITH u AS (SELECT user_id, count(*) AS total, user_id % 9 + 1 AS page FROM events GROUP BY user_id),
v AS (SELECT *, greatest(1, CAST(ceil(total / 10.0) AS BIGINT)) AS pages FROM u),
w AS (SELECT *, least(page, pages) AS p FROM v)
SELECT user_id, p AS current_page, pages AS total_pages, p > 1 AS has_previous, p < pages AS has_next,
  greatest(1, p - 1) AS previous_page, least(pages, p + 1) AS next_page,
  array_to_string(range(greatest(1, p - 2), least(pages, p + 2) + 1), ' ') AS page_range,
  greatest(1, p - 2) > 1 AS show_first, least(pages, p + 2) < pages AS show_last,
  least((p - 1) * 10 + 1, total) AS start_result, least(p * 10, total) AS end_result, total AS total_results FROM w""")
def f08(t):
    u = t.events.groupBy("user_id").agg(F.count("*").alias("total"))
    p = u.select("user_id", O.pagination_info(c("user_id") % 9 + 1, F.lit(10), c("total")).alias("p")).select("user_id", "p.*")
    return p.withColumn("page_range", F.array_join(c("page_range").cast("array<string>"), " "))


@query("f09_sort_results", f"""
WITH {S.PRODUCTS}, {S.TRIPS},
p AS (SELECT *, product_rating AS authority_score FROM products)
SELECT 'cheap' AS sort_key, product_category AS grp, p_partkey AS id, row_number() OVER w AS rank FROM p
  WINDOW w AS (PARTITION BY product_category ORDER BY product_price ASC NULLS LAST, authority_score DESC NULLS LAST, p_partkey)
  QUALIFY row_number() OVER w <= 10
UNION ALL SELECT 'expensive', product_category, p_partkey, row_number() OVER w FROM p
  WINDOW w AS (PARTITION BY product_category ORDER BY product_price DESC NULLS LAST, authority_score DESC NULLS LAST, p_partkey)
  QUALIFY row_number() OVER w <= 10
UNION ALL SELECT 'rating', product_category, p_partkey, row_number() OVER w FROM p
  WINDOW w AS (PARTITION BY product_category ORDER BY authority_score DESC NULLS LAST, p_partkey)
  QUALIFY row_number() OVER w <= 10
UNION ALL SELECT 'oldest', location_country, o_orderkey, row_number() OVER w FROM trips
  WINDOW w AS (PARTITION BY location_country ORDER BY event_date_start, price DESC, o_orderkey)
  QUALIFY row_number() OVER w <= 10
UNION ALL SELECT 'newest', location_country, o_orderkey, row_number() OVER w FROM trips
  WINDOW w AS (PARTITION BY location_country ORDER BY event_date_start DESC, price DESC, o_orderkey)
  QUALIFY row_number() OVER w <= 10""")
def f09(t):
    p = M.products(t).select("p_partkey", "product_category", "product_price", c("product_rating").alias("authority_score"))
    e = M.trips(t).select("o_orderkey", "location_country", c("event_date_start").alias("time_period_start"),
                          c("event_date_start").alias("published_date"), c("price").alias("authority_score"))
    outs = [O.sort_results(p, ["product_category"], k, 10, "p_partkey")
            .select(F.lit(k).alias("sort_key"), c("product_category").alias("grp"), c("p_partkey").alias("id"),
                    c("rank").cast("bigint").alias("rank")) for k in ("cheap", "expensive", "rating")]
    outs += [O.sort_results(e, ["location_country"], k, 10, "o_orderkey")
             .select(F.lit(k).alias("sort_key"), c("location_country").alias("grp"), c("o_orderkey").alias("id"),
                     c("rank").cast("bigint").alias("rank")) for k in ("oldest", "newest")]
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


@query("f10_display_groups", """
SELECT doc_id, CASE lang WHEN 'en' THEN 'articles' WHEN 'fr' THEN 'videos' WHEN 'de' THEN 'people' WHEN 'es' THEN 'places' ELSE 'other' END
  AS display_group FROM documents""")
def f10(t):
    return t.documents.select("doc_id", O.display_group(O.lookup(TYPES, c("lang"))).alias("display_group"))


# searches with fewer than ten results stand for searches without any
@query("f11_zero_result_suggestions", f"""
WITH {S.SEARCHES}, z AS (
  SELECT event_id, user_id % 2 = 0 AS has_filters, 'Find ' || query AS query,
    CASE WHEN k % 2 = 0 THEN 'find ' || query ELSE 'found' END AS corrected_query
  FROM searches WHERE results_count < 10)
SELECT event_id, 'remove_filters' AS type, 'Try removing some filters' AS message, corrected_query AS action_query FROM z WHERE has_filters
UNION ALL SELECT event_id, 'broader_search', 'Try a broader search', array_to_string(string_split(corrected_query, ' ')[1:2], ' ')
  FROM z WHERE len(string_split(corrected_query, ' ')) > 2
UNION ALL SELECT event_id, 'try_original', 'Search for "' || query || '" instead', query FROM z WHERE lower(query) <> lower(corrected_query)
UNION ALL SELECT event_id, 'help', 'Check your spelling or try different keywords', NULL FROM z""")
def f11(t):
    z = M.searches(t).where(c("results_count") < 10).select(
        "event_id", (c("user_id") % 2 == 0).alias("has_filters"), F.concat(F.lit("Find "), "query").alias("query"),
        F.when(c("k") % 2 == 0, F.concat(F.lit("find "), "query")).otherwise("found").alias("corrected_query"))
    return O.zero_result_suggestions(z)


_RANKED = f"""{S.DOCS}, ranked AS (
  SELECT *, authority_rank_score AS authority_score, content_depth_score / 100 AS score,
    row_number() OVER (PARTITION BY source ORDER BY authority_rank_score DESC, n_chars DESC, doc_id) AS rank,
    CASE lang WHEN 'en' THEN 'person' WHEN 'fr' THEN 'location' ELSE 'general' END AS intent,
    CASE lang WHEN 'en' THEN 'person' ELSE 'article' END AS dtype
  FROM docs)"""


def _ranked(t):
    d = M.documents(t).withColumns({
        "authority_score": c("authority_rank_score"), "score": c("content_depth_score") / 100,
        "intent": F.when(c("lang") == "en", "person").when(c("lang") == "fr", "location").otherwise("general"),
        "document_data_type": F.when(c("lang") == "en", "person").otherwise("article")})
    return O.top_k(d, ["source"], [F.desc("authority_score"), F.desc("n_chars"), F.asc("doc_id")], 1, rank="rank")


@query("f12_featured_result", f"""
WITH {_RANKED}
SELECT source, document_uuid, 'current' AS rule, 'featured_snippet' AS card FROM ranked WHERE rank = 1 AND authority_score >= 85
UNION ALL SELECT source, document_uuid, 'earlier', CASE WHEN intent = 'person' AND dtype = 'person' THEN 'person_card'
  WHEN intent = 'location' THEN 'place_card' ELSE 'featured_snippet' END
FROM ranked WHERE rank = 1 AND authority_score >= 85 AND score >= 0.7""")
def f12(t):
    r = _ranked(t)
    a = O.featured(r).select("source", "document_uuid", F.lit("current").alias("rule"), "card")
    b = O.featured(r, with_score=True).select("source", "document_uuid", F.lit("earlier").alias("rule"), "card")
    return a.unionByName(b)


_OWORDS = (f"list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: length(w) > 1 AND w NOT IN "
           f"{S.in_list(R.OVERVIEW_STOPWORDS)})")
# every document answers a query made of its title's words and one word of its source
_OV = f"""{S.DOCS}, q AS (
  SELECT doc_id, document_title, key_facts, CASE doc_id % 4 WHEN 0 THEN 'explore' WHEN 1 THEN 'answer' WHEN 2 THEN 'shop' ELSE 'explore' END AS mode,
    CASE doc_id % 3 WHEN 0 THEN 'where' WHEN 1 THEN 'when' END AS question_word,
    CASE doc_id % 3 WHEN 0 THEN 'where is ' ELSE '' END || document_title || ' ' || source AS query FROM docs),
w AS (SELECT *, {_OWORDS} AS ws, lower(document_title) AS lt, lower(array_to_string(key_facts, ' ')) AS lf FROM q)"""


def _overview_input(t):
    return M.documents(t).select(
        "doc_id", c("document_uuid").alias("query_id"), "document_title", "key_facts",
        F.when(c("doc_id") % 4 == 1, "answer").when(c("doc_id") % 4 == 2, "shop").otherwise("explore").alias("mode"),
        F.when(c("doc_id") % 3 == 0, "where").when(c("doc_id") % 3 == 1, "when").alias("question_word"),
        F.concat(F.when(c("doc_id") % 3 == 0, "where is ").otherwise(""), "document_title", F.lit(" "), "source").alias("query"))


@query("f13_overview_trigger", f"""
WITH {_OV}
SELECT doc_id, CASE WHEN mode = 'shop' THEN false WHEN mode = 'answer' THEN true
  WHEN len(ws) = 0 THEN false ELSE len(list_filter(ws, lambda x: contains(lt, x) OR contains(lf, x))) / len(ws) >= 0.75 END AS shown FROM w""")
def f13(t):
    return O.overview(_overview_input(t)).select("doc_id", "shown")


def _facts_sql(word, year=""):
    return f"list_filter(key_facts, lambda f: regexp_matches(lower(f), '{'|'.join(R.FACT_WORDS[word])}{year}'))"


@query("f14_overview_text", f"""
WITH {_OV},
b AS (SELECT *, list_reverse(list_sort(list_transform(ws, lambda x, i: {{'s': CAST(contains(lt, x) AS INT) + CAST(contains(lf, x) AS INT), 'i': -i, 'w': x}})))[1].w AS kw FROM w),
p AS (SELECT *, CASE question_word WHEN 'where' THEN {_facts_sql('where')} WHEN 'when' THEN {_facts_sql('when', '|[^0-9a-z_][0-9]{4}[^0-9a-z_]')} ELSE [] END AS bw,
  CASE WHEN kw IS NOT NULL THEN list_filter(key_facts, lambda f: contains(lower(f), kw)) ELSE [] END AS bk FROM b),
r AS (SELECT *, (CASE WHEN len(bw) > 0 THEN bw WHEN len(bk) > 0 THEN bk ELSE key_facts[1:1] END)[1:2] AS pick,
  CAST(('0x' || substring(md5(CAST(doc_id AS VARCHAR)), 1, 2)) AS INT) % 4 + 1 AS turn FROM p)
SELECT doc_id, CASE WHEN len(key_facts) > 0 THEN (CASE WHEN {' OR '.join(f"lower(query) LIKE '{w}%'" for w in R.QUESTION_STARTS)}
  THEN [{', '.join(S.lit(x) for x in R.QUESTION_INTROS)}] ELSE [{', '.join(S.lit(x) for x in R.PLAIN_INTROS)}] END)[turn]
  || ' ' || array_to_string(pick, '. ') || '.' END AS overview FROM r""")
def f14(t):
    return O.overview(_overview_input(t)).select("doc_id", "overview")


@query("f15_category_counts", """
SELECT p_type AS name, count(*) AS n FROM part GROUP BY 1""")
def f15(t):
    return (O.facet_counts(t.part.select(c("p_type").alias("document_category")), ["document_category"])
            .select(c("value").alias("name"), "n"))
