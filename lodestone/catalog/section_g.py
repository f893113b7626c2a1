"""Faceted browse pages: hits, facets and the total as one long table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import sqlkit as S
from lodestone.catalog.registry import query
from lodestone.functions import text as X
from lodestone.operators import browse as O
from lodestone.rules import browse as R
from lodestone.sources import mapping as M

c = F.col


def _long(res: O.BrowseResult, tie: str):
    hit = res.page.select(F.lit("hit").alias("part"), c(tie).cast("string").alias("value"), F.lit("").alias("field"),
                          F.lit(1).cast("bigint").alias("n"))
    fac = res.facets.select(F.lit("facet").alias("part"), "value", "field", "n")
    tot = res.found.select(F.lit("found").alias("part"), F.lit("").alias("value"), F.lit("").alias("field"), c("found").alias("n"))
    return hit.unionByName(fac).unionByName(tot)


def _long_sql(src: str, order: str, tie: str, facets: dict, page: int, size: int, cap: int) -> str:
    """src: name of the filtered CTE."""
    fac = " UNION ALL ".join(
        f"SELECT '{f}' AS field, CAST({e} AS VARCHAR) AS value, count(*) AS n FROM {src} WHERE {e} IS NOT NULL GROUP BY 2"
        for f, e in facets.items())
    return f"""
SELECT 'hit' AS part, value, '' AS field, 1 AS n FROM (SELECT CAST({tie} AS VARCHAR) AS value FROM {src}
  ORDER BY {order}{', ' if order else ''}{tie} LIMIT {size} OFFSET {(page - 1) * size})
UNION ALL SELECT 'facet', value, field, n FROM (SELECT * FROM ({fac})
  QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= {cap})
UNION ALL SELECT 'found', '', '', count(*) FROM {src}"""


@query("g01_shopping", f"""
WITH {S.PRODUCTS}, f AS (SELECT * FROM products WHERE product_price >= 950 AND product_price <= 1800 AND product_rating >= 2.0
  AND in_stock AND product_category = 'SMALL')
{_long_sql('f', 'product_price DESC', 'p_partkey', {'product_category': 'product_category', 'product_brand': 'product_brand',
 'product_color': 'product_color', 'product_sizes': 'product_size'}, 2, 24, 50)}""")
def g01(t):
    req = {"category": "SMALL", "min_price": 950, "max_price": 1800, "min_rating": 2.0, "in_stock": True,
           "sort": "price_desc", "page": 2}
    return _long(O.faceted_browse(M.products(t), O.SHOPPING, req), "p_partkey")


_SPECIALTIES = [w for ws in R.SUBCATEGORIES.values() for w in ws]
_EAT = f"""{S.EATERIES}, sp(i, service_specialty) AS ({S.values(list(enumerate(_SPECIALTIES)))}),
eats AS (SELECT * EXCLUDE (i) FROM eateries JOIN sp ON s_suppkey % {len(_SPECIALTIES)} = i)"""


def _eats(t):
    sp = F.array(*[F.lit(x) for x in _SPECIALTIES])
    return M.eateries(t).withColumn("service_specialty", F.get(sp, (c("s_suppkey") % len(_SPECIALTIES)).cast("int")))


@query("g02_eats", f"""
WITH {_EAT}, f AS (SELECT * FROM eats WHERE service_rating >= 1.5 AND delivery)
{_long_sql('f', 'service_review_count DESC', 's_suppkey', {'service_type': 'service_type', 'location_city': 'location_city',
 'price_symbol': 'price_symbol'}, 1, 24, 50)}""")
def g02(t):
    return _long(O.faceted_browse(_eats(t), O.EATS, {"min_rating": 1.5, "delivery": True, "sort": "reviews"}), "s_suppkey")


@query("g03_travel", f"""
WITH {S.TRIPS}, f AS (SELECT * FROM trips WHERE event_type = 'O' AND is_free)
{_long_sql('f', 'event_date_start', 'o_orderkey', {'location_country': 'location_country', 'event_type': 'event_type', 'topic': 'topic'}, 1, 24, 50)}""")
def g03(t):
    return _long(O.faceted_browse(M.trips(t), O.TRAVEL, {"event_type": "O", "is_free": True, "sort": "date"}), "o_orderkey")


_BEAUTY = ["salon", "barber", "beauty", "hair", "nails", "spa"]


@query("g04_business", f"""
WITH {_EAT}, f AS (SELECT * FROM eats WHERE service_specialty IN {S.in_list(_BEAUTY)})
{_long_sql('f', 'document_title', 's_suppkey', {'service_type': 'service_type', 'location_city': 'location_city'}, 1, 20, 20)}""")
def g04(t):
    return _long(O.business_browse(_eats(t), {"subcategory": "beauty", "sort": "name"}), "s_suppkey")


# documents as browse rows: source number modulo 4 as schema, language as category
_DOCROWS = f"""{S.LAB}, b AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS document_uuid, d.text AS document_summary, lang AS document_category,
    'schema' || (CAST(source[4:] AS INT) % 4) AS document_schema, source AS document_brand, d.n_chars AS created_at,
    coalesce(quality * 100, 50) + d.n_chars % 50 AS authority_score, {S.strip(r"regexp_extract(text, '^[^.' || chr(10) || ']*')")} AS document_title,
    {S.raw_tokens('text')} AS tk
  FROM documents d LEFT JOIN lab ON d.doc_id = lab.doc_id)"""
_DF = {"document_category": "document_category", "document_brand": "document_brand"}


def _docrows(t):
    d = M.documents(t)
    return d.select(
        "document_uuid", "document_summary", c("lang").alias("document_category"),
        F.concat(F.lit("schema"), (F.substring("source", 4, 9).cast("int") % 4)).alias("document_schema"),
        c("source").alias("document_brand"), c("n_chars").alias("created_at"),
        (F.coalesce(c("quality") * 100, F.lit(50)) + c("n_chars") % 50).alias("authority_score"),
        X.strip(F.regexp_extract("document_summary", r"^[^.\n]*", 0)).alias("document_title"))


@query("g05_culture", f"""
WITH {_DOCROWS}, f AS (SELECT * FROM b WHERE document_schema IN ('schema1', 'schema2') AND document_category = 'en'),
m AS ({_long_sql('f', 'authority_score DESC', 'document_uuid', _DF, 1, 18, 20)})
SELECT * FROM m UNION ALL
SELECT 'spotlight', document_uuid, '', 1 FROM (SELECT * FROM b WHERE document_category = 'fr' ORDER BY authority_score DESC, document_uuid LIMIT 4)
UNION ALL SELECT 'featured', document_uuid, substring(document_summary, 1, 200), 1 FROM (SELECT * FROM b WHERE document_schema = 'schema1' AND document_category = 'es'
  ORDER BY authority_score DESC, document_uuid LIMIT 1)""")
def g05(t):
    main, spot, top = O.culture_browse(_docrows(t), {"topic": "film"}, {"film": (["schema1", "schema2"], "en")},
                                       base_schema="schema1", spotlight="fr", featured="es")
    one = F.lit(1).cast("bigint").alias("n")
    return (_long(main, "document_uuid")
            .unionByName(spot.select(F.lit("spotlight").alias("part"), c("document_uuid").alias("value"), F.lit("").alias("field"), one))
            .unionByName(top.select(F.lit("featured").alias("part"), c("document_uuid").alias("value"), c("excerpt").alias("field"), one)))


@query("g06_health", f"""
WITH {_DOCROWS}, f AS (SELECT * FROM b WHERE document_schema = 'schema0' AND document_brand = 'src4')
{_long_sql('f', 'created_at DESC', 'document_uuid', _DF, 2, 20, 20)}""")
def g06(t):
    return _long(O.faceted_browse(_docrows(t), O.HEALTH, {"schema": "schema0", "brand": "src4", "sort": "recent", "page": 2}),
                 "document_uuid")


_LISTS = {"events": (["tion", "ent"], True, 5), "churches": (["une", "les"], False, 8),
          "organizations": (["der", "ung"], False, 4), "volunteering": (["los", "and", "hand"], True, 5)}


def _side_sql() -> str:
    return " UNION ALL ".join(
        f"""SELECT 'side', document_uuid, '{n}', 1 FROM (SELECT * FROM c WHERE len(list_intersect(tk, {[w for w in ws if w != 'and']})) > 0
  ORDER BY {'created_at' if new else 'authority_score'} DESC, document_uuid LIMIT {k})""" for n, (ws, new, k) in _LISTS.items())


@query("g07_community", f"""
WITH {_DOCROWS}, c AS (SELECT * FROM b WHERE document_schema = 'schema3'),
f AS (SELECT * FROM c WHERE document_category = 'de'),
m AS ({_long_sql('f', 'document_title', 'document_uuid', _DF, 1, 20, 20)})
SELECT * FROM m UNION ALL {_side_sql()}""")
def g07(t):
    main, side = O.community_browse(_docrows(t), {"category": "de", "sort": "name"}, _LISTS, schema="schema3")
    return _long(main, "document_uuid").unionByName(side.select(
        F.lit("side").alias("part"), c("document_uuid").alias("value"), c("list_name").alias("field"),
        F.lit(1).cast("bigint").alias("n")))


@query("g08_generic_category", f"""
WITH {_DOCROWS}, f AS (SELECT * FROM b WHERE document_schema = 'schema2')
{_long_sql('f', 'authority_score DESC', 'document_uuid', _DF, 3, 20, 20)}""")
def g08(t):
    return _long(O.faceted_browse(_docrows(t), O.GENERIC, {"schema": "schema2", "page": 3}), "document_uuid")


@query("g09_category_browse", f"""
WITH {_DOCROWS}, f AS (SELECT * FROM b WHERE document_category = 'fr')
{_long_sql('f', '', 'document_uuid', {'document_category': 'document_category'}, 1, 30, 50)}""")
def g09(t):
    return _long(O.faceted_browse(_docrows(t), O.BROWSE, {"category": "fr"}), "document_uuid")


@query("g10_featured_listings", f"""
WITH {S.EATERIES}
SELECT 'top' AS part, location_city AS city, CAST(s_suppkey AS VARCHAR) AS value, row_number() OVER w AS n FROM eateries
WINDOW w AS (PARTITION BY location_city ORDER BY authority_score DESC, s_suppkey) QUALIFY row_number() OVER w <= 3
UNION ALL SELECT 'stat', location_city, service_type, count(*) FROM eateries GROUP BY 2, 3""")
def g10(t):
    top, stat = O.featured_listings(M.eateries(t), "location_city", "authority_score", "s_suppkey", 3, "service_type")
    return (top.select(F.lit("top").alias("part"), c("location_city").alias("city"), c("s_suppkey").cast("string").alias("value"),
                       c("rank").cast("bigint").alias("n"))
            .unionByName(stat.select(F.lit("stat").alias("part"), c("location_city").alias("city"), c("service_type").alias("value"), "n")))
