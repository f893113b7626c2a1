"""Faceted browse: one operator, one configuration per page kind.

Page, facets and total come from the same filtered frame. Filters are plain
Columns, so they reach the scan; the page is a distributed top-k.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.facets import facet_counts, page_of
from lodestone.operators.windows import top_k
from lodestone.rules import browse as R


@dataclass(frozen=True)
class BrowseConfig:
    base: dict = field(default_factory=dict)        # column -> required value or list of values
    exact: dict = field(default_factory=dict)       # request name -> column (lists: contains)
    at_least: dict = field(default_factory=dict)
    at_most: dict = field(default_factory=dict)
    flags: tuple = ()                               # boolean columns, restricted only when asked for
    sorts: dict = field(default_factory=dict)       # sort name -> [(column, ascending)]
    default_sort: str = ""
    facets: tuple = ()
    max_facet_values: int = 50
    page_size: int = 24
    query_by: tuple = ()
    tie: str = "document_uuid"


@dataclass
class BrowseResult:
    page: DataFrame
    facets: DataFrame
    found: DataFrame


def any_words(df: DataFrame, words: list[str], fields: tuple[str, ...]) -> DataFrame:
    """Rows with at least one of the words; ``_hits`` counts the words found."""
    toks = X.match_tokens(F.concat_ws(" ", *fields))
    want = sorted({w for phrase in words for w in phrase.lower().split() if len(w) > 2})
    hits = F.size(F.array_intersect(toks, F.array(*[F.lit(w) for w in want])))
    return df.withColumn("_hits", hits).where(F.col("_hits") > 0)


def browse_filter(df: DataFrame, cfg: BrowseConfig, req: dict) -> DataFrame:
    kinds, conds = dict(df.dtypes), []
    for col, val in cfg.base.items():
        conds.append(F.col(col).isin(val) if isinstance(val, list) else F.col(col) == val)
    for name, col in cfg.exact.items():
        if req.get(name):
            typed = F.lit(req[name])
            conds.append(F.array_contains(col, typed.cast(kinds[col][6:-1])) if kinds[col].startswith("array")
                         else F.col(col) == typed)
    conds += [F.col(c) >= float(req[n]) for n, c in cfg.at_least.items() if req.get(n) is not None]
    conds += [F.col(c) <= float(req[n]) for n, c in cfg.at_most.items() if req.get(n) is not None]
    conds += [F.col(f) for f in cfg.flags if req.get(f)]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def faceted_browse(df: DataFrame, cfg: BrowseConfig, req: dict) -> BrowseResult:
    hits = browse_filter(df, cfg, req)
    words = req.get("words") or (str(req["q"]).split() if req.get("q") else [])
    if words:
        hits = any_words(hits, words, cfg.query_by)
    order: list[Column] = []
    sort = req.get("sort") or cfg.default_sort
    if sort in cfg.sorts:
        order = [F.col(c).asc_nulls_last() if asc else F.col(c).desc_nulls_last() for c, asc in cfg.sorts[sort]]
    elif words:
        order = [F.desc("_hits")]
    page = page_of(hits, [*order, F.col(cfg.tie).asc()], max(1, int(req.get("page", 1))), cfg.page_size)
    return BrowseResult(page, facet_counts(hits, list(cfg.facets), max_values=cfg.max_facet_values),
                        hits.agg(F.count("*").alias("found")))


SHOPPING = BrowseConfig(
    exact={"category": "product_category", "brand": "product_brand", "color": "product_color", "size": "product_sizes"},
    at_least={"min_price": "product_price", "min_rating": "product_rating"}, at_most={"max_price": "product_price"},
    flags=("black_owned", "women_owned", "veteran_owned", "minority_owned", "in_stock"),
    sorts={"rating": [("product_rating", False)], "price_asc": [("product_price", True)],
           "price_desc": [("product_price", False)]},
    facets=("product_category", "product_brand", "product_color", "product_sizes"),
    query_by=("product_name", "product_brand", "product_category"), tie="p_partkey")

EATS = BrowseConfig(
    exact={"type": "service_type", "specialty": "service_specialty", "city": "location_city", "state": "location_state",
           "price": "price_symbol"},
    at_least={"min_rating": "service_rating"}, flags=("delivery", "reservations", "black_owned", "women_owned"),
    sorts={"rating": [("service_rating", False)], "reviews": [("service_review_count", False)]},
    facets=("service_type", "location_city", "price_symbol"), query_by=("document_title", "service_specialty"), tie="s_suppkey")

TRAVEL = BrowseConfig(
    exact={"content_type": "event_type", "country": "location_country", "region": "location_region",
           "event_type": "event_type", "topic": "topic"},
    flags=("is_free", "black_owned", "women_owned", "veteran_owned"),
    sorts={"date": [("event_date_start", True)], "newest": [("event_date_start", False)]},
    facets=("location_country", "event_type", "topic"), query_by=("location_country",), tie="o_orderkey")

_DOC_SORTS = {"authority": [("authority_score", False)], "recent": [("created_at", False)],
              "name": [("document_title", True)]}
_DOC_EXACT = {"category": "document_category", "brand": "document_brand", "schema": "document_schema"}
_DOC = dict(exact=_DOC_EXACT, sorts=_DOC_SORTS, default_sort="authority", facets=("document_category", "document_brand"),
            max_facet_values=20, page_size=20, query_by=("document_title", "document_summary"))

BUSINESS = BrowseConfig(
    exact={"category": "service_type", "brand": "location_city"}, sorts={"name": [("document_title", True)]},
    facets=("service_type", "location_city"), max_facet_values=20, page_size=20,
    query_by=("document_title", "service_specialty"), tie="s_suppkey")
CULTURE = BrowseConfig(**{**_DOC, "page_size": 18})
HEALTH = BrowseConfig(**_DOC)
COMMUNITY = BrowseConfig(**_DOC)
GENERIC = BrowseConfig(**_DOC)
BROWSE = BrowseConfig(exact=_DOC_EXACT, facets=("document_category",), page_size=30)


def business_browse(df: DataFrame, req: dict, subcategories: dict | None = None) -> BrowseResult:
    """Business directory; a sub-category searches all of its words."""
    words = (subcategories or R.SUBCATEGORIES).get(req.get("subcategory", ""), [])
    return faceted_browse(df, BUSINESS, {**req, "words": [] if req.get("q") else words})


def culture_browse(df: DataFrame, req: dict, topics: dict | None = None, base_schema: str = "culture",
                   spotlight: str = "hbcu", featured: str = "history"):
    """Culture page: topic filter, the spotlight top four and the featured document."""
    schemas, category = (topics or R.CULTURE_TOPICS).get(req.get("topic", ""), ([base_schema], None))
    base = {}
    if schemas:
        base["document_schema"] = list(schemas)
    if category:
        base["document_category"] = category
    main = faceted_browse(df, BrowseConfig(**{**_DOC, "page_size": 18, "base": base}), req)
    best = [F.desc("authority_score"), F.asc("document_uuid")]
    spot = page_of(df.where(F.col("document_category") == spotlight), best, 1, 4)
    top = page_of(df.where((F.col("document_schema") == base_schema) & (F.col("document_category") == featured)), best, 1, 1)
    return main, spot, top.withColumn("excerpt", X.excerpt(F.col("document_summary"), 200))


def community_browse(df: DataFrame, req: dict, lists: dict | None = None, schema: str = "community"):
    """Community page and its side lists (list_name, rows of that list)."""
    req = {**req, "category": R.HELP_CATEGORIES.get(req.get("category", ""), req.get("category"))}
    main = faceted_browse(df, BrowseConfig(**{**_DOC, "base": {"document_schema": schema}}), req)
    side = []
    for name, (words, newest, n) in (lists or R.COMMUNITY_LISTS).items():
        hits = any_words(df.where(F.col("document_schema") == schema), list(words), ("document_title", "document_summary"))
        by = "created_at" if newest else "authority_score"
        side.append(page_of(hits, [F.desc(by), F.asc("document_uuid")], 1, n).withColumn("list_name", F.lit(name)))
    return main, reduce(lambda a, b: a.unionByName(b), side)


def featured_listings(df: DataFrame, city: str, order: str, tie: str, k: int, group: str) -> tuple[DataFrame, DataFrame]:
    """Top rows of every city and the row count per (group, city)."""
    top = top_k(df, [city], [F.desc(order), F.asc(tie)], k, rank="rank")
    return top, df.groupBy(group, city).agg(F.count("*").alias("n"))
