"""Facets, grouping, sorts, limits and pages over result sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.windows import top_k
from lodestone.rules import scoring as R


def lookup(values: dict, key: Column) -> Column:
    """Value of a small fixed table, null when the key is not in it."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def facet_counts(results: DataFrame, fields: list[str], keys: list[str] = (), max_values: int | None = None) -> DataFrame:
    """(keys, field, value, n): values of each field counted in one pass.

    List columns count each element. Rows are counted before the shuffle, so
    a value held by most rows moves one number per task.
    """
    keys = list(keys)
    kinds = dict(results.dtypes)

    def entries(f: str) -> Column:
        values = F.col(f) if kinds[f].startswith("array") else F.array(f)
        return F.transform(values.cast("array<string>"), lambda v: F.struct(F.lit(f).alias("field"), v.alias("value")))

    counted = (results.select(*keys, F.explode(F.concat(*[entries(f) for f in fields])).alias("e"))
               .select(*keys, "e.field", "e.value").where(F.coalesce("value", F.lit("")) != "")
               .groupBy(*keys, "field", "value").agg(F.count("*").alias("n")))
    if max_values:
        counted = top_k(counted, [*keys, "field"], [F.desc("n"), F.asc("value")], max_values)
    return counted


def facet_labels(facets: DataFrame) -> DataFrame:
    title = F.initcap(F.replace("value", F.lit("_"), F.lit(" ")))
    label = (F.when(F.col("field") == "document_data_type", F.coalesce(lookup(R.DATA_TYPE_LABELS, F.col("value")),
                                                                       F.initcap("value")))
             .when(F.col("field") == "document_category", F.coalesce(lookup(R.CATEGORY_LABELS, F.col("value")), title))
             .otherwise(F.col("value")))
    return facets.withColumn("label", label)


def tab_facets(results: DataFrame, fields: list[str], active: Column) -> DataFrame:
    """Counts over the whole set next to counts under the active filter."""
    kinds = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    return (results.select(F.explode(F.array(*kinds)).alias("e"), active.alias("_a"))
            .select("e.field", "e.value", "_a").where(F.coalesce("value", F.lit("")) != "")
            .groupBy("field", "value")
            .agg(F.count("*").alias("n_all"), F.count_if("_a").alias("n_active")))


def count_all(results: DataFrame, images: Column, type_field: str, keys: list[str] = ()) -> DataFrame:
    """Total, image-bearing rows and the total as a sum of type facets."""
    return results.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(images).alias("total_image_count"),
        F.count_if(F.coalesce(F.col(type_field), F.lit("")) != "").alias("facet_total"))


def filter_results(df: DataFrame, **chosen: str | None) -> DataFrame:
    """Keep rows with the chosen data type, category, schema; unset ones do not restrict."""
    conds = [F.col(f) == v for f, v in chosen.items() if v]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of one result set: a distributed top-k, no global sort."""
    return df.orderBy(*order).limit(page * size).offset((page - 1) * size)


def paginate(df: DataFrame, keys: list[str], order: list[Column], page: int, size: int) -> DataFrame:
    """The page of every key with its rank and the key's total."""
    rows = top_k(df, keys, order, page * size, rank="rank").where(F.col("rank") > (page - 1) * size)
    return rows.join(df.groupBy(*keys).agg(F.count("*").alias("total")), list(keys))


def pagination_info(page: Column, size: Column, total: Column) -> Column:
    pages = F.greatest(F.lit(1), F.ceil(total / size)).cast("bigint")
    p = F.least(page, pages)
    first, last = F.greatest(F.lit(1), p - 2), F.least(pages, p + 2)
    return F.struct(
        p.alias("current_page"), pages.alias("total_pages"), (p > 1).alias("has_previous"), (p < pages).alias("has_next"),
        F.greatest(F.lit(1), p - 1).alias("previous_page"), F.least(pages, p + 1).alias("next_page"),
        F.sequence(first, last).alias("page_range"), (first > 1).alias("show_first"), (last < pages).alias("show_last"),
        F.when(total > 0, F.least((p - 1) * size + 1, total)).otherwise(0).alias("start_result"),
        F.least(p * size, total).alias("end_result"), total.alias("total_results"))


SORTS = {  # sort key -> (column, ascending)
    "oldest": ("time_period_start", True), "newest": ("published_date", False),
    "cheap": ("product_price", True), "expensive": ("product_price", False),
    "rating": ("authority_score", False), "text": ("text_match", False),
}


def sort_results(df: DataFrame, keys: list[str], sort_key: str, k: int, tie: str) -> DataFrame:
    """First ``k`` rows of each key in the order of the sort mode; ties by authority, then id."""
    col, asc = SORTS[sort_key]
    order = [F.col(col).asc_nulls_last() if asc else F.col(col).desc_nulls_last(),
             F.col("authority_score").desc_nulls_last(), F.col(tie).asc()]
    return top_k(df, keys, order, k, rank="rank")


def display_group(data_type: Column) -> Column:
    return F.coalesce(lookup(R.DISPLAY_GROUPS, data_type), F.lit("other"))


def zero_result_suggestions(df: DataFrame) -> DataFrame:
    """Advice rows for searches without results (query, corrected_query, has_filters)."""
    w = F.filter(F.split("corrected_query", r"\s+"), lambda t: t != "")

    def row(kind, message, action):
        return F.struct(F.lit(kind).alias("type"), message.alias("message"), action.alias("action_query"))

    none = F.lit(None).cast("string")
    advice = F.array_compact(F.array(
        F.when(F.col("has_filters"), row("remove_filters", F.lit("Try removing some filters"), F.col("corrected_query"))),
        F.when(F.size(w) > 2, row("broader_search", F.lit("Try a broader search"), F.array_join(F.slice(w, 1, 2), " "))),
        F.when(F.lower("query") != F.lower("corrected_query"),
               row("try_original", F.concat(F.lit('Search for "'), "query", F.lit('" instead')), F.col("query"))),
        row("help", F.lit("Check your spelling or try different keywords"), none)))
    keep = [x for x in df.columns if x not in ("query", "corrected_query", "has_filters")]
    return df.select(*keep, F.explode(advice).alias("a")).select(*keep, "a.*")


def featured(results: DataFrame, with_score: bool = False) -> DataFrame:
    """Top result of each query when it is authoritative enough.

    ``with_score`` is the earlier rule: score at least .7 as well, and the
    card chosen by intent.
    """
    top = results.where((F.col("rank") == 1) & (F.col("authority_score") >= R.FEATURED_AUTHORITY))
    if not with_score:
        return top.withColumn("card", F.lit("featured_snippet"))
    return top.where(F.col("score") >= 0.7).withColumn(
        "card", F.when((F.col("intent") == "person") & (F.col("document_data_type") == "person"), "person_card")
        .when(F.col("intent") == "location", "place_card").otherwise("featured_snippet"))


def overview_words(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(R.OVERVIEW_STOPWORDS))


def overview(df: DataFrame) -> DataFrame:
    """Adds ``shown`` (is an overview given?) and ``overview`` (its text).

    Needs query_id, mode, query, question_word, document_title, key_facts of
    the top result. The text is one or two key facts after an introduction
    chosen by the query id. Lower-cased texts are columns of their own, so
    they are built once per row and not once per word.
    """
    d = df.withColumns({"_ws": overview_words(F.col("query")), "_lt": F.lower("document_title"),
                        "_lf": F.lower(F.array_join("key_facts", " "))})
    found = F.transform("_ws", lambda w, i: F.struct(
        F.col("_lt").contains(w).alias("t"), F.col("_lf").contains(w).alias("f"), (-i).alias("i"), w.alias("w")))
    d = d.withColumns({"_found": found, "_n": F.length("_lt") + F.length("_lf")})
    best = F.array_max(F.transform("_found", lambda x: F.struct(
        (x["t"].cast("int") + x["f"].cast("int")).alias("s"), x["i"].alias("i"), x["w"].alias("w"))))
    hits = F.size(F.filter("_found", lambda x: x["t"] | x["f"]))
    clean = F.filter(F.transform("key_facts", lambda f: X.strip(F.regexp_replace(f, r"\.+$", ""))), lambda f: f != "")
    d = d.withColumns({
        "_kw": F.coalesce(best["w"], F.lit("")),
        "_facts": F.transform(clean, lambda f: F.struct(f.alias("f"), F.lower(f).alias("l"))),
        "shown": F.when(F.col("mode").isin("browse", "local", "shop"), False)
                  .when(F.col("mode").isin("answer", "compare"), True)
                  .when((F.col("mode") == "explore") & (F.size("_ws") > 0), hits / F.size("_ws") >= 0.75)
                  .otherwise(False)})

    def facts_with(cond) -> Column:
        return F.transform(F.filter("_facts", lambda x: cond(x["l"])), lambda x: x["f"])

    by_word = F.array().cast("array<string>")
    for word, marks in R.FACT_WORDS.items():
        pat = "|".join(marks) + (r"|\b\d{4}\b" if word == "when" else "")
        by_word = F.when(F.lower("question_word") == word, F.transform(F.filter("_facts", _fact_matcher(pat)), lambda x: x["f"])).otherwise(by_word)
    d = d.withColumns({"_bw": by_word,
                       "_bk": F.when(F.col("_kw") != "", facts_with(lambda x: x.contains(F.col("_kw"))))})
    pick = F.slice(F.when(F.size("_bw") > 0, F.col("_bw")).when(F.size("_bk") > 0, F.col("_bk"))
                   .otherwise(F.transform(F.slice("_facts", 1, 1), lambda x: x["f"])), 1, 2)
    asks = reduce(lambda a, b: a | b, [F.lower("query").startswith(w) for w in R.QUESTION_STARTS])
    turn = F.conv(F.substring(F.md5("query_id"), 1, 2), 16, 10).cast("int") % 4
    intro = F.get(F.when(asks, F.array(*[F.lit(x) for x in R.QUESTION_INTROS]))
                  .otherwise(F.array(*[F.lit(x) for x in R.PLAIN_INTROS])), turn)
    text = F.when(F.size("_facts") > 0, F.concat(intro, F.lit(" "), F.array_join(pick, ". "), F.lit(".")))
    return d.withColumn("overview", text).select(*df.columns, "shown", "overview")


def _fact_matcher(pattern: str):
    return lambda x: x["l"].rlike(pattern)
