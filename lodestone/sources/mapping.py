"""The content-search data model laid over the star-schema tables.

Each function returns a DataFrame with the model's column names. Text columns
always use the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import index as IX
from lodestone.operators import vocab as V
from lodestone.rules import fixed as R
from lodestone.sources.built import built
from lodestone.sources.tables import Tables

SENTENCE = r"[.\n]+"


def sentences(c):
    return F.filter(F.transform(F.split(c, SENTENCE), X.strip), lambda s: s != "")


def documents(t: Tables, embeddings: bool = False) -> DataFrame:
    """Document collection: one row per document, quality labels joined in."""
    lab = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\p{Lu}\p{L}+)"), F.lit(1)))
    facts = sentences(F.col("text"))
    d = (t.documents.join(lab, "doc_id", "left")
         .select(
             F.col("doc_id"), F.col("doc_id").cast("string").alias("document_uuid"),
             "text", "lang", "source", "n_chars", "quality", "toxic",
             # the first sentence, found without splitting the whole text
             X.strip(F.regexp_extract("text", r"[^.\n]*[^.\n\s][^.\n]*", 0)).alias("document_title"),
             F.col("text").alias("document_summary"),
             F.col("lang").alias("document_data_type"),
             F.col("source").alias("document_schema"),
             F.col("source").alias("document_category"),
             facts.alias("key_facts"),
             names.alias("entity_names"),
             F.col("n_chars").alias("word_count"),
             F.least(F.col("n_chars") / 100.0, F.lit(100.0)).alias("content_depth_score"),
             F.coalesce(F.col("quality") * 100, F.lit(50)).cast("double").alias("authority_rank_score"))
         .withColumns({
             "primary_keywords": X.match_tokens(F.col("document_title")),
             "semantic_keywords": F.array("lang", "source"),
             "topic_tags": F.array("source"),
             "primary_subject_name": F.coalesce(F.get("entity_names", F.lit(0)), F.lit("")),
             "secondary_subjects": F.slice("entity_names", 2, 3),
             "primary_subject_confidence": F.when(F.col("quality") == 1, "HIGH")
                                            .when(F.col("quality") == 0, "LOW").otherwise("MEDIUM"),
             "primary_subject_type": F.when(F.col("lang") == "en", "PERSON")
                                      .when(F.col("lang") == "fr", "PLACE")
                                      .when(F.col("lang") == "de", "EVENT").otherwise("WORK"),
         }))
    if embeddings:
        e = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding",
                                F.col("label").cast("string").alias("cluster_uuid"))
        d = d.join(e, "doc_id", "left")
    return d


def keyword_index(t: Tables, weights: dict[str, int] | None = None, name: str = "keyword", bits: tuple[str, ...] | None = None) -> IX.KeywordIndex:
    """The stored index of the collection over the given fields, with the bits of all fields or of the named ones; built by the first who asks for it."""
    return IX.build(documents(t), weights, lambda part, make, by: built(t, f"{name}_{part}", ("documents", "labels"), make, by), bits=bits)


def query_log(t: Tables) -> DataFrame:
    """One query per sentence of every user turn; the session is the conversation."""
    return (t.conversations.where(F.col("role") == "user")
            .select("conv_id", "turn", F.posexplode(F.split("text", SENTENCE)).alias("pos", "s"))
            .select(F.concat_ws("-", "conv_id", "turn", "pos").alias("query_id"),
                    F.col("conv_id").alias("session_id"),
                    X.sanitize_query(F.col("s"), cap=None).alias("query"))
            .where(F.col("query") != ""))


def query_words(queries: DataFrame) -> DataFrame:
    """(query_id, pos, word): lower-case words, positions from 1."""
    return (queries.select("query_id", F.posexplode(X.words(F.col("query"))).alias("p", "word"))
            .select("query_id", (F.col("p") + 1).alias("pos"), "word"))


def events(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", "ts", "user_id", "event_type", "value", "props",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.to_date("ts").alias("event_date"),
        F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("session_id"))


def searches(t: Tables) -> DataFrame:
    """Search events: the views, with results, time and mode."""
    return (events(t).where(F.col("event_type") == "view")
            .withColumns({
                "results_count": F.col("k"),
                "search_time_ms": F.col("value"),
                "mode": F.when(F.col("k") % 2 == 0, "n").otherwise("y"),
                "query": F.concat(F.lit("query "), (F.col("k") % 25).cast("string")),
            }))


def clicks(t: Tables) -> DataFrame:
    return (events(t).where(F.col("event_type") == "click")
            .withColumns({
                "clicked_position": F.col("k"),
                "time_to_click_ms": (F.col("value") * 100).cast("bigint"),
                "doc_key": F.col("k") % 20,
                "clicked_url": F.concat(F.lit("https://site.example/"), (F.col("k") % 20).cast("string")),
                "query": F.concat(F.lit("query "), (F.col("k") % 25).cast("string")),
            }))


def user_places(t: Tables) -> DataFrame:
    """custkey -> city (nation) and state (region)."""
    return (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("c_custkey").alias("place_user"), F.col("n_name").alias("location_city"),
                    F.col("r_name").alias("location_country")))


def with_place(df: DataFrame, t: Tables) -> DataFrame:
    return df.join(user_places(t), F.col("user_id") == F.col("place_user"), "left").drop("place_user")


def vocabulary_tokens(t: Tables) -> DataFrame:
    """(term, lang, n): match-token counts per language over whole texts; a stored table."""
    return built(t, "vocabulary", ("documents",), lambda: (
        t.documents.select("lang", F.explode(X.token_list(F.col("text"), R.MATCH_STOPWORDS)).alias("term"))
        .groupBy("term", "lang").agg(F.count("*").alias("n"))), "term")


def vocabulary(t: Tables) -> DataFrame:
    """term, category (most frequent language), rank (count), pos."""
    return (vocabulary_tokens(t).groupBy("term")
            .agg(F.sum("n").alias("rank"),
                 F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("category"))
            .select("term", "category", "rank", F.lit("noun").alias("pos")))


def vocabulary_by_category(t: Tables) -> DataFrame:
    """One row per (term, language); the several-categories form of the vocabulary."""
    return vocabulary_tokens(t).select("term", F.col("lang").alias("category"), F.col("n").alias("rank"),
                                       F.lit("noun").alias("pos"))


def completion_lists(t: Tables) -> DataFrame:
    """The best terms of every prefix of the vocabulary by category; a stored table."""
    return built(t, "completions", ("documents",), lambda: V.completions(vocabulary_by_category(t)), "key")


def ngrams(t: Tables, n: int, least: int = 1) -> DataFrame:
    """Adjacent-token n-grams seen at least ``least`` times; a stored table."""
    return built(t, f"ngrams_{n}_{least}", ("documents",), lambda: count_ngrams(t, n, least), "term")


#: Languages that are counted in columns of their own; with more, counts are kept a row for each.
LANGUAGES = 64


def count_ngrams(t: Tables, n: int, least: int = 1, prefix: str = "") -> DataFrame:
    """(term, category, rank, pos): adjacent-token n-grams that start with ``prefix`` and are seen at least ``least`` times.

    Each language is counted in a column, so a gram is one row of a task from
    the start and is shuffled once, by the term that the stored table is bucketed by.
    """
    toks = t.documents.select("lang", X.token_list(F.col("text"), R.MATCH_STOPWORDS).alias("tk"))
    # the last token of a gram with those before it
    grams = F.when(F.size("tk") >= n, F.transform(
        F.slice("tk", F.lit(n), F.size("tk") - (n - 1)),
        lambda x, i: F.concat(*[y for k in range(n - 1) for y in (F.get("tk", i + k), F.lit(" "))], x)))
    each = toks.select("lang", F.explode(grams).alias("term")).where(F.col("term").startswith(prefix))
    # the languages come to the driver, at most one more than are used
    langs = [r[0] for r in t.documents.select("lang").distinct().limit(LANGUAGES + 1).collect()]
    if 0 < len(langs) <= LANGUAGES:
        per = each.groupBy("term").agg(*[F.count_if(F.col("lang").eqNullSafe(F.lit(v))).alias(f"_{i}") for i, v in enumerate(langs)])
        sums = F.array(*[F.struct((-F.col(f"_{i}")).alias("n"), F.lit(v).cast("string").alias("lang")) for i, v in enumerate(langs)])
        per = per.select("term", F.filter(sums, lambda x: x["n"] < 0).alias("_n"))
        per = per.select("term", (-F.aggregate("_n", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])).alias("rank"), F.array_min("_n")["lang"].alias("category"))
    else:
        per = each.groupBy("term", "lang").agg(F.count("*").alias("n")).groupBy("term").agg(
            F.sum("n").alias("rank"), F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("category"))
    return per.where(F.col("rank") >= least).select("term", "category", "rank", F.lit("noun").alias("pos"))


def products(t: Tables) -> DataFrame:
    """Products with review count and rating from the order lines."""
    rev = (t.lineitem.groupBy("l_partkey")
           .agg(F.count("*").alias("product_review_count"), F.sum("l_quantity").alias("q")))
    return (t.part.join(rev, F.col("p_partkey") == F.col("l_partkey"), "left")
            .select("p_partkey", F.col("p_name").alias("product_name"), F.col("p_brand").alias("product_brand"),
                    F.col("p_type").alias("product_category"), F.array("p_size").alias("product_sizes"),
                    F.split("p_name", " ")[0].alias("product_color"),
                    F.col("p_retailprice").alias("product_price"),
                    F.coalesce("product_review_count", F.lit(0)).alias("product_review_count"),
                    F.round(F.col("q") / F.col("product_review_count") / 10, 4).alias("product_rating"),
                    (F.col("p_partkey") % 3 == 0).alias("black_owned"),
                    (F.col("p_partkey") % 7 != 0).alias("in_stock")))


def eateries(t: Tables) -> DataFrame:
    """Suppliers as eateries and businesses, nation as city, region as state."""
    rev = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("service_review_count"))
    return (t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .join(rev, F.col("s_suppkey") == F.col("l_suppkey"), "left")
            .select("s_suppkey", F.col("s_name").alias("document_title"), F.col("n_name").alias("location_city"),
                    F.col("r_name").alias("location_state"),
                    F.round(F.pmod(F.col("s_acctbal"), F.lit(5.0)), 2).alias("service_rating"),
                    F.coalesce("service_review_count", F.lit(0)).alias("service_review_count"),
                    F.concat(F.lit("type"), (F.col("s_suppkey") % 4).cast("string")).alias("service_type"),
                    F.repeat(F.lit("$"), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("price_symbol"),
                    (F.col("s_suppkey") % 2 == 0).alias("delivery"),
                    (F.col("s_suppkey") % 5 == 0).alias("reservations"),
                    (F.col("s_suppkey") % 3 == 0).alias("black_owned"),
                    F.col("s_acctbal").alias("authority_score")))


def trips(t: Tables) -> DataFrame:
    """Orders as dated travel events in the customer's country."""
    return (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("o_orderkey", F.col("o_orderstatus").alias("event_type"),
                    F.to_date("o_orderdate").alias("event_date_start"),
                    F.col("n_name").alias("location_country"), F.col("r_name").alias("location_region"),
                    F.col("o_orderpriority").alias("topic"),
                    (F.col("o_totalprice") < 50000).alias("is_free"),
                    F.col("o_totalprice").alias("price")))


def questions(t: Tables) -> DataFrame:
    """Question table: benchmark passages with the vector and label of the same id."""
    return (t.benchmark.join(t.embeddings, F.col("item_id") == F.col("vec_id"), "left")
            .select("item_id", F.col("item_id").cast("string").alias("document_uuid"),
                    F.col("text").alias("question"), F.col("label"), "embedding",
                    X.match_tokens(F.col("text")).alias("tokens"),
                    F.when(F.col("label") % 3 == 0, "PERSON").when(F.col("label") % 3 == 1, "FACTUAL")
                     .otherwise("TEMPORAL").alias("question_type")))


def page_fields(t: Tables) -> DataFrame:
    """Title, host, images of the web pages."""
    return t.pages.select(
        "page_id", "url", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"),
        X.strip(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)).alias("title"),
        F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)).alias("image_url"),
        F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("lang"))


def pos_by_language(c):
    """Part of speech standing for each language, so that grammar rules have work to do."""
    return (F.when(c == "en", "noun").when(c == "fr", "verb").when(c == "de", "adjective").otherwise("adverb"))


def category_by_language(c):
    return (F.when(c == "en", "Education").when(c == "fr", "US City").when(c == "de", "Person").otherwise("US State"))


def named_vocabulary(t: Tables) -> DataFrame:
    """The vocabulary with category names and parts of speech of the search domain."""
    return vocabulary(t).withColumns({"pos": pos_by_language(F.col("category")),
                                      "category": category_by_language(F.col("category"))})


def named_ngrams(t: Tables, n: int, least: int = 2) -> DataFrame:
    """The phrase table of query understanding: a phrase is what occurs at least ``least`` times."""
    return ngrams(t, n, least).withColumns({"pos": pos_by_language(F.col("category")),
                                     "category": category_by_language(F.col("category"))})


def typed_prefixes(t: Tables) -> DataFrame:
    """Typed texts: every distinct query word and its first four letters."""
    w = query_words(query_log(t)).select("word").distinct()
    return (w.select(F.col("word").alias("prefix")).unionAll(w.select(F.substring("word", 1, 4).alias("prefix"))).distinct())


def scored_questions(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("question_key"), F.col("text").alias("question"),
                              F.length("text").cast("bigint").alias("question_score"))


# each query is asked in one of these forms, so that signal words occur
ASK_FORMS = [
    "who is the first president of {q}", "best restaurants near me {q}", "cheap shoes vs expensive boots {q}",
    "how to cook soul food {q}", "where can i find {q} in my area", "{q} hotels not far without parking",
    "buy black owned clothing {q}", "list of top rated schools in {q}", "define {q}", "what are the newest {q} studio music songs",
    "{q}", "is {q} or {q} better", "famous black doctors {q} reviews",
]


def asked_queries(t: Tables) -> DataFrame:
    """The query log with each query whole in one of the forms."""
    q = query_log(t)
    n = F.pmod(F.length("query") + F.col("session_id"), F.lit(len(ASK_FORMS)))
    out = F.lit(None).cast("string")
    for i, form in enumerate(ASK_FORMS):
        parts = form.split("{q}")
        cols = [F.lit(parts[0])]
        for p in parts[1:]:
            cols += [F.col("query"), F.lit(p)]
        out = F.when(n == i, F.concat(*cols)).otherwise(out)
    return q.withColumn("query", X.sanitize_query(out, cap=None))
