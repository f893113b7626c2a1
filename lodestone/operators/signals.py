"""Signals of a query log: one window pass and one group-by per query.

Input words carry query_id, pos, word, pos_tag, score, category, status.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.rules import lexicon as L

def by_pos():
    return W.partitionBy("query_id").orderBy("pos")


def _word_columns(words: DataFrame, ngrams: DataFrame | None) -> DataFrame:
    """Neighbours within two positions, query length and the n-gram at each word."""
    cols = {"n_words": F.count("*").over(W.partitionBy("query_id"))}
    for i in (1, 2):
        cols[f"p{i}"], cols[f"n{i}"] = F.lag("word", i).over(by_pos()), F.lead("word", i).over(by_pos())
    if ngrams is None:
        d = words.withColumn("gram", F.lit(None).cast("string"))
    else:
        g = ngrams.select("query_id", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("pos"), "gram")
        d = words.join(g, ["query_id", "pos"], "left")
    cols["gram_before"], cols["gram_after"] = F.lag("gram").over(by_pos()), F.lead("gram").over(by_pos())
    return d.withColumns(cols)


def domain_of_words(d: DataFrame) -> DataFrame:
    """Adds ``domains``: the domains a word counts for; ambiguous words take
    the domain with most distinct context words within two positions."""
    w = F.col("word")
    ctx = F.array_distinct(F.filter(F.array("p2", "p1", "n1", "n2"), lambda x: x.isNotNull() & (x != w)))
    direct = F.array_compact(F.array(*[F.when(w.isin(ws), F.lit(name)) for name, ws in L.DOMAINS.items()]))
    scored = F.array(*[F.struct(F.size(F.filter(ctx, _member(ws))).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name"))
                       for i, (name, ws) in enumerate(L.DOMAINS.items())])
    best = F.array_max(scored)
    resolved = F.when(best["n"] > 0, F.array(best["name"])).otherwise(F.array().cast("array<string>"))
    return d.withColumn("domains", F.when(w.isin(L.AMBIGUOUS), resolved).when(F.col("category") == "stopword", F.array().cast("array<string>"))
                        .otherwise(direct))


def _member(ws):
    return lambda x: x.isin(list(ws))


def signals(words: DataFrame, queries: DataFrame, ngrams: DataFrame | None = None, flags: str | None = None) -> DataFrame:
    """All signals of every query.

    ``flags`` names an array column of context flags on the words.
    """
    d = domain_of_words(_word_columns(words, ngrams))
    w, pos, tag, cat = F.col("word"), F.col("pos"), F.lower("pos_tag"), F.lower("category")
    last_word = pos == F.col("n_words")

    def any_(cond: Column) -> Column:
        return F.bool_or(F.coalesce(cond, F.lit(False)))

    def last(cond: Column, value: Column = w) -> Column:
        return F.max_by(value, F.when(cond, pos))

    def first(cond: Column, value: Column = w) -> Column:
        return F.min_by(value, F.when(cond, pos))

    def listed(cond: Column, value: Column = w) -> Column:
        got = F.sort_array(F.collect_list(F.when(cond, F.struct(pos.alias("p"), value.alias("v")))))
        return F.transform(got, lambda x: x["v"])

    is_old, is_new = w.isin(L.TEMPORAL_OLDEST), w.isin(L.TEMPORAL_NEWEST)
    action = reduce(lambda acc, kv: F.when(w.isin(kv[1]), kv[0]).otherwise(acc), reversed(L.ACTIONS.items()), F.lit(None))
    prox, marker, neg = w.isin(L.PROXIMITY), w.isin(L.COMPARISON_MARKERS), w.isin(L.NEGATION)
    price = F.when(w.isin(L.PRICE_CHEAP), "cheap").when(w.isin(L.PRICE_EXPENSIVE), "expensive")
    noun = tag.isin("noun", "proper_noun")
    plural = noun & w.endswith("s") & (F.length(w) > 3)
    negated = F.array_join(F.filter(F.array("n1", "n2"), lambda x: x.isNotNull() & ~x.isin(L.NEGATION_SKIP)), " ")
    sides = F.array_compact(F.array(F.coalesce("gram_before", "p1"), F.coalesce("gram_after", "n1")))
    entity = (tag == "proper_noun") & (F.col("score") > 100) & (cat != "stopword")
    agg = {
        "word_count": F.count("*"), "has_question_word": any_(w.isin(L.QUESTION_WORDS)), "question_word": last(w.isin(L.QUESTION_WORDS)),
        "question_position": last(w.isin(L.QUESTION_WORDS), F.when(pos == 1, "start").when(last_word, "end").otherwise("middle")),
        "has_question_starter": any_((pos == 1) & w.isin(L.QUESTION_STARTERS)), "question_starter": first((pos == 1) & w.isin(L.QUESTION_STARTERS)),
        "has_temporal": any_(is_old | is_new), "temporal_word": last(is_old | is_new),
        "temporal_direction": last(is_old | is_new, F.when(is_old, "oldest").otherwise("newest")),
        "has_proximity": any_(prox), "_prox_first": first(prox & ~last_word), "_prox_last": last(prox),
        "has_location_preposition": any_(w.isin(L.LOCATION_PREPOSITIONS)), "location_preposition": last(w.isin(L.LOCATION_PREPOSITIONS)),
        "has_me_reference": any_(w.isin(L.ME_WORDS)), "my_place": any_((w == "my") & F.col("n1").isin(L.MY_PLACES)),
        "has_superlative": any_(w.isin(L.SUPERLATIVE)), "superlative_word": last(w.isin(L.SUPERLATIVE)),
        "has_quantity_word": any_(w.isin(L.QUANTITY)), "quantity_word": last(w.isin(L.QUANTITY)),
        "has_action_word": any_(action.isNotNull()), "action_word": first(action.isNotNull()), "action_type": first(action.isNotNull(), action),
        "has_service_word": any_(w.isin(L.SERVICE)), "service_words": listed(w.isin(L.SERVICE)),
        "has_product_word": any_(w.isin(L.PRODUCT)), "product_words": listed(w.isin(L.PRODUCT)),
        "has_role_word": any_(w.isin(L.ROLE)), "role_word": first(w.isin(L.ROLE)),
        "has_rating_signal": any_(w.isin(L.RATING)), "rating_word": last(w.isin(L.RATING)), "_compare": any_(w.isin(L.COMPARISON)),
        "is_definition_query": any_((pos == 1) & (((w == "what") & F.col("n1").isin("is", "are", "was", "were"))
                                                  | ((w == "who") & F.col("n1").isin("is", "was")) | (w.isin(L.DEFINITION) & F.col("n1").isNotNull()))),
        "comparison_items": F.flatten(listed(marker, sides)),
        "has_negation": any_(neg), "negation_words": listed(neg), "negated_terms": F.filter(listed(neg, negated), lambda x: x != ""),
        "has_price_signal": any_(price.isNotNull()), "price_direction": first(price.isNotNull(), price), "price_word": first(price.isNotNull()),
        "_owned_pair": any_((w == "black") & (F.col("n1") == "owned")),
        "has_location": any_(cat.isin(L.PLACE_CATEGORIES)), "location_terms": listed(cat.isin(L.PLACE_CATEGORIES)),
        "has_plural_noun": any_(plural), "plural_nouns": listed(plural), "starts_with_noun": any_(noun & (pos == 1)),
        "ends_with_noun": any_(noun & last_word), "has_adjective": any_(tag == "adjective"),
        "has_verb": any_(tag.isin("verb", "be", "auxiliary", "modal")),
        "_nouns": F.count_if(noun), "_content": F.count_if(cat != "stopword"), "unknown_term_count": F.count_if(F.col("status") == "unknown"),
        "has_person": any_(cat.isin("person", "name")), "has_organization": any_(cat.isin("business", "organization")),
        "entities": F.collect_list(F.when(entity, F.struct((-F.col("score")).alias("neg"), w.alias("text"), cat.alias("category")))),
        **{"domain_" + n: F.count_if(F.array_contains("domains", n)) for n in L.DOMAINS},
    }
    if flags:
        raised = {}
        for flag, sigs in L.FLAG_SIGNALS.items():
            for s in sigs:
                raised.setdefault(s, []).append(flag)
        for s, fs in raised.items():
            agg["_flag_" + s] = any_(F.arrays_overlap(F.col(flags), F.array(*[F.lit(f) for f in fs])))
    s = queries.select("query_id", "query").join(d.groupBy("query_id").agg(*[v.alias(k) for k, v in agg.items()]), "query_id")
    extra = [x[6:] for x in agg if x.startswith("_flag_")]
    s = s.withColumns({x: (F.coalesce(F.col(x), F.lit(False)) if x in agg else F.lit(False)) | F.col("_flag_" + x) for x in extra})
    for x in ("has_food_word", "has_beauty_word", "has_entertainment_word", "has_culture_word", "has_color_modifier",
              "has_size_modifier", "has_acronym"):
        if x not in extra:
            s = s.withColumn(x, F.lit(False))
    owned = reduce(lambda a, b: a | b, [F.lower("query").contains(p) for p in L.OWNED_PHRASES])
    ranked = F.sort_array(F.filter(F.array(*[F.struct((-F.col("domain_" + n)).alias("neg"), F.lit(i).alias("i"), F.lit(n).alias("name"))
                                             for i, n in enumerate(L.DOMAINS)]), lambda x: x["neg"] < 0))
    if ngrams is not None:
        g = ngrams.where(F.col("category") != "").groupBy("query_id").agg(
            F.collect_list(F.struct((-F.col("rank")).alias("neg"), F.col("gram").alias("text"), F.lower("category").alias("category"))).alias("_ng"),
            any_(F.lower("category").isin(L.PLACE_CATEGORIES)).alias("_ngloc"))
        s = s.join(g, "query_id", "left").withColumns({
            "entities": F.concat("entities", F.coalesce("_ng", F.filter("entities", lambda x: F.lit(False)))),
            "_ngloc": F.coalesce("_ngloc", F.lit(False))})
    else:
        s = s.withColumn("_ngloc", F.lit(False))
    s = s.withColumns({
        "proximity_word": F.coalesce("_prox_first", "_prox_last"), "has_me_reference": F.col("has_me_reference") | F.col("my_place"),
        "is_comparison_query": F.col("_compare") | (F.size("comparison_items") >= 2),
        "comparison_items": F.when(F.size("comparison_items") >= 2, F.col("comparison_items")).otherwise(F.array().cast("array<string>")),
        "has_black_owned": owned | F.col("_owned_pair"),
        "all_nouns": (F.col("_content") > 0) & (F.col("_nouns") == F.col("_content")),
        "has_unknown_terms": F.col("unknown_term_count") > 0,
        "domains_detected": F.transform(ranked, lambda x: x["name"]), "primary_domain": F.get(ranked, F.lit(0))["name"],
        "detected_entities": F.transform(F.sort_array("entities"), lambda x: x["text"])})
    s = local_signal(s)
    s = s.withColumn("has_location", F.col("has_location") | F.col("_ngloc"))
    s = signal_count(s)
    s = result_wish(query_mode(s))
    return s.drop(*[c for c in s.columns if c.startswith("_")], "my_place", "entities")


def local_signal(s: DataFrame) -> DataFrame:
    """Service word with a place, a proximity word or a reference to oneself; strong when three of four hold."""
    four = reduce(lambda a, b: a + b, [F.col(x).cast("int") for x in
                                       ("has_service_word", "has_location", "has_proximity", "has_me_reference")])
    near = F.col("has_location") | F.col("has_proximity") | F.col("has_me_reference")
    s = s.withColumn("is_local_search", F.col("has_service_word") & near)
    return s.withColumn("local_search_strength", F.when(~F.col("is_local_search"), "none").when(four >= 3, "strong").otherwise("weak"))


def signal_count(s: DataFrame) -> DataFrame:
    return s.withColumn("signal_count", reduce(lambda a, b: a + b, [F.col(x).cast("int") for x in L.COUNTED_SIGNALS]))


def query_mode(s: DataFrame) -> DataFrame:
    """compare, shop, local, answer, browse or explore: the first rule that holds."""
    c, qw = F.col, F.coalesce("question_word", F.lit(""))
    entity = c("has_person") | c("has_organization") | c("has_role_word")
    wants_list = c("has_plural_noun") | c("has_superlative") | c("has_quantity_word") | c("has_service_word")
    answer = (qw.isin("who", "when", "where") | ((qw == "what") & c("is_definition_query"))
              | (qw.isin("what", "how", "why") & (entity | ~wants_list)) | (c("has_temporal") & c("has_role_word")))
    return s.withColumn("query_mode", F.when(c("is_comparison_query"), "compare")
                        .when(c("has_product_word") & (F.coalesce(c("action_type") == "buy", F.lit(False)) | c("has_price_signal")), "shop")
                        .when(c("is_local_search"), "local").when(answer, "answer").when(wants_list, "browse").otherwise("explore"))


def result_wish(s: DataFrame) -> DataFrame:
    """Whether one answer or a list is wanted."""
    c = F.col
    single = ((c("query_mode") == "answer") | c("is_definition_query") | (c("has_temporal") & c("has_role_word"))
              | (F.coalesce(c("question_word").isin("who", "what", "when", "where"), F.lit(False)) & (c("has_temporal") | c("has_role_word"))))
    many = (c("query_mode").isin("browse", "local", "shop") | c("has_plural_noun") | c("has_quantity_word") | c("has_service_word")
            | c("has_product_word") | c("has_superlative") | (c("all_nouns") & ~c("has_question_word")))
    return s.withColumns({"wants_single_result": single, "wants_multiple_results": many})


def infer_domain(s: DataFrame) -> DataFrame:
    """Back-fills a missing primary domain from the flag signals."""
    guess = (F.when(F.col("has_food_word"), "food").when(F.col("has_beauty_word"), "beauty")
             .when(F.col("has_entertainment_word"), "music").when(F.col("has_culture_word"), "culture")
             .when(F.col("has_service_word") & F.col("is_local_search"), "business"))
    return s.withColumn("primary_domain", F.coalesce("primary_domain", guess))


def simple_intent(query: Column) -> Column:
    """Substring rule; short words match inside longer ones, as they always did."""
    q = F.lower(query)

    def has(ws):
        return reduce(lambda a, b: a | b, [q.contains(w) for w in ws])
    return F.when(has(L.INTENT_LOCATION), "location").when(has(L.INTENT_PERSON), "person").otherwise("general")


__all__ = ["signals", "local_signal", "signal_count", "query_mode", "result_wish", "infer_domain", "simple_intent",
           "domain_of_words"]
