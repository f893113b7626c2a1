"""Query understanding over a whole query log: grammar, correction, n-grams, filters.

Input words are (query_id, pos, word) with the pass-1 columns of
``vocab.validate_words``. A query is one sentence, read whole, so windows and
arrays keyed by query are small; the log itself spreads over queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.distance import keyboard_distance, osa_distance
from lodestone.operators import vocab as V
from lodestone.operators.facets import lookup

from lodestone.rules import language as R
from lodestone.session import materialize

def by_pos():
    return W.partitionBy("query_id").orderBy("pos")


# ---- pass 2 ------------------------------------------------------------------------

def predict_pos(words: DataFrame) -> DataFrame:
    """Expected part of speech of unknown words from their neighbours."""
    known = F.when(F.col("status") == "valid", F.col("pos_tag"))
    right = F.when(F.lead("word").over(by_pos()).isNull(), "end").otherwise(F.lead(known).over(by_pos()))

    def rule(part: int, left: Column, right_: Column) -> Column:
        table = {f"{a or ''}|{b or ''}": v[part] for (a, b), v in R.CONTEXT_RULES.items()}
        return lookup(table, F.concat_ws("|", left, right_))

    def pick(part: int) -> Column:
        l, r, none = F.col("_l"), F.col("_r"), F.lit("")
        return F.when(F.col("status") == "unknown", F.coalesce(
            F.when(l.isNotNull() & r.isNotNull(), rule(part, l, r)), F.when(l.isNotNull(), rule(part, l, none)),
            F.when(r.isNotNull() & (r != "end"), rule(part, none, r)), F.lit(R.DEFAULT_POS[part])))

    d = words.withColumns({"_l": F.lag(known).over(by_pos()), "_r": right})
    return d.withColumns({"predicted_pos": pick(0), "pos_confidence": pick(1)}).drop("_l", "_r")


def pos_score(candidate: Column, predicted: Column, confidence: Column) -> Column:
    """Weighted fit of a candidate's part of speech."""
    a, b = F.lower(candidate), F.lower(predicted)
    group = F.create_map(*[x for k, v in R.POS_GROUPS.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])

    def within(key: Column, value: Column) -> Column:
        return F.coalesce(F.array_contains(F.try_element_at(group, key), value), F.lit(False))

    return (F.when(a == b, confidence * R.W_POS_MATCH)
            .when(within(b, a), confidence * 0.8 * R.W_POS_NEAR)
            .when(within(a, b), confidence * 0.7 * R.W_POS_NEAR).otherwise(F.lit(float(R.POS_PENALTY))))


# ---- n-grams -----------------------------------------------------------------------

def query_grams(words: DataFrame, sizes: list[int], word: str = "word") -> DataFrame:
    """(query_id, n, pos, gram) for every n-gram of the query."""
    parts = [F.col(word), *[F.lead(word, i).over(by_pos()) for i in range(1, max(sizes))]]
    d = words.select("query_id", "pos", *[p.alias(f"_w{i}") for i, p in enumerate(parts)])
    grams = F.array(*[F.when(F.col(f"_w{n - 1}").isNotNull(), F.struct(
        F.lit(n).alias("n"), F.concat_ws(" ", *[f"_w{i}" for i in range(n)]).alias("gram"))) for n in sizes])
    return d.select("query_id", "pos", F.explode(F.array_compact(grams)).alias("g")).select("query_id", "g.n", "pos", "g.gram")


def greedy_cover(hits: DataFrame) -> DataFrame:
    """Longest n-grams first, left to right, without overlap.

    hits: (query_id, n, pos, ...). One fold over the query's ordered hits.
    """
    extra = [c for c in hits.columns if c not in ("query_id", "n", "pos")]
    ordered = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("n")).alias("neg"), "pos", "n", *extra))).alias("h"))
    seq = "array<int>"
    start = F.struct(F.array().cast(seq).alias("used"), F.filter("h", lambda x: F.lit(False)).alias("kept"))

    def step(a: Column, h: Column) -> Column:
        span = F.sequence(h["pos"], h["pos"] + h["n"] - 1).cast(seq)
        return F.when(F.arrays_overlap(a["used"], span), a).otherwise(F.struct(
            F.concat(a["used"], span).alias("used"), F.concat(a["kept"], F.array(h)).alias("kept")))

    return (ordered.select("query_id", F.explode(F.aggregate("h", start, step)["kept"]).alias("k"))
            .select("query_id", "k.n", "k.pos", *[f"k.{c}" for c in extra]))


def detect_ngrams(words: DataFrame, grams: DataFrame | list[DataFrame], sizes: list[int] = (3, 2), word: str = "word") -> DataFrame:
    """Known n-grams of each query, chosen greedily; ``grams`` is a table or several, each joined where it lies."""
    asked, hits = query_grams(words, list(sizes), word), None
    for table in grams if isinstance(grams, list) else [grams]:
        part = asked.join(table.select(F.col("term").alias("gram"), "category", "rank"), "gram").select("query_id", "n", "pos", "gram", "category", "rank")
        hits = part if hits is None else hits.unionByName(part)
    return greedy_cover(hits)


def covered(ngrams: DataFrame) -> DataFrame:
    """(query_id, pos) of the words inside the chosen n-grams."""
    return ngrams.select("query_id", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("pos"))


def classify_queries(words: DataFrame, best: DataFrame, grams: DataFrame | list[DataFrame]) -> DataFrame:
    """(query_id, pos, kind, term): n-grams, then single terms, places, stop words, unknown."""
    ng = detect_ngrams(words, grams, [4, 3, 2])
    kinds = lookup({k: v for k, v in {2: "bigram", 3: "trigram", 4: "quadgram"}.items()}, F.col("n"))
    rows = ng.select("query_id", "pos", F.col("gram").alias("term"), "category", kinds.alias("kind"))
    rest = words.join(covered(ng), ["query_id", "pos"], "left_anti").join(
        best.select(F.col("term").alias("word"), "category"), "word", "left")
    stop = F.col("word").isin(R.STOPWORDS)
    single = rest.select("query_id", "pos", F.col("word").alias("term"), F.coalesce("category", F.lit("")).alias("category"),
                         F.when(F.col("category").isNotNull(), "term").when(stop, "stopword").otherwise("unknown").alias("kind"))
    both = rows.unionByName(single)
    kinds = F.array(F.col("kind"), F.when(X.is_location(F.col("category")), F.lit("location")),
                    F.when((F.col("kind") == "term") & F.col("term").isin(R.STOPWORDS), F.lit("stopword")))
    return both.select("query_id", "pos", "term", F.explode(F.array_compact(kinds)).alias("kind"))


# ---- pass 3 ------------------------------------------------------------------------

def context_bonus(cands: DataFrame, grams: DataFrame | list[DataFrame], left: str, term: str, right: str) -> DataFrame:
    """+120 per known bigram with a neighbour, +150 for the known trigram; ``grams`` is a table or several."""
    tables = grams if isinstance(grams, list) else [grams]
    d = cands.withColumns({"_b1": F.when(F.col(left).isNotNull(), F.concat_ws(" ", left, term)),
                           "_b2": F.when(F.col(right).isNotNull(), F.concat_ws(" ", term, right)),
                           "_t": F.when(F.col(left).isNotNull() & F.col(right).isNotNull(), F.concat_ws(" ", left, term, right))})
    for c in ("_b1", "_b2", "_t"):
        d = d.join(V.known_terms(d, c, tables).withColumn(c + "k", F.lit(1)), c, "left")
    yes = {c: F.coalesce(c + "k", F.lit(0)) for c in ("_b1", "_b2", "_t")}
    return d.withColumns({"bigram_bonus": (yes["_b1"] + yes["_b2"]) * R.W_BIGRAM, "trigram_bonus": yes["_t"] * R.W_TRIGRAM}) \
        .drop("_b1", "_b2", "_t", "_b1k", "_b2k", "_tk")


def letters(word: Column) -> Column:
    """A bit for each letter of a word, by its code modulo 64; an edit takes at most one away and adds at most one."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(x) % 64)
    return F.aggregate(F.split(F.lower(word), ""), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(bit(x)))


def correct_pairs(words: DataFrame, bigrams: DataFrame) -> DataFrame:
    """Two unknown neighbours corrected together to the closest bigram.

    A summed distance of at most four means one word is within one edit or
    both are within two; each case is an equi-join on near words. Where both
    are within two edits the hits are found first. A further hit has a word
    three edits away or more, so only pairs that it may still serve better
    meet all bigrams of a near word, and of those only the ones that share
    enough letters have their distance computed.
    """
    nxt = F.lead("word").over(by_pos())
    pairs = (words.withColumns({"word2": nxt, "_s2": F.lead("status").over(by_pos())})
             .where((F.col("status") == "unknown") & (F.col("_s2") == "unknown")).select("query_id", "pos", "word", "word2"))
    b = bigrams.select("term", F.split("term", " ")[0].alias("b1"), F.split("term", " ")[1].alias("b2"))
    uniq = materialize(pairs.select("word", "word2").distinct(), "pair-words")
    every = uniq.select("word").unionAll(uniq.select("word2")).distinct()
    parts = b.select(F.col("b1").alias("term")).unionAll(b.select("b2")).distinct()
    near = materialize(V.near_terms(every, parts, 2, loose=True).withColumn("d", osa_distance("word", "term")).where("d <= 2"), "pair-near")
    n1 = near.select("word", F.col("term").alias("b1"), F.col("d").alias("d1"))
    n2 = near.select(F.col("word").alias("word2"), F.col("term").alias("b2"), F.col("d").alias("d2"))
    lim = R.MAX_PAIR_DISTANCE

    def closest(hits: DataFrame) -> DataFrame:
        return (hits.where(F.col("dist") <= lim).groupBy("word", "word2")
                .agg(F.min(F.struct("dist", "term")).alias("m")).select("word", "word2", "m.dist", "m.term"))

    # of the bigrams, far more than the pairs, only those with two near words move
    held = b.join(n1.select("b1"), "b1", "left_semi").join(n2.select("b2"), "b2", "left_semi")
    both = (uniq.join(n1, "word").join(held, "b1").join(n2, ["word2", "b2"])
            .select("word", "word2", "term", (F.col("d1") + F.col("d2")).alias("dist")))
    met = materialize(closest(both), "pair-met")
    found = uniq.join(met.select("word", "word2", F.col("dist").alias("_dist"), F.col("term").alias("_term")), ["word", "word2"], "left")

    def further(near: DataFrame, d: str, part: str, word: str, other: str) -> DataFrame:
        """Hits of bigrams whose ``part`` is within an edit of its word, by the distance of ``word`` to ``other``, three or more."""
        least, left = F.col(d) + 3, F.least(F.coalesce("_dist", F.lit(lim)), F.lit(lim)) - F.col(d)
        may = F.col("_dist").isNull() | (least <= F.col("_dist"))
        asked = found.join(near.where(F.col(d) <= 1), {"word": "word2", "word2": "word"}[word]).where(may)
        asked = materialize(asked.withColumns({"_left": left, "_have": letters(F.col(word))}), "pair-open")
        hits = asked.join(b.withColumn("_want", letters(F.col(other))), part)
        hits = hits.where(F.col("_dist").isNull() | (least < F.col("_dist")) | (F.col("term") < F.col("_term")))
        lost = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y)))) <= F.col("_left")
        hits = hits.where((F.abs(F.length(word) - F.length(other)) <= F.col("_left")) & lost("_have", "_want") & lost("_want", "_have"))
        hits = hits.where(F.levenshtein(word, other, 2 * lim) >= 0).withColumn("_far", osa_distance(word, other))
        return hits.select("word", "word2", "term", (F.col(d) + F.col("_far")).alias("dist"))

    best = closest(met.select("word", "word2", "term", "dist").unionByName(further(n1, "d1", "b1", "word2", "b2")).unionByName(further(n2, "d2", "b2", "word", "b1")))
    hits = pairs.join(best, ["word", "word2"]).select("query_id", F.lit(2).alias("n"), "pos", "word", "word2", "term", "dist")
    return greedy_cover(hits).drop("n")


def score_candidates(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, predicted_pos, pos_confidence, term, ...): candidates of each distinct unknown word
    with every part of the score that does not depend on neighbours."""
    unknown = words.where(F.col("status") == "unknown").select("word", "predicted_pos", "pos_confidence").distinct()
    row = F.struct("category", "rank", "pos", "distance")
    sug = (V.fuzzy_candidates(unknown.select("word"), vocab, R.MAX_DISTANCE).where(F.col("distance") <= R.MAX_DISTANCE)
           .groupBy("word", "term").agg(F.min_by(row, F.struct(-F.col("rank"), F.col("category"))).alias("r")).select("word", "term", "r.*"))
    c = sug.select("word", "term", F.col("category").alias("c_category"), F.col("rank").alias("c_rank"),
                   F.col("pos").alias("c_pos"), "distance").withColumn("keyboard_distance", keyboard_distance("word", "term"))
    c = unknown.join(c, "word")
    ps = pos_score(F.col("c_pos"), F.col("predicted_pos"), F.col("pos_confidence"))
    return c.withColumn("pos_score", ps).withColumn(
        "base_score", -R.W_DISTANCE * F.col("distance") - R.W_KEYBOARD * F.col("keyboard_distance") + F.col("pos_score")
        + R.W_FREQUENCY * F.col("c_rank"))


def correct_words(words: DataFrame, vocab: DataFrame, bigrams: DataFrame, trigrams: DataFrame) -> DataFrame:
    """Pass 3: unknown words replaced by their best candidate.

    Neighbour pairs first, then single words left to right: the left context
    of a word is its already corrected neighbour, so the choice folds over the
    positions of the query with each candidate's possible left partners at hand.
    """
    keys = ["query_id", "pos"]
    words = materialize(words, "words")
    pair = correct_pairs(words, bigrams)
    fixed = pair.select("query_id", F.posexplode(F.split("term", " ")).alias("i", "fixed"), F.col("pos").alias("p0"), F.col("dist").alias("pair_distance")) \
        .select("query_id", (F.col("p0") + F.col("i")).alias("pos"), "fixed", "pair_distance")
    w = words.join(fixed, keys, "left")
    w = materialize(w.withColumn("right_word", F.lead(F.coalesce("fixed", "word")).over(by_pos())), "words")
    cands = materialize(score_candidates(words, vocab), "candidates")
    occ = (w.where((F.col("status") == "unknown") & F.col("fixed").isNull())
           .join(cands, ["word", "predicted_pos", "pos_confidence"]))
    # left partners: the raw left word and every candidate it may become
    left_raw = w.select("query_id", (F.col("pos") + 1).alias("pos"), F.coalesce("fixed", "word").alias("left_word"))
    left_opt = left_raw.unionByName(occ.select("query_id", (F.col("pos") + 1).alias("pos"), F.col("term").alias("left_word"))).distinct()
    grams2 = bigrams.select("term").distinct()
    grams3 = trigrams.select("term").distinct()
    opts = occ.select(*keys, "term", "right_word").join(left_opt, keys)
    hit2 = (opts.withColumn("g", F.concat_ws(" ", "left_word", "term")).join(grams2.withColumnRenamed("term", "g"), "g", "left_semi")
            .groupBy(*keys, "term").agg(F.collect_set("left_word").alias("left2")))
    hit3 = (opts.where(F.col("right_word").isNotNull()).withColumn("g", F.concat_ws(" ", "left_word", "term", "right_word"))
            .join(grams3.withColumnRenamed("term", "g"), "g", "left_semi")
            .groupBy(*keys, "term").agg(F.collect_set("left_word").alias("left3")))
    right = (occ.select("term", "right_word").where(F.col("right_word").isNotNull()).distinct()
             .withColumn("g", F.concat_ws(" ", "term", "right_word")).join(grams2.withColumnRenamed("term", "g"), "g", "left_semi")
             .select("term", "right_word", F.lit(1).alias("right2")))
    none = F.array().cast("array<string>")
    full = (occ.join(hit2, [*keys, "term"], "left").join(hit3, [*keys, "term"], "left").join(right, ["term", "right_word"], "left")
            .select(*keys, F.struct(
                "term", (F.col("base_score") + F.coalesce("right2", F.lit(0)) * R.W_BIGRAM).alias("base"),
                F.coalesce("left2", none).alias("left2"), F.coalesce("left3", none).alias("left3")).alias("c"))
            .groupBy(*keys).agg(F.collect_list("c").alias("cands")))
    seq = w.select(*keys, F.coalesce("fixed", "word").alias("word")).join(full, keys, "left")
    per_query = seq.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "cands"))).alias("ws"))
    out_type = "array<struct<pos:int,term:string,score:double>>"
    start = F.struct(F.lit("").alias("prev"), F.array().cast(out_type).alias("out"))

    def step(a: Column, x: Column) -> Column:
        best = F.array_max(F.transform(x["cands"], lambda c: F.struct(
            (c["base"] + F.array_contains(c["left2"], a["prev"]).cast("int") * R.W_BIGRAM
             + F.array_contains(c["left3"], a["prev"]).cast("int") * R.W_TRIGRAM).alias("score"),
            c["term"].alias("term"))))
        picked = F.array(F.struct(x["pos"].alias("pos"), best["term"].alias("term"), best["score"].alias("score"))).cast(out_type)
        return F.when(best.isNull(), F.struct(x["word"].alias("prev"), a["out"].alias("out"))).otherwise(
            F.struct(best["term"].alias("prev"), F.concat(a["out"], picked).alias("out")))

    chosen = (per_query.select("query_id", F.explode(F.aggregate("ws", start, step)["out"]).alias("o"))
              .select("query_id", "o.pos", F.col("o.term").alias("best_term"), F.col("o.score").alias("final_score")))
    detail = cands.select("word", "predicted_pos", "pos_confidence", F.col("term").alias("best_term"), "c_category", "c_rank", "c_pos",
                          "distance", "keyboard_distance", "pos_score")
    r = w.join(chosen, keys, "left").join(detail, ["word", "predicted_pos", "pos_confidence", "best_term"], "left")
    fixed_c, best_c = F.col("fixed"), F.col("best_term")
    return r.select(
        *[c for c in words.columns if c not in ("status", "category")],
        F.when(fixed_c.isNotNull() | best_c.isNotNull(), "corrected").otherwise(F.col("status")).alias("status"),
        F.coalesce("c_category", "category").alias("category"), F.coalesce(fixed_c, best_c).alias("corrected"),
        F.when(fixed_c.isNotNull(), F.lit("unknown")).otherwise(F.col("c_pos")).alias("corrected_pos"),
        F.col("c_rank").alias("corrected_score"), F.coalesce("pair_distance", "distance").alias("distance"),
        "keyboard_distance", "pos_score", "final_score", fixed_c.isNotNull().alias("pair_corrected"))


def split_words(words: DataFrame, best: DataFrame, min_part: int = 2) -> DataFrame:
    """Distinct words cut into two known parts with the largest summed rank."""
    v = best.select("term", "rank")
    cuts = (words.select("word").distinct().where(F.length("word") >= 2 * min_part)
            .select("word", F.explode(F.sequence(F.lit(min_part), F.length("word") - min_part)).alias("i"))
            .select("word", F.substring("word", F.lit(1), F.col("i")).alias("part1"),
                    F.substring("word", F.col("i") + 1, F.length("word")).alias("part2")))
    j = (cuts.join(v.select(F.col("term").alias("part1"), F.col("rank").alias("r1")), "part1")
         .join(v.select(F.col("term").alias("part2"), F.col("rank").alias("r2")), "part2"))
    best_cut = F.min_by(F.struct("part1", "part2", (F.col("r1") + F.col("r2")).alias("score")),
                        F.struct(-(F.col("r1") + F.col("r2")), F.length("part1")))
    return j.groupBy("word").agg(best_cut.alias("b")).select("word", "b.*")


def merge_words(words: DataFrame, best: DataFrame) -> DataFrame:
    """Neighbours that together form a known term, one of them unknown; rows re-numbered."""
    nxt, st = F.lead("word").over(by_pos()), F.lead("status").over(by_pos())
    w = words.withColumns({"word2": nxt, "_st": st})
    may = w.where(F.col("word2").isNotNull() & ((F.col("status") == "unknown") | (F.col("_st") == "unknown")))
    hits = may.withColumn("merged", F.concat("word", "word2")).join(best.select(F.col("term").alias("merged")), "merged", "left_semi")
    kept = greedy_cover(hits.select("query_id", F.lit(2).alias("n"), "pos", "word", "word2", "merged"))
    gone = kept.select("query_id", (F.col("pos") + 1).alias("pos"))
    rows = (words.join(gone, ["query_id", "pos"], "left_anti")
            .join(kept.select("query_id", "pos", "merged"), ["query_id", "pos"], "left"))
    return rows.select("query_id", F.row_number().over(by_pos()).alias("new_pos"), F.coalesce("merged", "word").alias("word"),
                       F.when(F.col("merged").isNotNull(), "merged").otherwise(F.col("status")).alias("status"))


# ---- pass 5 and output ----------------------------------------------------------------

def effective(words: DataFrame) -> DataFrame:
    """Adds ``search_word``: the corrected word where there is one."""
    c = F.coalesce("corrected", "word") if "corrected" in words.columns else F.col("word")
    return words.withColumn("search_word", F.lower(c))


def extract_filters(words: DataFrame, ngrams: DataFrame) -> DataFrame:
    """(query_id, pos, kind, field, value, term): location, keyword, entity filters and the sort.

    N-grams go first; words inside them, stop words and unknown words give nothing.
    """
    single = (effective(words).join(covered(ngrams), ["query_id", "pos"], "left_anti")
              .where((F.col("status") != "unknown") & (F.col("category") != "stopword"))
              .select("query_id", "pos", F.col("search_word").alias("term"), F.lower("category").alias("cat"), F.lit(False).alias("is_ng")))
    ng = ngrams.select("query_id", "pos", F.col("gram").alias("term"), F.lower("category").alias("cat"), F.lit(True).alias("is_ng"))
    t, cat = F.col("term"), F.col("cat")
    sorts = {k: f"{f} {o}" for k, (f, o) in R.TEMPORAL_SORT.items()}
    temporal = ~F.col("is_ng") & t.isin(list(sorts))
    place = X.is_location(cat)
    field = (F.when(temporal, F.split(lookup(sorts, t), " ")[0])
             .when(place, F.when(cat.contains("city"), "location_city").otherwise("location_state"))
             .when(F.col("is_ng") | cat.isin(R.KEYWORD_CATEGORIES), "primary_keywords")
             .when(cat.isin(R.ENTITY_CATEGORIES), "entity_names"))
    kind = F.when(temporal, "sort").when(place, "location").otherwise("filter")
    value = (F.when(temporal, F.split(lookup(sorts, t), " ")[1])
             .when(place, F.array_join(F.array_distinct(F.array_compact(F.array(
                 X.title_case(t), lookup(R.US_STATE_ABBREV, t)))), "|")).otherwise(t))
    return (ng.unionByName(single).select("query_id", "pos", kind.alias("kind"), field.alias("field"), value.alias("value"), "term")
            .where(F.col("field").isNotNull()))


def category_summary(words: DataFrame, ngrams: DataFrame, queries: DataFrame) -> DataFrame:
    """Nine category flags per query; n-grams stand in for the words they cover."""
    single = (words.join(covered(ngrams), ["query_id", "pos"], "left_anti")
              .where((F.col("status") != "unknown") & (F.col("category") != "stopword")).select("query_id", F.lower("category").alias("cat")))
    rows = single.unionByName(ngrams.select("query_id", F.lower("category").alias("cat")))
    agg = rows.groupBy("query_id").agg(*[F.bool_or(F.col("cat").isin(cs)).alias(f) for f, cs in R.SUMMARY_CATEGORIES.items()])
    return queries.select("query_id").join(agg, "query_id", "left").fillna(False, list(R.SUMMARY_CATEGORIES))


def discover(queries: DataFrame, words: DataFrame) -> DataFrame:
    """Per query: corrected text, counts, corrections and score totals.

    A corrected word counts twice in the scores (its own 0 and the corrected
    score), which lowers the mean; kept on purpose.
    """
    w = effective(words)
    ok = F.col("status").isin("valid", "corrected")
    fixed = F.col("status") == "corrected"
    s, cs = F.when(ok, F.col("score")), F.when(fixed, F.coalesce("corrected_score", F.lit(0)))
    corr = F.when(fixed, F.struct("pos", F.col("word").alias("original"), F.col("corrected").alias("corrected"), "predicted_pos",
                                  "corrected_pos", "category", "distance",
                                  F.coalesce(F.col("corrected_pos") == F.col("predicted_pos"), F.lit(False)).alias("pos_match")))
    agg = w.groupBy("query_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "search_word"))), lambda x: x["search_word"]), " ").alias("corrected_query"),
        F.count_if(ok).alias("valid_count"), F.count_if(F.col("status") == "unknown").alias("unknown_count"),
        F.sort_array(F.collect_list(corr)).alias("corrections"),
        (F.coalesce(F.sum(s), F.lit(0)) + F.coalesce(F.sum(cs), F.lit(0))).alias("total_score"),
        (F.count(s) + F.count(cs)).alias("_n"), F.greatest(F.coalesce(F.max(s), F.lit(0)), F.coalesce(F.max(cs), F.lit(0))).alias("max_score"))
    return queries.join(agg, "query_id", "left").withColumn(
        "average_score", F.when(F.col("_n") > 0, F.bround(F.col("total_score") / F.col("_n"), 2)).otherwise(0.0)).drop("_n")


def correction_diff(df: DataFrame) -> DataFrame:
    """(query_id, position, original, corrected, was_changed) of two query texts."""
    def ws(c: str) -> Column:
        return F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != "")
    return (df.select("query_id", F.posexplode(ws("query")).alias("p", "original"), ws("corrected_query").alias("cw"))
            .select("query_id", (F.col("p") + 1).alias("position"), "original",
                    F.coalesce(F.get("cw", F.col("p")), F.col("original")).alias("corrected"))
            .withColumn("was_changed", F.col("original") != F.col("corrected")))


def safe_query(df: DataFrame) -> DataFrame:
    """Keeps the typed query when any correction is unsafe (query, corrected_query, corrections)."""
    unsafe = F.exists("corrections", lambda x: ~x["pos_match"] | x["category"].isin(R.UNSAFE_CATEGORIES))
    changed = F.lower("query") != F.lower("corrected_query")
    return df.withColumns({"has_unsafe": F.coalesce(unsafe, F.lit(False)),
                           "safe_query": F.when(changed & ~F.coalesce(unsafe, F.lit(False)), F.col("corrected_query")).otherwise(F.col("query"))})


def understand(queries: DataFrame, words: DataFrame, vocab: DataFrame, bigrams: DataFrame, trigrams: DataFrame):
    """The five passes: (corrected words, n-grams) of a query log."""
    vocab, bigrams, trigrams = [materialize(d, "vocabulary") for d in (vocab, bigrams, trigrams)]
    valid = predict_pos(V.validate_words(words, V.best_terms(vocab)))
    fixed = materialize(correct_words(valid, vocab, bigrams, trigrams), "corrected")
    ng = detect_ngrams(effective(fixed).drop("word").withColumnRenamed("search_word", "word"), [bigrams, trigrams])
    return fixed, ng
