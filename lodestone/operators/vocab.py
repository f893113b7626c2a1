"""Vocabulary tables, lookups, suggestions and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.windows import spread, top_k
from lodestone.rules import language as R
from lodestone.session import materialize

PREFIX_CHARS = 16  # deletion keys are built on this many leading characters


# ---- table building ------------------------------------------------------------

def best_terms(vocab: DataFrame) -> DataFrame:
    """Highest-rank row of each term; equal ranks go to the first category name."""
    others = [c for c in vocab.columns if c not in ("term", "rank", "category")]
    row = F.struct("category", "rank", *others)
    return (vocab.groupBy("term").agg(F.min_by(row, F.struct(-F.col("rank"), F.col("category"))).alias("r"))
            .select("term", "r.*"))


def term_matches(vocab: DataFrame) -> DataFrame:
    """All categories of a term, rank descending."""
    m = F.sort_array(F.collect_set(F.struct((-F.col("rank")).alias("neg"), "category")))
    return vocab.groupBy("term").agg(m.alias("m")).select(
        "term", F.transform("m", lambda x: F.struct(x["category"].alias("category"), (-x["neg"]).alias("rank"))).alias("matches"))


def top_terms(vocab: DataFrame, n: int) -> DataFrame:
    return vocab.orderBy(F.desc("rank"), F.asc("term"), F.asc("category")).limit(n)


def terms_in(vocab: DataFrame, prefix: str, k: int, category: str | None = None, ngram: str | None = None) -> DataFrame:
    """Terms of a category or n-gram class starting with the prefix."""
    v = vocab.where(F.col("term").startswith(prefix.lower().strip()))
    if category:
        v = v.where(F.col("category") == category)
    if ngram:
        v = v.where(X.ngram_type(F.col("term")) == ngram)
    return top_terms(v, k)


def vocab_status(vocab: DataFrame) -> DataFrame:
    """Counts of terms, places, n-grams by size and terms with several categories."""
    kind = X.ngram_type(F.col("term"))
    per = vocab.groupBy("term").agg(F.countDistinct("category").alias("n_cat"),
                                    F.bool_or(X.is_city(F.col("category"))).alias("city"),
                                    F.bool_or(X.is_state(F.col("category"))).alias("state"),
                                    F.bool_or(X.is_location(F.col("category"))).alias("loc"), F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("entries"), F.count("*").alias("terms"), F.count_if("city").alias("cities"),
                   F.count_if("state").alias("states"), F.count_if("loc").alias("locations"),
                   *[F.count_if(kind == k).alias(k + "s") for k in ("unigram", "bigram", "trigram", "quadgram")],
                   F.count_if(F.col("n_cat") > 1).alias("multi_category"))


def vocab_audit(vocab: DataFrame) -> DataFrame:
    """Counts and rank range by category, class and part of speech, with two samples per category."""
    dims = F.array(F.struct(F.lit("category").alias("dim"), F.col("category").alias("value")),
                   F.struct(F.lit("entity_type").alias("dim"), X.ngram_type(F.col("term")).alias("value")),
                   F.struct(F.lit("pos").alias("dim"), F.col("pos").alias("value")),
                   F.struct(F.lit("all").alias("dim"), F.lit("").alias("value")))
    stats = (vocab.select("rank", F.explode(dims).alias("d")).select("rank", "d.*").groupBy("dim", "value")
             .agg(F.count("*").alias("n"), F.min("rank").alias("min_rank"), F.max("rank").alias("max_rank"),
                  F.round(F.avg("rank"), 4).alias("avg_rank")))
    two = top_k(vocab, ["category"], [F.desc("rank"), F.asc("term")], 2)
    samples = two.groupBy(F.lit("category").alias("dim"), F.col("category").alias("value")).agg(
        F.array_join(F.sort_array(F.collect_list("term")), ",").alias("samples"))
    return stats.join(samples, ["dim", "value"], "left")


def schema_audit(df: DataFrame) -> DataFrame:
    """Type, null share and least value of every field, in one aggregate."""
    def fold(f) -> Column:
        c = F.col(f.name)
        return F.struct(F.lit(f.name).alias("field"), F.lit(f.dataType.simpleString()).alias("type"),
                        F.round(F.avg(c.isNull().cast("double")), 6).alias("null_share"),
                        F.min(F.when(c.isNotNull(), F.substring(c.cast("string"), 1, 40))).alias("sample"))
    return df.agg(*[fold(f).alias(f.name) for f in df.schema.fields]).select(
        F.explode(F.array(*[F.col(f.name) for f in df.schema.fields])).alias("a")).select("a.*")


# ---- word lookups ----------------------------------------------------------------

def pos_of_stopword(word: Column) -> Column:
    out = F.lit("unknown")
    for pos, ws in R.POS_WORDS.items():
        out = F.when(word.isin(ws), pos).otherwise(out)
    return out


def with_neighbours(words: DataFrame, n: int = 1, cols: tuple[str, ...] = ("word",)) -> DataFrame:
    """Previous and next values inside the query (a query is one sentence, so windows are small)."""
    w = W.partitionBy("query_id").orderBy("pos")
    out = {}
    for c in cols:
        for i in range(1, n + 1):
            out[f"prev_{c}{i}"], out[f"next_{c}{i}"] = F.lag(c, i).over(w), F.lead(c, i).over(w)
    return words.withColumns(out)


def known_terms(asked: DataFrame, col: str, tables: list[DataFrame]) -> DataFrame:
    """(col): the distinct values of ``asked`` that are a term of one of the tables.

    Each table is asked by itself: one that is bucketed by its term stays where
    it lies, and only what is asked for is shuffled.
    """
    want = asked.select(col).where(F.col(col).isNotNull()).distinct()
    found = None
    for t in tables:
        part = want.join(t.select(F.col("term").alias(col)), col, "left_semi")
        found = part if found is None else found.unionByName(part)
    return found.distinct() if len(tables) > 1 else found


def tag_membership(words: DataFrame, vocab: DataFrame, *grams: DataFrame) -> DataFrame:
    """City, state, place, stop word, bigram and trigram membership of every word; ``grams`` are one or several tables."""
    cat = F.col("category")
    flags = vocab.groupBy(F.col("term").alias("word")).agg(
        F.bool_or(X.is_city(cat)).alias("is_city"), F.bool_or(X.is_state(cat)).alias("is_state"),
        F.bool_or(X.is_location(cat)).alias("is_location"))
    w = with_neighbours(words, 2).select(
        "query_id", "pos", "word",
        F.when(F.col("next_word1").isNotNull(), F.concat_ws(" ", "word", "next_word1")).alias("g2"),
        F.when(F.col("next_word2").isNotNull(), F.concat_ws(" ", "word", "next_word1", "next_word2")).alias("g3"))
    out = w.join(flags, "word", "left")
    for n in ("g2", "g3"):
        out = out.join(known_terms(w, n, list(grams)).withColumn("in_" + n, F.lit(True)), n, "left")
    no = F.lit(False)
    return out.select("query_id", "pos", "word", *[F.coalesce(x, no).alias(x) for x in ("is_city", "is_state", "is_location")],
                      F.col("word").isin(R.STOPWORDS).alias("is_stopword"),
                      F.coalesce("in_g2", no).alias("is_bigram"), F.coalesce("in_g3", no).alias("is_trigram"))


def validate_words(words: DataFrame, best: DataFrame) -> DataFrame:
    """Pass 1: status, part of speech, score and category of every word."""
    v = best.select(F.col("term").alias("word"), F.col("category").alias("v_cat"), F.col("rank").alias("v_rank"),
                    X.normalize_pos(F.col("pos")).alias("v_pos"))
    stop, known = F.col("word").isin(R.STOPWORDS), F.col("v_cat").isNotNull()
    return words.join(v, "word", "left").select(
        *[c for c in words.columns], F.when(known | stop, "valid").otherwise("unknown").alias("status"),
        F.when(known, F.col("v_pos")).when(stop, pos_of_stopword(F.col("word"))).otherwise("unknown").alias("pos_tag"),
        F.coalesce("v_rank", F.lit(0)).alias("score"),
        F.when(known, F.col("v_cat")).when(stop, "stopword").otherwise("").alias("category"))


# ---- fuzzy -----------------------------------------------------------------------

def deletion_keys(df: DataFrame, col: str, depth: int) -> DataFrame:
    """(col, key): hashes of the leading characters with none, one or two removed, for pairs with swaps.

    A word whose letters repeat may give a key twice.

    Two words within that distance share at least one key, so an equi-join on
    keys finds every pair. Positions i < j are exploded and the rest is plain
    substrings, which stays in generated code.
    """
    n = F.length("_p")
    d = spread(df.select(col).distinct(), col).withColumn("_p", F.substring(col, 1, PREFIX_CHARS))
    if depth == 1:
        d = d.withColumn("_i", F.lit(0))
    else:
        d = d.withColumn("_i", F.explode(F.sequence(F.lit(0), n)))
    i, j = F.col("_i"), F.col("_j")
    d = d.withColumn("_j", F.explode(F.when(i == 0, F.sequence(F.lit(0), n)).when(i < n, F.sequence(i + 1, n))))
    head = F.when(i > 0, F.substring("_p", F.lit(1), i - 1)).otherwise("")
    return d.select(col, F.xxhash64(F.concat(head, F.substring("_p", i + 1, j - i - 1), F.substring("_p", j + 1, n))).alias("key"))


#: Terms that share a key before the rest of the word joins it.
HOT_KEY = 1024


def _shifts(depth: int) -> list[tuple[int, int, int, int, int]]:
    """(longer, i, j, p, q): a word longer by ``longer`` than a term may hold segment i moved by p and segment j moved by q.

    The edits before, between and behind the two segments are at least
    ``|p|``, ``|q - p|`` and ``|longer - q|``.
    """
    n, span = depth + 2, range(-depth, depth + 1)
    return [(d, i, j, p, q) for d in span for i in range(n) for j in range(i + 1, n) for p in span for q in span
            if abs(p) + abs(q - p) + abs(d - q) <= depth]


def _segment_rows(df: DataFrame, col: str, depth: int, moved: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """(col, key, rest): keys of two whole segments, and what lies before, between and behind them.

    The segments are those of a term of the length meant: its own for a term
    (all moves 0), the word's less ``longer`` for a word.
    """
    each = F.explode(F.expr("array(" + ", ".join("named_struct('d', {}, 'i', {}, 'j', {}, 'p', {}, 'q', {})".format(*m) for m in moved) + ")"))
    c, size = F.col(col), F.col("_l") - F.col("m.d")
    at = lambda k: F.floor(size * k / (depth + 2)).cast("int")
    d = df.select(col, F.char_length(col).alias("_l"), each.alias("m")).where(size >= 0)
    d = d.select(col, "_l", "m", at(F.col("m.i")).alias("a"), at(F.col("m.i") + 1).alias("b"), at(F.col("m.j")).alias("c"), at(F.col("m.j") + 1).alias("e"))
    d = d.select(col, "_l", "m", *[(F.col(x) + F.col(f"m.{y}")).alias(x) for x, y in (("a", "p"), ("b", "p"), ("c", "q"), ("e", "q"))])
    d = d.where("a >= 0 AND b <= c AND e <= _l")
    part = lambda x, y: F.substring(c, F.col(x) + 1, F.col(y) - F.col(x))
    key = F.xxhash64(F.col("_l") - F.col("m.d"), "m.i", "m.j", part("a", "b"), part("c", "e"))
    rest = F.concat_ws("\0", F.substring(c, F.lit(1), F.col("a")), part("b", "c"), F.substring(c, F.col("e") + 1, F.col("_l")))
    return d.select(col, key.alias("key"), rest.alias("rest"))


def _without(df: DataFrame, col: str, depth: int) -> DataFrame:
    """``df`` with ``cut``: ``col`` without up to ``depth`` (1 or 2) of its characters."""
    n, i, j = F.char_length(col), F.col("_i"), F.col("_j")
    d = df.withColumn("_i", F.explode(F.sequence(F.lit(0), n)) if depth > 1 else F.lit(0))
    d = d.withColumn("_j", F.explode(F.when(i == 0, F.sequence(F.lit(0), n)).when(i < n, F.sequence(i + 1, n))))
    head = F.when(i > 0, F.substring(col, F.lit(1), i - 1)).otherwise("")
    return d.withColumn("cut", F.concat(head, F.substring(col, i + 1, j - i - 1), F.substring(col, j + 1, n))).drop("_i", "_j")


def _met(words: DataFrame, terms: DataFrame, depth: int) -> DataFrame:
    """(word, term): every pair within ``depth`` edits, perhaps several times, among few others.

    A term is cut into depth + 2 segments, so two of them stand whole in a word
    within that distance, at most ``depth`` places away. A term gives a key for
    each two of its segments; a word, of which there are fewer, one for each
    place where they may stand. Where more than ``HOT_KEY`` terms share a key,
    what lies outside its segments must agree up to the edits as well: those
    rows are joined by key and rest without up to ``depth`` characters, so that
    words with a long part in common do not all meet each other.
    """
    w = _segment_rows(spread(words.select("word").distinct(), "word"), "word", depth, _shifts(depth)).distinct()
    t = _segment_rows(spread(terms.select("term").distinct(), "term"), "term", depth, [m for m in _shifts(depth) if (m[0], m[3], m[4]) == (0, 0, 0)])
    t = t.join(w.select("key").distinct(), "key", "left_semi")
    w, t = materialize(w, "word-keys"), materialize(t, "term-keys")
    hot = t.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_KEY).select("key")
    plain = w.join(hot, "key", "left_anti").select("key", "word").join(t.select("key", "term"), "key")
    if hot.isEmpty():
        return plain.select("word", "term")
    wh, th = (_without(d.join(hot, "key", "left_semi"), "rest", depth).withColumn("cut", F.xxhash64("key", "cut")) for d in (w, t))
    return plain.select("word", "term").unionByName(wh.select("cut", "word").distinct().join(th.select("cut", "term").distinct(), "cut").select("word", "term"))


def near_terms(words: DataFrame, terms: DataFrame, depth: int = 2, loose: bool = False) -> DataFrame:
    """(word, term, lev): distinct pairs within ``depth`` plain edits.

    ``loose`` also keeps pairs that only adjacent swaps bring within the
    depth (their plain distance is at most twice as large); a swap may cross
    the bounds of segments, so these are found by deletion keys.
    """
    if loose:
        # a word has 137 keys, so the words' keys outgrow a driver long before the words do: they never become a broadcast
        met = deletion_keys(terms, "term", depth).join(deletion_keys(words, "word", depth).distinct().hint("shuffle_hash"), "key").where(
            F.abs(F.length("word") - F.length("term")) <= depth)
    else:
        met = _met(words, terms, depth)
    lev = F.levenshtein(F.col("word"), F.col("term"), 2 * depth if loose else depth)
    return met.select("word", "term", lev.alias("lev")).where(F.col("lev") >= 0).distinct()


def swap_distance(word: Column, term: Column, lev: Column) -> Column:
    """Distance with swaps for pairs within two plain edits: one swap counts one."""
    one_swap = F.exists(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: F.concat(
        F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1)), F.substring(word, i, F.lit(1)),
        F.substring(word, i + 2, F.length(word))) == term)
    return F.when((lev == 2) & (F.length(word) == F.length(term)) & one_swap, 1).otherwise(lev)


def fuzzy_candidates(words: DataFrame, vocab: DataFrame, max_distance: int = 2, k: int | None = None) -> DataFrame:
    """Terms within one edit of each word, else within two; words of three letters or more."""
    w = words.select("word").distinct().where(F.length("word") >= 3)
    # of several words only the last one varies, so these meet only the terms that begin as they do
    head = lambda c: F.substring_index(c, " ", -1)
    fixed = lambda c: F.substring(c, F.lit(1), F.length(c) - F.length(head(c)))
    phrase, begins = F.col("word").contains(" "), fixed(F.col("word")).alias("_f")
    near = near_terms(w.where(~phrase), vocab, max_distance)
    terms = vocab.where(F.col("term").contains(" ")).select("term", fixed(F.col("term")).alias("_f")).join(w.where(phrase).select(begins).distinct(), "_f", "left_semi")
    terms = materialize(terms.select("term"), "phrase-terms")
    if not terms.isEmpty():
        near = near.unionByName(near_terms(w.where(phrase), terms, max_distance).where(fixed(F.col("word")) == fixed(F.col("term"))))
    tier = F.when(F.col("lev") <= 1, 1).otherwise(2)
    best = F.min(tier).over(W.partitionBy("word"))
    out = (near.withColumn("tier", best).where(tier == F.col("tier"))
           .withColumn("distance", swap_distance(F.col("word"), F.col("term"), F.col("lev")))
           .join(vocab, "term").select("word", "term", "category", "rank", "pos", "distance"))
    if k:
        # the store returns its k highest ranks, which are then ordered by distance
        out = top_k(out, ["word"], [F.desc("rank"), F.asc("term"), F.asc("category")], k)
    return out


# ---- suggestions --------------------------------------------------------------------

def exact_matches(prefixes: DataFrame, vocab: DataFrame) -> DataFrame:
    """All categories of the typed term with their rank order."""
    term = F.lower(X.strip(F.col("prefix")))
    m = prefixes.select("prefix", term.alias("term")).join(vocab, "term")
    return m.withColumn("position", F.row_number().over(
        W.partitionBy("prefix").orderBy(F.desc("rank"), F.asc("category"))))


#: Rows that a stored completion list keeps: three for each of the ten that a page offers.
COMPLETIONS = 30


def completions(vocab: DataFrame, k: int = COMPLETIONS, within: str | None = None) -> DataFrame:
    """([within, ]key, best): the k highest-ranked rows of every prefix, best first; a table to store, bucketed by ``key``.

    Every term offers its prefixes, and each map task keeps k rows of a prefix,
    so a prefix of one letter costs no more than others. ``within`` makes a list
    for each value of that column besides the prefix.
    """
    keys = F.transform(F.sequence(F.lit(1), F.length("term")), lambda i: F.substring(F.col("term"), F.lit(1), i))
    by = [*([within] if within else []), "key"]
    t = vocab.where(F.length("term") > 0).withColumn("key", F.explode(keys))
    best = top_k(t, by, [F.desc("rank"), F.asc("term"), F.asc("category")], k, rank="_at")
    row = F.struct("_at", *vocab.columns)
    return best.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("best"))


def prefix_matches(prefixes: DataFrame, vocab: DataFrame, k: int, lists: DataFrame | None = None) -> DataFrame:
    """The k highest-ranked terms starting with each prefix.

    ``lists`` are the stored ``completions`` of ``vocab``, of at least k rows
    each: one equality join. Without them every term offers its own prefixes;
    only typed ones survive the semi-join and each keeps k rows before the
    final join.
    """
    asked = prefixes.select("prefix").distinct().select("prefix", F.lower(X.strip(F.col("prefix"))).alias("key")).where(F.col("key") != "")
    if lists is not None:
        met = asked.join(lists, "key").select("prefix", F.explode(F.slice("best", 1, k)).alias("t"))
        return met.select("prefix", *[F.col(f"t.{c}").alias(c) for c in vocab.columns])
    keys = F.transform(F.sequence(F.lit(1), F.length("term")), lambda i: F.substring(F.col("term"), F.lit(1), i))
    t = vocab.where(F.length("term") > 0).withColumn("key", F.explode(keys))
    t = t.join(asked.select("key").distinct(), "key", "left_semi")
    best = top_k(t, ["key"], [F.desc("rank"), F.asc("term"), F.asc("category")], k)
    return asked.join(best, "key").drop("key")


def suggest(prefixes: DataFrame, vocab: DataFrame, k: int, fuzzy: bool = True, max_distance: int = 2, lists: DataFrame | None = None) -> DataFrame:
    """Exact, then prefix, then (only when short) fuzzy terms of each typed text; ``lists`` as in ``prefix_matches``.

    One row per suggested term, best rank first; ``tiers`` names the tiers used.
    """
    asked = prefixes.select("prefix").distinct()
    cols = ["prefix", "term", "category", "rank", "pos", "distance", "tier"]
    ex = exact_matches(asked, vocab).withColumns({"distance": F.lit(0), "tier": F.lit(1)}).select(cols)
    size = F.length("term") - F.length(X.strip(F.col("prefix")))
    pre = prefix_matches(asked, vocab, 3 * k, lists).withColumns({"distance": size, "tier": F.lit(2)}).select(cols)

    def one_per_term(df: DataFrame) -> DataFrame:
        row = F.struct("category", "rank", "pos", "distance", "tier")
        return (df.groupBy("prefix", "term").agg(F.min_by(row, F.struct("tier", -F.col("rank"), "category")).alias("r"))
                .select("prefix", "term", "r.*"))

    found = one_per_term(ex.unionByName(pre))
    if fuzzy:
        short = (asked.join(found.groupBy("prefix").agg(F.count("*").alias("n")), "prefix", "left")
                 .where(F.coalesce("n", F.lit(0)) < k)
                 .select("prefix", F.lower(X.strip(F.col("prefix"))).alias("word")))
        fz = (short.join(fuzzy_candidates(short, vocab, max_distance, 2 * k), "word")
              .where(F.col("distance") <= max_distance).withColumn("tier", F.lit(3)).select(cols))
        found = one_per_term(found.unionByName(fz))
    names = F.create_map(F.lit(1), F.lit("exact"), F.lit(2), F.lit("prefix"), F.lit(3), F.lit("fuzzy"))
    # at most 1 + 3k + 2k rows per typed text, so these windows are small
    used = F.array_join(F.transform(F.sort_array(F.collect_set("tier").over(W.partitionBy("prefix"))), lambda x: names[x]), "+")
    top = top_k(found.withColumn("tiers", used), ["prefix"], [F.desc("rank"), F.asc("distance"), F.asc("term")], k, rank="position")
    bonus = F.least("rank", F.lit(R.MAX_RANK)) / R.MAX_RANK
    return top.withColumn("match_score", F.when(F.col("tier") == 1, -F.col("rank").cast("double"))
                                               .otherwise(F.col("distance") - bonus))


def question_matches(prefixes: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Questions holding every typed word, the last one as a prefix; best score first."""
    asked = (prefixes.select("prefix").distinct()
             .select("prefix", F.filter(F.split(F.lower(X.strip(F.col("prefix"))), r"\s+"), lambda w: w != "").alias("ws"))
             .where((F.size("ws") > 0) & (F.length(X.strip(F.col("prefix"))) >= 2)))
    toks = questions.select("question_key", F.explode(F.array_distinct(F.filter(X.raw_tokens(F.col("question")), lambda t: t != ""))).alias("tok"))
    full = asked.select("prefix", F.explode(F.array_distinct(F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0))))).alias("tok"))
    last = asked.select("prefix", F.element_at("ws", -1).alias("key"))
    heads = F.transform(F.sequence(F.lit(1), F.length("tok")), lambda i: F.substring(F.col("tok"), F.lit(1), i))
    keyed = toks.select("question_key", F.explode(heads).alias("key")).join(last.select("key").distinct(), "key", "left_semi").distinct()
    hit_last = last.join(keyed, "key").select("prefix", "question_key").distinct()
    need = asked.select("prefix", (F.size(F.array_distinct(F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0)))))).alias("need"))
    # the last word is asked first: a question word in front stands in many questions
    got = hit_last.join(full, "prefix").join(toks, ["question_key", "tok"]).groupBy("prefix", "question_key").agg(F.count("*").alias("got"))
    ok = (hit_last.join(need, "prefix").join(got, ["prefix", "question_key"], "left")
          .where(F.coalesce("got", F.lit(0)) == F.col("need")).select("prefix", "question_key"))
    full_rows = ok.join(questions, "question_key")
    return top_k(full_rows, ["prefix"], [F.desc("question_score"), F.asc("question_key")], k, rank="position")


def autocomplete(prefixes: DataFrame, vocab: DataFrame, questions: DataFrame, k: int = 10, fuzzy: bool = True, lists: DataFrame | None = None) -> DataFrame:
    """Terms first; a question start reserves three slots for questions."""
    p = prefixes.select("prefix").distinct().where(F.length(X.strip(F.col("prefix"))) >= 2)
    asks = F.split(F.lower(X.strip(F.col("prefix"))), r"\s+")[0].isin(R.INTERROGATIVES)
    terms = suggest(p, vocab, k, fuzzy, lists=lists).where(F.when(asks, F.col("position") <= k - 3).otherwise(True))
    qs = question_matches(p.where(asks), questions, 3)
    return (terms.select("prefix", F.lit("term").alias("kind"), F.col("term").alias("text"), "rank", "position")
            .unionByName(qs.select("prefix", F.lit("question").alias("kind"), F.col("question").alias("text"),
                                   F.col("question_score").alias("rank"), (F.col("position") + k).alias("position"))))


def check_words(words: DataFrame, vocab: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """Each distinct word: valid, or its best suggestion with distance, score and tiers."""
    w = words.select("word").distinct()
    known = w.join(vocab.select(F.col("term").alias("word")).distinct(), "word", "left_semi")
    miss = w.join(known, "word", "left_anti").withColumnRenamed("word", "prefix")
    s = suggest(miss, vocab, 1, lists=lists).select("prefix", F.col("term").alias("suggestion"), "distance", "match_score", "tiers")
    bad = miss.join(s, "prefix", "left").select(F.col("prefix").alias("word"), F.lit(False).alias("is_valid"),
                                                "suggestion", "distance", "match_score", "tiers")
    none = F.lit(None)
    return known.select("word", F.lit(True).alias("is_valid"), none.cast("string").alias("suggestion"),
                        none.cast("int").alias("distance"), none.cast("double").alias("match_score"),
                        none.cast("string").alias("tiers")).unionByName(bad)


def typo_candidates(words: DataFrame, vocab: DataFrame, full: bool = True, cap: int | None = None) -> DataFrame:
    """Known terms reached from a word by common typing slips.

    ``full`` = neighbour keys, swaps, deletions, vowel changes and insertions;
    without it swaps and deletions. With ``cap`` at most so many forms of a
    word are looked up, and insertions only if the others fill less than half.
    """
    w, n = F.col("word"), F.length("word")
    at = F.sequence(F.lit(1), n)

    def put(i, mid, skip):
        return F.concat(F.substring(w, F.lit(1), i - 1), mid, F.substring(w, i + skip, n))

    swaps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: put(
        i, F.concat(F.substring(w, i + 1, F.lit(1)), F.substring(w, i, F.lit(1))), 2))
    drops = F.transform(at, lambda i: put(i, F.lit(""), 1))
    made = F.concat(swaps, drops)
    if full:
        near = F.create_map(*[F.lit(x) for k, v in R.TYPO_NEIGHBOURS.items() for x in (k, v)])
        vowels = F.create_map(*[F.lit(x) for v in "aeiou" for x in (v, "aeiou".replace(v, ""))])

        def replaced(table):
            def per(i):
                chars = F.split(F.coalesce(F.try_element_at(table, F.substring(w, i, F.lit(1))), F.lit("")), "")
                return F.transform(F.filter(chars, lambda c: c != ""), lambda c: put(i, c, 1))
            return F.flatten(F.transform(at, per))
        made = F.array_distinct(F.concat(replaced(near), swaps, drops, replaced(vowels)))
        letters = F.array(*[F.lit(chr(97 + i)) for i in range(26)])
        inserts = F.flatten(F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.transform(letters, lambda c: put(i, c, 0))))
        every = F.array_distinct(F.concat(made, inserts))
        made = every if cap is None else F.when(F.size(made) < cap // 2, F.slice(every, 1, cap)).otherwise(F.slice(made, 1, cap))
    cand = words.select("word").distinct().where(n >= 2).select("word", F.explode(F.array_distinct(made)).alias("candidate"))
    return cand.where(F.col("candidate") != "").join(
        vocab.select(F.col("term").alias("candidate")).distinct(), "candidate", "left_semi").select("word", "candidate")
