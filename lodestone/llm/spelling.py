"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

A word is cut into two disjoint chunks. One edit touches one of them, so the
other stands whole in the near word, at its own place or shifted by one. The
shorter word of a pair gives its chunks, the longer one the grams that stand
where such a chunk may lie; an equality join of the two brings the pair
together, and the rest of the two words decides.

Half a word is a frequent key where words are built of few syllables (1.2
billion pairs for 1.1 million words of the 0.5 GB table). So the rule is used
once more on the half that holds the edit: one of its two chunks is whole as
well. A key is thus everything outside one quarter of the word, and two words
of a key differ inside that quarter only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import discard, stored
from lodestone.operators.windows import spread

#: Letters of a run; upper case is lowered in A-Z only.
RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
#: One run in so many loses a letter.
SLIP = 31


def slipped(doc_id: Column, run: Column) -> Column:
    """The run as its document writes it: where the checksum of ``<doc_id>:<run>`` is a multiple of 31, one letter is gone."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + F.lit(2), F.char_length(run)))
    return F.when(h % F.lit(SLIP) == 0, cut).otherwise(run)


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of at least ``min_chars`` letters that occur at least ``min_count`` times in all texts.

    Runs shorter than that can't become such a word and are not taken out of
    the text. Null and empty texts have no words; a null id counts as an empty
    one; every row of ``docs`` counts, repeated ones too.
    """
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"{RUN}{{{min_chars},}}"), F.lit(0))
    each = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    return (each.select(slipped(F.col("id"), F.col("run")).alias("word")).where(F.char_length("word") >= min_chars)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def _bounds(length: Column) -> list[Column]:
    """Where the four quarters of a word begin, and its end: the two chunks, each cut in two."""
    half = F.floor(length / 2).cast("int")
    return [F.lit(0), F.floor(half / 2).cast("int"), half, half + F.floor((length - half) / 2).cast("int"), length]


def _keys(table: DataFrame, longer_by: tuple[int, ...]) -> DataFrame:
    """(chars, quarter, head, tail, longer, middle, n): what a word gives to the join.

    ``chars`` is the length of the word whose chunks are meant; a word that is
    longer by one gives the grams in the places of such chunks, those behind
    the quarter shifted by one.
    """
    word, rows = F.col("word"), []
    for d in longer_by:
        chars = F.char_length(word) - F.lit(d)
        b = _bounds(chars)
        for q in range(4):
            end = b[q + 1] + F.lit(d)
            rows.append(F.struct(
                chars.alias("chars"), F.lit(q).alias("quarter"), F.substring(word, F.lit(1), b[q]).alias("head"),
                F.substring(word, end + F.lit(1), F.char_length(word)).alias("tail"), F.lit(d).alias("longer"),
                F.substring(word, b[q] + F.lit(1), end - b[q]).alias("middle")))
    return table.select(F.explode(F.array(*rows)).alias("k"), "n").select("k.*", "n")


def near_pairs(table: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of words exactly one inserted, deleted or replaced code point apart, once.

    ``table`` is (word, n) with distinct words; null and empty words are near
    to nothing. A pair of equal length meets in one quarter only. An insertion
    into a row of equal letters may fit several quarters: the one where the
    words first differ counts, or the last one where the shorter word is a
    prefix. Both sides are shuffled by the key, which adaptive execution may
    split. A word makes twelve keys, so words are dealt out before.
    """
    table = spread(table.where(F.char_length("word") > 0), "word")
    key = ["chars", "quarter", "head", "tail"]
    a = _keys(table, (0,)).select(*key, F.col("middle").alias("am"), F.col("n").alias("an"))
    b = _keys(table, (0, 1)).select(*key, "longer", F.col("middle").alias("bm"), F.col("n").alias("bn"))
    first = (F.col("longer") == 0) & (F.col("am") < F.col("bm")) | (F.col("longer") == 1) & ((F.col("quarter") == 3) | ~F.col("bm").startswith(F.col("am")))
    near = a.join(b, key).where(first & (F.levenshtein("am", "bm", 1) == 1))
    whole = lambda m: F.concat("head", m, "tail")
    return near.select(whole("am").alias("word"), F.col("an").alias("n"), whole("bm").alias("other"), F.col("bn").alias("other_n"))


def forms(table: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest count, the smallest of equals, if it has ``ratio`` times the word's own.

    Near words are counted and the largest kept inside each map task first, so
    a word near to very many others is no burden.
    """
    pair = near_pairs(table)
    ways = F.array(F.struct("word", F.col("other").alias("by"), F.col("other_n").alias("by_n")), F.struct(F.col("other").alias("word"), F.col("word").alias("by"), F.col("n").alias("by_n")))
    best = (pair.select(F.explode(ways).alias("w")).select("w.*").groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("by_n")).alias("neg"), "by")).alias("best")))
    out = table.join(best, "word", "left")
    chosen = -F.col("best.neg") >= F.lit(ratio) * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(chosen, F.col("best.by")).alias("form"),
                      F.when(chosen, -F.col("best.neg")).cast("long").alias("form_n"))


def roots(table: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``table`` of (word, n, form, ...) with ``root``: where following the forms ends; the word itself if it has none.

    Counts grow by ``ratio`` on every step, which bounds the length of a chain
    by the logarithm of the largest count; every round doubles the steps taken.
    """
    most = table.agg(F.max("form_n")).first()[0]
    steps = math.floor(math.log(max(most or 1, 1), ratio)) + 1 if most else 0
    link = stored(table.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-links")
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = link.select(F.col("word").alias("root"), F.col("root").alias("on"))
        longer = stored(link.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root")), "spelling-links")
        discard(link)
        link = longer
    return table.join(link, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the documents; an empty table has none."""
    table = stored(words(docs, id_col, text_col, min_chars, min_count), "spelling-words")
    judged = stored(forms(table, ratio), "spelling-forms")
    discard(table)
    return roots(judged, ratio).select("word", "form", "root", "n", "n_near", "form_n")


#: Finds near words by what is left without one letter: of two words at the same place, or of one word the other.
SQL = r"""
WITH RECURSIVE t0 AS (SELECT range AS b, range::BIGINT AS c FROM range(256)),
t1 AS (SELECT b, list_reduce([c] || range(8)::BIGINT[], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM t0),
crc AS (SELECT list(c ORDER BY b) AS tab FROM t1),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
per AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hexed AS (SELECT run, n, hex(encode(concat(doc_id, ':', run))) AS x FROM per),
bytes AS (SELECT run, n, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT) AS bs FROM hexed),
hashed AS (SELECT run, n, xor(list_reduce([4294967295::BIGINT] || bs, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
keys AS (SELECT word, n, i, substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT) AS k FROM cuts),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM keys a JOIN keys b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, k.word, k.n FROM words w JOIN keys k ON k.k = w.word UNION SELECT k.word, w.word, w.n FROM words w JOIN keys k ON k.k = w.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 10 * w.n THEN (SELECT min(x.other) FROM near x WHERE x.word = w.word AND x.other_n = b.top) END AS form,
  CASE WHEN b.top >= 10 * w.n THEN b.top END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
walk AS (SELECT word, word AS stop, 0 AS step FROM forms UNION ALL SELECT k.word, f.form, k.step + 1 FROM walk k JOIN forms f ON f.word = k.stop WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(stop, step) AS root FROM walk GROUP BY word)
SELECT f.word, f.form, e.root, f.n::BIGINT AS n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM forms f JOIN ends e ON e.word = f.word
"""
