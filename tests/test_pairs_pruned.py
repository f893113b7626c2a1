"""Pairs of unknown words: the closest bigram, as if every bigram were tried; few distances are computed."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.functions import distance as D
from lodestone.operators import understand as U


def words_of(seed, n, low, high):
    r = random.Random(seed)
    return ["".join(r.choice("abcdeé") for _ in range(r.randint(low, high))) for _ in range(n)]


def typed(r, word):
    for _ in range(r.randint(0, 3)):
        at = r.randint(0, len(word))
        word = r.choice([word[:at] + r.choice("abcé") + word[at:], word[:at] + word[at + 1:], word[:at] + word[at + 1:at + 2] + word[at:at + 1] + word[at + 2:]]) or "a"
    return word


def osa(pairs):
    a, b = zip(*pairs)
    return D.batch_distance(pd.Series(a), pd.Series(b)).astype(int)


@pytest.mark.parametrize("low, high", [(1, 4), (4, 9)])
def test_pairs_equal_brute_force(spark, low, high):
    parts = words_of(1, 120, low, high)
    r = random.Random(2)
    terms = sorted({f"{r.choice(parts)} {r.choice(parts)}" for _ in range(400)})
    log = [(f"q{k}", p + 1, typed(r, w), "unknown") for k in range(60) for p, w in enumerate(r.choice(terms).split(" "))]
    words = spark.createDataFrame(log, "query_id string, pos int, word string, status string")
    bigrams = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {(x.query_id, x.term, x.dist) for x in U.correct_pairs(words, bigrams).collect()}
    want = set()
    for k in range(60):
        a, b = log[2 * k][2], log[2 * k + 1][2]
        one, two = osa([(a, t.split(" ")[0]) for t in terms]), osa([(b, t.split(" ")[1]) for t in terms])
        # one word within one edit, or both within two
        hits = [(x + y, t) for x, y, t in zip(one, two, terms) if x + y <= 4 and (min(x, y) <= 1 or max(x, y) <= 2)]
        if hits:
            want.add((f"q{k}", min(hits)[1], min(hits)[0]))
    assert got == want and len(want) > 20


def test_letters_bound_the_distance(spark):
    pool = words_of(5, 60, 1, 12)
    pairs = [(a, b) for a in pool for b in pool]
    d = spark.createDataFrame([(a, b, int(n)) for (a, b), n in zip(pairs, osa(pairs))], "a string, b string, d int")
    lost = F.bit_count(U.letters(F.col("a")).bitwiseAND(F.bitwise_not(U.letters(F.col("b")))))
    assert d.where(lost > F.col("d")).count() == 0 and d.where(lost > 2).count() > 0


def test_pairs_with_a_near_hit_meet_no_other_bigram(spark, monkeypatch):
    """A frequent first word has many bigrams; a pair that one of them serves within two edits computes no distance to the others."""
    asked, plain = [], U.materialize
    monkeypatch.setattr(U, "materialize", lambda df, label: asked.append((label, kept.count())) or kept if (kept := plain(df, label)) is not None else None)
    words = spark.createDataFrame([("q", 1, "xderx", "unknown"), ("q", 2, "hauz", "unknown")], "query_id string, pos int, word string, status string")
    bigrams = spark.createDataFrame([("derx haus",), *[(f"derx {w}",) for w in words_of(9, 300, 3, 5)]], "term string")
    assert [(x.term, x.dist) for x in U.correct_pairs(words, bigrams).collect()] == [("derx haus", 2)]
    assert [n for label, n in asked if label == "pair-open"] == [0, 0]
