"""Near words by segments against brute force, also where many words share a long part."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import vocab as V


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def edited(r, w, n):
    for _ in range(n):
        i, c = r.randrange(len(w) + 1), r.choice("abéx")
        w = r.choice([w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:]])
    return w


def words_of(spark, ws, col):
    return spark.createDataFrame([(w,) for w in ws], f"{col} string")


@pytest.mark.parametrize("depth,hot", [(1, 1024), (2, 1024), (1, 1), (2, 1)])
def test_pairs_equal_brute_force(spark, monkeypatch, depth, hot):
    monkeypatch.setattr(V, "HOT_KEY", hot)
    r = random.Random(depth)
    stems = ["".join(r.choice("abé") for _ in range(r.randint(0, 11))) for _ in range(14)]
    terms = sorted({edited(r, r.choice(stems), r.randint(0, 3)) for _ in range(150)})
    words = sorted({edited(r, r.choice(stems), r.randint(0, 3)) for _ in range(60)})
    got = V.near_terms(words_of(spark, words + words[:3], "word"), words_of(spark, terms + terms[:3], "term"), depth).collect()
    want = {(w, t, lev(w, t)) for w in words for t in terms if lev(w, t) <= depth}
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_words_with_a_long_part_in_common_do_not_all_meet(spark):
    r = random.Random(7)
    words = sorted({"commonpartofall_" + "".join(r.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(2000)})
    met = V._met(words_of(spark, words, "word"), words_of(spark, words, "term"), 2)
    assert met.count() < 100 * len(words) and met.distinct().count() < 10 * len(words)  # all pairs: 4,000,000
    assert met.where(F.col("word") == F.col("term")).select("word").distinct().count() == len(words)
