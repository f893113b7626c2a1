"""Ranked lexical search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from lodestone.llm import lexical as X


def found(text):
    return re.findall(X.TERM, "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k):
    terms = [(i, Counter(found(t))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n, length = len(terms), sum(c.total() for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c in terms:
            m = 50 + 50 * c.total() * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(found(text)) if t in c)
            if s > 0:
                rows.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(rows, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def case(seed, docs=150, items=9):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "éxyz0"] + ["THE", "of", "日本", "ßA"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", ", ", "\n", "\x00", "-"]) for _ in range(n))
    d = [(k, text(r.choice([1, 3, 10, 60, 300]))) for k in range(docs)]
    d += [(k + 1000, d[k % 7][1]) for k in range(60)] + [(5, d[5][1]), (None, d[6][1]), (None, None), (2000, None), (2001, ""), (2002, " .,-")]
    r.shuffle(d)
    q = [(k, text(r.choice([1, 4, 30, 200]))) for k in range(items)] + [(3, "the of"), (3, "the of"), (None, "the ax"), (50, None), (51, " - "), (52, "nowhere")]
    return d, q


def run(spark, d, q, k):
    docs = spark.createDataFrame(d, "doc_id long, text string").selectExpr("*", "1 AS term", "2 AS n", "3 AS tf", "'x' AS item_id").repartition(5)
    items = spark.createDataFrame(q, "item_id long, text string").selectExpr("*", "'y' AS terms", "1 AS doc_id")
    return sorted((tuple(x) for x in X.search(docs, items, k).collect()), key=str)


def test_equals_brute_force(spark):
    d, q = case(1)
    assert run(spark, d, q, 50) == brute(d, q, 50)
    assert run(spark, d, q, 3) == brute(d, q, 3)


def test_blocks_of_documents_and_passes_of_items_change_nothing(spark, monkeypatch):
    d, q = case(2)
    monkeypatch.setattr(X, "PASS_ITEMS", 4)
    assert run(spark, d, q, 7) == brute(d, q, 7)


def table(rows):
    flat = lambda f: pa.array([[f(x) for x in r[2]] for r in rows], pa.list_(pa.int32() if f is key else pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), flat(key), flat(value)], ["doc_id", "m", "term", "tf"])


def key(x):
    return x[0]


def value(x):
    return x[1]


def test_block_finds_the_best_and_leaves_hopeless_groups(monkeypatch):
    monkeypatch.setattr(X, "STEP", 4)
    r = np.random.default_rng(3)
    weight = np.concatenate([r.integers(0, 40, 80), [9000] * 20])
    rows = [(int(k), int(r.integers(50, 400)), [(int(t), int(r.integers(1, 9))) for t in np.flatnonzero(r.random(100) < (0.5 * (np.arange(100) < 80) + 0.02))] or [(0, 1)]) for k in r.permutation(600)]
    item = np.arange(0, 100)
    best, asked, seen = X.Best(10), np.zeros(100, bool), 0
    for at in range(0, 600, 200):
        seen += X.Block(table(rows[at:at + 200]), weight).search(item, asked, best)
    score = lambda x: sum(int(weight[t]) * ((10**9 * c) // (1000 * c + 20 * x[1])) for t, c in x[2])
    want = sorted(((-score(x), x[0]) for x in rows if score(x) > 0))[:10]
    assert list(zip((-best.score).tolist(), best.id.tolist())) == want
    assert not asked.any() and seen < 300


def test_empty_tables_and_long_texts(spark, monkeypatch):
    assert run(spark, [], [(1, "a")], 5) == []
    assert run(spark, [(1, "a")], [], 5) == []
    assert run(spark, [(1, None)], [(1, None)], 5) == []
    d = [(1, "Word " * 400_000 + "needle"), (2, "needle"), (3, "hay"), (4, "w" * 500_000)]
    assert run(spark, d, [(1, "needle word"), (2, "w" * 500_000)], 5) == brute(d, [(1, "needle word"), (2, "w" * 500_000)], 5)
