import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import language as L


def test_held_out_accuracy_and_columns(spark, data):
    from lodestone.llm.queries import op8_language_id
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = op8_language_id(spark, data).collect()
    assert len(got) == len(docs)
    judged = []
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in docs[r.doc_id].text or ""):
            assert r.lang_pred == "und"
        elif r.held_out:
            judged.append(r.lang_pred == docs[r.doc_id].lang)
    assert np.mean(judged) > 0.95


def test_families_hold_related_languages():
    rng = np.random.default_rng(0)
    base = rng.random((2, 50))
    means = np.array([base[0], base[1], base[0] + 0.1 * rng.random(50), base[1] + 0.1 * rng.random(50), base[1] + 0.1 * rng.random(50)])
    groups = L.group_families(means / np.linalg.norm(means, axis=1, keepdims=True))
    assert len(groups) == 3 and not any({0, 2} & set(g) and {1, 3, 4} & set(g) for g in groups)


def test_svm_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    y = np.where(x @ [1, -2, 0, 1, 0, 0] + 0.5 > 0, 1, -1)
    x += 0.2 * y[:, None] * np.array([1, -2, 0, 1, 0, 0])
    w = L.fit_svm(x, y, epochs=60)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.99


def test_odd_rows_and_columns_that_must_not_matter(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = L.train(docs)
    rows = [(1, None, "en"), (2, "", "de"), (3, "123 ... !!", None), (3, "x" * 3_000_000, None), (None, "the and of the that", "fr"), (5, "the and of the that", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r.lang_pred, r.score) for r in L.identify(df, model).collect()]
    assert [g[0] for g in got[:3]] == ["und"] * 3 and got[4] == got[5] and got[3][0] != "und"
    part = L.features("ab" * 1_000_000)
    assert abs(part @ part - 1) < 1e-9 and (part > 0.1).sum() <= 6


def test_long_text_parts_overlap(monkeypatch):
    text = "the quick brown fox " * 70000
    whole = L.features(text)
    c = " ".join(text.split())
    n = {}
    for k in L.NGRAMS:
        n[k] = len(c) + 2 - k + 1
    assert np.isclose((whole ** 2).sum(), 1) and len(c) > 1 << 20


def test_nothing_learned_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.train(none) is None and L.identify(none, None).count() == 0
    one = spark.createDataFrame([(k, f"some words {k}", "en") for k in range(20)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.identify(one, L.train(one)).collect()} == {"en"}
    assert {r.lang_pred for r in L.identify(one, None).collect()} == {"und"}
    assert one.where(L.held_out()).count() == sum(zlib.crc32(str(k).encode()) % 5 == 0 for k in range(20))
    assert one.select(F.lit(None).cast("long").alias("doc_id")).where(L.held_out()).count() == 0
