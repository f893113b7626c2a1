"""What language identification learns from, and what the pipeline keeps without it."""

from collections import Counter

import corpus_pipeline as P
from lodestone.llm import language as L


def test_copies_do_not_thin_out_the_training_texts(spark, monkeypatch):
    monkeypatch.setattr(L, "fit", lambda x, labels: Counter(labels))
    rows = [(f"wort{k} text{k * k}", "de") for k in range(400)] + [(f"word{k} line{k * k}", "en") for k in range(400)]
    rows += [("the same text", "en")] * 20000 + [(str(k), "de") for k in range(20000)]  # copies, and texts without a letter
    docs = spark.createDataFrame([(k, t, v) for k, (t, v) in enumerate(rows)], "doc_id long, text string, lang string")
    assert L.train(docs, rows=200) == {"de": 100, "en": 100}
    assert L.train(docs, rows=2) == {"de": 1, "en": 1}


def test_without_a_model_documents_with_letters_stay(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "été", None)], "doc_id long, text string, lang string")
    got = P.identify_language(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in got) == [(1, "some words", "und"), (4, "été", "und")]
