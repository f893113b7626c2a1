"""Typed texts of several words: only terms that begin as they do are compared with them, and the last word is asked first."""

from pyspark.sql import functions as F

from lodestone.operators import vocab as V


def _vocab(spark, terms):
    return spark.createDataFrame([(t, "en", 5) for t in terms], "term string, category string, rank int").withColumn("pos", F.lit("noun"))


def test_phrases_meet_no_single_terms(spark, monkeypatch):
    met = []

    def near(words, terms, depth=2, loose=False):
        met.append((sorted(r.word for r in words.select("word").collect()), sorted({r.term for r in terms.select("term").collect()})))
        return real(words, terms, depth, loose)

    real = V.near_terms
    monkeypatch.setattr(V, "near_terms", near)
    words = spark.createDataFrame([("is house",), ("hous",), ("new yorc",)], "word string")
    got = V.fuzzy_candidates(words, _vocab(spark, ["house", "mouse", "new york", "nem york", "old york"]))
    assert sorted((r.word, r.term) for r in got.collect()) == [("hous", "house"), ("new yorc", "new york")]
    assert met == [(["hous"], ["house", "mouse", "nem york", "new york", "old york"]), (["is house", "new yorc"], ["new york"])]
    met.clear()
    got = V.fuzzy_candidates(words, _vocab(spark, ["house", "mouse"]))
    assert sorted((r.word, r.term, r.distance) for r in got.collect()) == [("hous", "house", 1)] and len(met) == 1


def test_question_words_are_asked_of_few_questions(spark):
    qs = spark.createDataFrame([(1, "is the house old", 3), (2, "is house house big", 9), (3, "the house", 5), (4, "is a home near", 2)],
                               "question_key int, question string, question_score int")
    p = spark.createDataFrame([("is hou",), ("is the ho",), ("is is ho",), ("is zebra",), ("house",)], "prefix string")
    found = V.question_matches(p, qs, 5)
    assert sorted((r.prefix, r.question_key, r.position) for r in found.collect()) == [
        ("house", 1, 3), ("house", 2, 1), ("house", 3, 2), ("is hou", 1, 2), ("is hou", 2, 1), ("is is ho", 1, 2), ("is is ho", 2, 1), ("is is ho", 4, 3), ("is the ho", 1, 1)]
