"""Phrase tables are counted in one shuffle and joined where they lie."""

import re
from collections import Counter, defaultdict

import pytest

from lodestone.catalog import section_c3
from lodestone.operators import understand as U
from lodestone.operators import vocab as V
from lodestone.sources import mapping as M
from lodestone.sources.tables import Tables

DOCS = [(1, "Red river valley red river", "en"), (2, "red river delta", "fr"), (3, "river valley", None), (4, "river valley", "en"), (5, None, "de"), (6, "solo", "de"), (7, "erste red river", None)]


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame([(i, t, la, "s", len(t or "")) for i, t, la in DOCS], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    return Tables(spark, str(tmp_path))


def _shuffles(df):
    df.collect()  # the plan that ran
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning\((?:term|lang)", plan.split("== Initial Plan ==")[0]))


def _expected(n, least):
    seen = defaultdict(Counter)
    for _, text, lang in DOCS:
        w = (text or "").lower().split()
        for i in range(len(w) - n + 1):
            seen[" ".join(w[i:i + n])][lang] += 1
    first = lambda c: min(c, key=lambda k: (-c[k], k is not None, k or ""))
    return {(g, first(c), sum(c.values()), "noun") for g, c in seen.items() if sum(c.values()) >= least}


@pytest.mark.parametrize("n,least", [(2, 1), (2, 2), (3, 1)])
@pytest.mark.parametrize("languages", [64, 1])
def test_ngrams_by_language(tables, monkeypatch, n, least, languages):
    monkeypatch.setattr(M, "LANGUAGES", languages)
    assert {tuple(r) for r in M.count_ngrams(tables, n, least).collect()} == _expected(n, least)
    some = M.count_ngrams(tables, n, least, prefix="red").collect()
    assert {tuple(r) for r in some} == {x for x in _expected(n, least) if x[0].startswith("red")}


def test_ngrams_are_shuffled_once(tables):
    assert _shuffles(M.count_ngrams(tables, 2)) == 1


def test_stored_tables_of_phrases_stay_where_they_lie(spark, tables):
    two, three = M.ngrams(tables, 2), M.ngrams(tables, 3)
    words = spark.createDataFrame([("q", i + 1, w) for i, w in enumerate("old red river valley".split())], "query_id string, pos int, word string")
    tags = V.tag_membership(words, spark.createDataFrame([], "term string, category string"), two, three)
    got = {r.word: (r.is_bigram, r.is_trigram) for r in tags.collect()}
    assert got == {"old": (False, False), "red": (True, True), "river": (True, False), "valley": (False, False)}
    bonus = U.context_bonus(V.with_neighbours(words), [two, three], "prev_word1", "word", "next_word1")
    assert {r.word: (r.bigram_bonus, r.trigram_bonus) for r in bonus.collect()} == {"old": (0, 0), "red": (120, 0), "river": (240, 150), "valley": (120, 0)}
    assert [r.gram for r in U.detect_ngrams(words, [two, three]).collect()] == ["red river valley"]
    known = V.known_terms(spark.createDataFrame([("red river",), ("a b",)], "g string").hint("merge"), "g", [two.hint("merge"), three.hint("merge")])
    assert [r.g for r in known.collect()] == ["red river"]
    plan = known._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    for side in plan.split("FileScan")[1:]:
        assert "ngrams" in side and "Bucketed: true" in side


def test_a_profile_without_phrases_builds_no_table(tables, monkeypatch):
    monkeypatch.setattr(M, "built", lambda *a, **k: pytest.fail("a table was built"))
    assert section_c3._no_ngrams(tables).columns == ["query_id", "n", "pos", "gram", "category", "rank"]
    assert section_c3._no_ngrams(tables).count() == 0
