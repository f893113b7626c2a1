import re

import pytest
from hypothesis import given, settings, strategies as st

from lodestone.llm import quality as Q

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    w, lines, seen, dup = W.findall(t), t.split("\n"), set(), 0
    for x in lines:
        if W.search(x):
            dup += x in seen
            seen.add(x)
    wins = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
    hit = {p for k, x in enumerate(wins) if wins.count(x) > 1 for p in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n\t\x0b\x1c#|é", max_size=120))
def test_features(text):
    f = Q.Features(text)
    assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words) == brute(text)


def test_rows(spark):
    clean = " ".join(f"word{k} goes on" for k in range(40)) + "."
    rows = [(1, clean), (2, None), (3, ""), (4, "und " * 300), (5, clean.upper()), (6, " | ".join(clean.split())), (7, clean.replace(" ", "!! ")), (8, "x" * 100000), (None, clean), (1, clean), (9, "few words"), (10, "".join(f"w{k} " * 7 for k in range(40)))]
    df = spark.createDataFrame([(i, t, "a", 3) for i, t in rows], "doc_id long, text string, kept string, n_words int")
    got = {(r.doc_id, r.n_words): r for r in Q.judge(df).collect()}
    assert sorted(k[0] or 0 for k, r in got.items() if r.kept) == [0, 1]
    for i, t in rows:
        r = got[i, brute(t or "")[0]]
        assert tuple(r)[1:6] == brute(t or "")
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert Q.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cheap_and_strict_rules_come_first(spark):
    def slow(f):
        return sum(range(20000)) < 0 or True

    rules = {"never": lambda f: False, "slow": slow, "quick": lambda f: True}
    df = spark.createDataFrame([(k, "x y z") for k in range(50)], "doc_id long, text string")
    assert Q.order_rules(df, rules=rules) == ["quick", "slow", "never"]


def test_order_changes_no_verdict(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    a = {tuple(r) for r in Q.judge(df, sample_rows=3).collect()}
    b = {tuple(r) for r in Q.judge(df, rules=dict(reversed(Q.RULES.items()))).collect()}
    assert a == b
