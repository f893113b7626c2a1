"""Spelling variants against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from lodestone.llm import spelling as S


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, min_chars=7, min_count=2, ratio=10):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= min_chars:
                count[run] += 1
    n = {w: c for w, c in count.items() if c >= min_count}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best
    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_words_forms_and_roots_equal_brute_force(spark):
    r = random.Random(5)
    stems = ["".join(r.choice("abÀé") for _ in range(r.randint(6, 9))) for _ in range(12)]
    def variant(w):
        for _ in range(r.randint(0, 2)):
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1:], w[:i] + "aBÉx"[r.randrange(4)] + w[i:], w[:i] + r.choice("abéy") + w[i + 1:]])
        return w
    rows = [(k, " ".join([*(variant(r.choice(stems)) for _ in range(r.randint(0, 40))), *[stems[k % 3]] * 15])) for k in range(120)]
    rows += [(1, rows[1][1]), (1, rows[1][1]), (500, None), (501, ""), (None, rows[4][1]), (502, "12 ab - abcdefgh×abcdefg÷")]
    got = S.variants(frame(spark, rows)).collect()
    assert len(got) == len({x.word for x in got})
    assert {tuple(x) for x in got} == brute(rows)
    assert any(x.form for x in got) and any(x.n_near > 3 for x in got)


@pytest.mark.parametrize("alphabet,sizes", [("ab", (1, 2, 3, 4, 5, 6, 7)), ("aé", (8, 9))])
def test_every_near_pair_is_found_once(spark, alphabet, sizes):
    words = ["".join(x) for n in sizes for x in itertools.product(alphabet, repeat=n)]
    got = [tuple(sorted((x.word, x.other))) for x in S.near_pairs(spark.createDataFrame([(w, 1) for w in [*words, "", None]], "word string, n long")).collect()]
    want = set()
    known = set(words)
    for w in words:
        for i in range(len(w) + 1):
            for c in alphabet:
                for v in (w[:i] + c + w[i:], w[:i] + c + w[i + 1:] if i < len(w) else w):
                    if v != w and v in known:
                        want.add(tuple(sorted((w, v))))
    assert len(got) == len(set(got)) and set(got) == want


def test_a_chain_of_forms_is_followed_to_its_end(spark):
    chain = ["abcdefgh" + "x" * k for k in range(6)]  # each near to the next only
    t = spark.createDataFrame([(w, 10 ** (k + 1)) for k, w in enumerate(chain)], "word string, n long")
    got = {x.word: (x.form, x.root, x.form_n) for x in S.roots(S.forms(t)).collect()}
    assert got == {w: (chain[k + 1] if k < 5 else None, chain[-1], 10 ** (k + 2) if k < 5 else None) for k, w in enumerate(chain)}


def test_of_equal_counts_the_smallest_word_is_the_form(spark):
    t = spark.createDataFrame([("abcdefg", 2), ("zbcdefg", 20), ("ébcdefg", 20), ("bbcdefg", 19)], "word string, n long")
    assert {x.word: x.form for x in S.forms(t).collect()}["abcdefg"] == "zbcdefg"


def test_empty_tables_long_texts_and_clashing_columns(spark):
    assert S.variants(frame(spark, [])).count() == 0
    assert S.variants(frame(spark, [(1, None), (2, "short words only")])).count() == 0
    long = "wordofletters " * 200_000
    docs = frame(spark, [(3, long), (3, "wordofletter wordofletter " + "q" * 300_000)]).selectExpr("*", "1 AS word", "2 AS n", "3 AS run", "4 AS id", "'x' AS root")
    assert {tuple(x) for x in S.variants(docs).collect()} == brute([(3, long), (3, "wordofletter wordofletter")])
