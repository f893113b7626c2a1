import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import packing as P

PATH = public_tokenizers.path(P.VOCABULARY)
LIB = Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", ["", "a" * 5000, " " * 3000, "it's <|endoftext|> x<|endoftext|>", "é　日本 \x1c\x85\n\n ", "ÀḂ 12３ don't"])
def test_ids_as_the_library(text):
    assert list(P.token_ids(text, PATH)) == LIB.encode(text, add_special_tokens=False).ids


def test_knapsack_and_linear_program():
    value = np.array([0, .1, .25, .3, .52, .5, .7, .7, .9])
    best = {0: 0.0}
    for w in range(1, 9):
        best[w] = max([best[w - 1]] + [best[w - c] + value[c] for c in range(1, w + 1)])
    got, p = P.best_pattern(value, 8)
    assert abs(got - best[8]) < 1e-12 and abs(p @ value - got) < 1e-12 and p @ np.arange(9) <= 8
    rng = np.random.default_rng(2)
    demand = np.bincount(rng.integers(1, 257, 50000), minlength=257)
    whole = P.whole_patterns(demand, 256)
    assert (sum(k * p for p, k in whole) == demand).all()
    assert all(p @ np.arange(257) <= 256 for p, _ in whole)
    assert sum(k for _, k in whole) <= 1.01 * max(demand @ np.arange(257) / 256, demand[129:].sum())


def check_law(rows, docs, capacity=2048):
    by_doc, by_seq, ids = defaultdict(list), defaultdict(list), {}
    for i, t in docs:
        ids[i] = LIB.encode(t or "", add_special_tokens=False).ids + [1]
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for i, ps in by_doc.items():
        at = 0
        for r in sorted(ps, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids[i]), zlib.crc32(array("I", ids[i][at:at + r.length]).tobytes()))
            at += r.length
        assert at == len(ids[i])
    for ps in by_seq.values():
        at = 0
        for r in sorted(ps, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    tokens = sum(r.length for r in rows)
    return 1 - tokens / (capacity * len(by_seq))


def test_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    waste = check_law(P.pack(docs).collect(), docs.collect())
    assert waste < 0.05


@pytest.mark.parametrize("group", [3, 512])
def test_hot_length_nulls_and_small_capacity(spark, group, monkeypatch):
    rows = [(k, "same text of one length") for k in range(60)] + [(100, None), (101, ""), (102, "w " * 9000), (None, "id is null")] + [(200 + k, "word " * k) for k in range(40)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, length int, offset int")
    cut = P.stored(P.pieces(df, PATH, capacity=64), "test")
    check_law(P.assign(cut, 64, 4, rank_group=group).collect(), rows, 64)


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "one two three")] * 50, "doc_id long, text string")
    got = P.pack(df).collect()
    assert len(got) == 50 and sorted(r.offset for r in got) == [k * got[0].length for k in range(50)] and len({r.sequence_id for r in got}) == 1
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    r = P.pack(df, with_ids=True).first()
    assert zlib.crc32(array("I", r.ids).tobytes()) == r.ids_crc32
