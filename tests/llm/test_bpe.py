import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from lodestone.llm import bpe as B

PATH = public_tokenizers.path(B.VOCABULARY)
LIB = Tokenizer.from_file(PATH)
TEXTS = ["", " ", "Hello, the WORLD's don't'LL x", "a" * 3000, "ab" * 2000, "é" * 500, "Straße İstanbul ΣΊΣΥΦΟΣ", "été ñ", "<|endoftext|>", "x<|startoftext|>Y<|endoftext|><|endoftext|> z",
         "<|ENDOFTEXT|>", "a\x1cb\x85c\xa0d　e​f", "12345 ⅷ ² ½", "日本語 テスト 한국어 ไทย", "🙂👍🏽", "�İi", "'s't're", "_-_-_!!!", "ﬁ ﬂ Å Ω", "̈́क़", "a'ſ", "K"]


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(text):
    ids = LIB.encode(text, add_special_tokens=False).ids
    n, got, out = B.load(PATH).whole(text)
    assert [int(x) for x in got.split()] == ids and n == len(ids) and out == LIB.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text("abeht 'snrl.,0", max_size=80))
def test_random_texts(text):
    test_as_the_library.__wrapped__(text) if hasattr(test_as_the_library, "__wrapped__") else test_as_the_library(text)


def test_long_word_takes_linear_time():
    import time
    w = "".join(np.random.default_rng(0).choice(list("thaneris"), 60000))
    took = []
    for n in (20000, 60000):
        t = time.process_time()
        B.load(PATH).whole(w[:n])
        took.append(time.process_time() - t)
    assert took[1] < 8 * took[0] + 0.5


def test_documents(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect() + [(None, "x y"), (-1, None)]
    got = sorted(map(tuple, B.encode_decode(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = []
    for i, t in rows:
        ids = LIB.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_empty_table_and_full_output(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, ids string")
    assert B.encode_decode(empty).count() == 0
    r = B.encode_decode(spark.createDataFrame([(1, "hello world", "z")], "doc_id long, text string, ids string"), full=True).first()
    assert LIB.decode(r.ids) == r.decoded
