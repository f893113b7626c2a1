"""Grams are made and named without a list for each of them."""

import re

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.rules import fixed as R
from lodestone.sources import mapping as M
from lodestone.sources.tables import Tables


def test_ngram_type_counts_words_without_splitting(spark):
    terms = ["a", "a b", " a  b ", "", None, "a\tb", "a b c d e", "  ", "a\n", "a b c", "\x0bb c", "a b", "a \r b c d"]
    got = [r.n for r in spark.createDataFrame([(k, t) for k, t in enumerate(terms)], "k int, term string").select("k", X.ngram_type(F.col("term")).alias("n")).orderBy("k").collect()]
    words = [None if t is None else re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ").count(" ") + 1 for t in terms]
    assert got == [R.NGRAM_NAMES.get(n, "ngram") for n in words]
    plan = spark.range(3).select(X.ngram_type(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan


def test_grams_are_not_cut_out_of_the_list_one_by_one(spark, data):
    plan = M.count_ngrams(Tables(spark, data), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan and "transform" in plan
