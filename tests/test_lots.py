"""Candidates that carry the vector of their query are ranked again where they lie; a set that many queries ask for lies in several lots."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import index as IX
from lodestone.operators import retrieve as RT

DOCS = "document_uuid string, document_title string, authority_rank_score double"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(f"d{k}", "kar mor" if k % 3 else "kar", float(k % 4)) for k in range(60)], DOCS)
    log = [(f"q{k}", ["kar", "mor kar", "of", "absent"][k % 4]) for k in range(90)]
    vectors = spark.createDataFrame([(f"d{k}", [float(k % 7), 1.0] if k % 5 else None) for k in range(0, 60, 2)], "document_uuid string, embedding array<float>")
    asked = spark.createDataFrame([(f"q{k}", [1.0, float(k % 11)] if k % 6 else None) for k in range(80)], "query_id string, query_embedding array<float>")
    return docs, log, vectors, asked


@pytest.mark.parametrize("lot", [64, 4])
@pytest.mark.parametrize("more", [[], [("q0", "mor"), ("q1", "kar")]])  # ids that several queries share
def test_ranks_are_those_of_the_plain_join(spark, monkeypatch, tables, lot, more):
    docs, log, vectors, asked = tables
    monkeypatch.setattr(RT, "LOT", lot)
    q, index = spark.createDataFrame([*log, *more], "query_id string, query string"), IX.build(docs)
    plain = RT.keyword_candidates(q, docs, browse=5, index=index)
    carried = RT.keyword_candidates(q, docs, browse=5, index=index, carry=RT.query_side(asked))
    cols = ["query_id", "document_uuid", "text_match", "candidate_rank", "vector_distance", "semantic_rank"]
    want, got = (sorted(map(tuple, RT.rerank(x, vectors, asked).select(cols).collect())) for x in (plain, carried))
    assert got == want and len(got) > 1000


def test_no_row_moves_to_be_ranked_again(spark, tables):
    docs, log, vectors, asked = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q, index = spark.createDataFrame(log, "query_id string, query string"), IX.build(docs)
        r = RT.rerank(RT.keyword_candidates(q, docs, browse=5, index=index, carry=RT.query_side(asked)), vectors, asked)
        plan = r._jdf.queryExecution().executedPlan().toString()
        # above the join of the queries with their hits nothing is shuffled: neither by the vectors of documents nor for the ranks
        assert "Exchange" not in plan.split("SortMergeJoin [token_key")[0].replace("BroadcastExchange", "")
        assert "SortMergeJoin [token_key" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_metadata_is_sent_to_the_rows(spark, tables):
    docs, log, _, _ = tables
    big = spark.range(1000).select(F.concat(F.lit("d"), F.col("id") % 60).alias("document_uuid"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = RT.attach_metadata(big, docs, ["document_title"])
        assert "BroadcastHashJoin" in d._jdf.queryExecution().executedPlan().toString()
        assert d.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
