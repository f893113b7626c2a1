"""Candidates are ranked for each token set before they are dealt to the queries."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import index as IX
from lodestone.operators import retrieve as R

DOCS = "document_uuid string, document_title string, document_summary string, key_facts array<string>, authority_rank_score double"
LOG = [("q1", "kar mor"), ("q2", "mor kar"), ("q3", "kar"), ("q4", "of the"), ("q5", ""), ("q6", "kar absent")]


def collection(spark):
    return spark.createDataFrame([(f"d{k}", "kar" if k % 2 else "mor", "kar mor" if k % 3 else None, ["kar"], float(k % 4) if k % 5 else None) for k in range(40)], DOCS)


def plain(q, docs, index, k, browse):
    """Every hit of every query, ranked query by query."""
    t = R.query_tokens(q)
    hits = t.select("query_id", "token_key").join(IX.all_hits(t, index), "token_key").select("query_id", "document_uuid", "text_match", "authority")
    head = docs.select("document_uuid", F.lit(0).cast("bigint").alias("text_match"), F.col("authority_rank_score").alias("authority")).orderBy(F.desc("authority"), "document_uuid").limit(browse)
    rows = hits.unionByName(t.where("token_key = ''").select("query_id").crossJoin(head))
    w = W.partitionBy("query_id").orderBy(F.desc("text_match"), F.desc("authority"), "document_uuid")
    rows = rows.withColumn("candidate_rank", F.row_number().over(w)).where(F.lit(True) if k is None else F.col("candidate_rank") <= k)
    return sorted(map(tuple, rows.drop("authority").collect()))


@pytest.mark.parametrize("k", [None, 3])
@pytest.mark.parametrize("more", [[], [("q1", "kar"), ("q3", "kar")]])  # ids that several queries share are ranked over all of them
def test_ranks_are_those_of_each_query(spark, k, more):
    docs, q = collection(spark), spark.createDataFrame([*LOG, *more], "query_id string, query string")
    index = IX.build(docs)
    got = R.keyword_candidates(q, docs, k, browse=5, index=index)
    assert got.columns == ["query_id", "document_uuid", "text_match", "candidate_rank"]
    assert sorted(map(tuple, got.collect())) == plain(q, docs, index, k, 5)


def test_rows_of_a_query_are_not_sorted_again(spark):
    docs, q = collection(spark), spark.createDataFrame(LOG, "query_id string, query string")
    plan = R.keyword_candidates(q, docs, browse=5, index=IX.build(docs))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number()" in line]
    assert windows and not any("definition(query_id#" in line for line in windows)
