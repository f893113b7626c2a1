"""The length of a vector is summed once, not for each pair."""

from lodestone.operators import retrieve as RT


def test_lengths_are_summed_before_vectors_meet(spark):
    c = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "z", 3), ("q", "none", 4), ("r", "a", 1)], "query_id string, document_uuid string, candidate_rank int")
    v = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 2.0]), ("z", [0.0, 0.0])], "document_uuid string, embedding array<float>")
    q = spark.createDataFrame([("q", [0.0, 5.0]), ("r", None)], "query_id string, query_embedding array<float>")
    r = RT.rerank(c, v, q)
    assert sorted((x.query_id, x.document_uuid, x.vector_distance, x.semantic_rank) for x in r.collect()) == [
        ("q", "a", 0.2, 2), ("q", "b", 0.0, 1), ("q", "none", 1.0, 4), ("q", "z", 1.0, 3), ("r", "a", 1.0, 1)]
    above = r._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert above.count("zip_with(") == 1
