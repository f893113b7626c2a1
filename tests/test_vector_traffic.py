"""Vector search sends and sorts little beside what it must compare."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import index as IX
from lodestone.operators import retrieve as RT
from lodestone.operators import vectors as VX


def _frames(nq=60, ni=300, width=4):
    rng = np.random.default_rng(5)
    make = lambda n: list(rng.integers(-3, 4, (n, width)).astype(np.float32))  # noqa: E731  # few values: ties and zero vectors
    return (pd.DataFrame({"qid": [f"v{i}" for i in range(nq)], "qvec": make(nq)}), pd.DataFrame({"iid": [f"v{i}" for i in range(ni)], "ivec": make(ni)}))


def _plain(a, b, k, lo, hi):
    """Every pair, rounded and sorted."""
    out = []
    for qid, x in zip(a.qid, a.qvec):
        rows = []
        for iid, y in zip(b.iid, b.ivec):
            x8, y8 = x.astype(float), y.astype(float)
            d = 1 - (x8 @ y8) / (np.linalg.norm(x8) or 1) / (np.linalg.norm(y8) or 1)
            if qid != iid and (lo is None or lo <= 1 - d <= (2 if hi is None else hi)):
                rows.append((round(d, 9), iid))
        out += [(qid, iid, d) for d, iid in sorted(rows)[:k]]
    return out


@pytest.mark.parametrize("k,lo,hi", [(7, None, None), (7, 0.15, 0.92), (7, 0.2, None), (400, None, None)])
def test_blocks_give_the_plain_result(k, lo, hi):
    a, b = _frames()
    got = RT.block_topk(a, b, k, True, lo, hi)
    want = _plain(a, b, k, lo, hi)
    # distances at an edge of the band may differ in the last digit, so none of the band's edges is a value of the data
    assert [(q, i) for q, i, _ in want] == list(zip(got.qid, got.iid))
    assert np.allclose([d for *_, d in want], got.distance)


def test_what_lies_beyond_the_hits_so_far_is_left_out():
    a, b = _frames()
    whole = RT.block_topk(a, b, 7, True)
    third = whole.groupby("qid").distance.nth(2).to_numpy()
    got = RT.block_topk(a.assign(tau=np.where(np.arange(len(a)) % 2, third, np.nan)), b, 7, True)
    limit = dict(zip(a.qid, np.where(np.arange(len(a)) % 2, third, np.inf)))
    want = whole[whole.distance <= whole.qid.map(limit)]
    pd.testing.assert_frame_equal(got.reset_index(drop=True), want.reset_index(drop=True))


def test_a_visit_carries_no_vector(spark, monkeypatch):
    monkeypatch.setattr(RT, "QUERY_BLOCK", 16)
    monkeypatch.setattr(RT, "ITEM_BLOCK", 32)
    seen = {}
    kept = VX.materialize
    monkeypatch.setattr(VX, "materialize", lambda df, label: seen.setdefault(label, []).append(df.columns) or kept(df, label))
    a, b = _frames()
    q = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in zip(a.qid, a.qvec)], "qid string, qvec array<float>")
    i = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in zip(b.iid, b.ivec)], "iid string, ivec array<float>")
    got = RT.vector_topk(q, i, 7, exclude_self=True)
    assert [(r.qid, r.iid) for r in got.orderBy("qid", "rank").collect()] == sorted(
        ((x, y) for x, y, _ in _plain(a, b, 7, None, None)), key=lambda r: r[0])
    assert seen["vector-visits"] and all("qvec" not in c for c in seen["vector-visits"])


def test_a_cell_just_over_a_block_has_few_rings(spark):
    rng = np.random.default_rng(5)
    items = spark.createDataFrame([("*", f"v{i}", [float(y) for y in x]) for i, x in enumerate(rng.normal(size=(400, 4)))], "key string, iid string, ivec array<float>")
    sizes = spark.createDataFrame([("*", 400)], "key string, n bigint")
    _, cells = VX.in_cells(items, sizes, VX.pivots(rng.normal(size=(50, 4)), 1), 300)
    n = [r.n for r in cells.collect()]
    assert sum(n) == 400 and 1 < len(n) < VX.RINGS


def test_a_vector_of_many_queries_is_searched_once(spark, monkeypatch):
    asked = []
    search = RT.vector_topk
    monkeypatch.setattr(RT, "vector_topk", lambda q, *x, **y: asked.append(q.count()) or search(q, *x, **y))
    docs = spark.createDataFrame([("a", "Red house. Blue door", 5.0, [1.0, 0.0]), ("b", "Green tree", 4.0, [0.5, 0.5]), ("c", "Red door", 3.0, [0.0, 1.0])],
                                 "document_uuid string, document_title string, authority_rank_score double, embedding array<float>")
    docs = docs.withColumn("key_facts", F.array("document_title"))
    # q3 comes twice with the same vector, q1 and q2 share one
    q = spark.createDataFrame([("q1", "x", [1.0, 0.1]), ("q2", "y", [1.0, 0.1]), ("q3", "z", [0.0, 1.0]), ("q3", "z", [0.0, 1.0]), ("q4", "red", None)],
                              "query_id string, query string, query_embedding array<float>")
    got = RT.quick_search(q, docs, 2)
    assert sorted((r.query_id, r.document_uuid, r.how, r["rank"]) for r in got.collect()) == [
        ("q1", "a", "vector", 1), ("q1", "b", "vector", 2), ("q2", "a", "vector", 1), ("q2", "b", "vector", 2),
        ("q3", "c", "vector", 1), ("q3", "c", "vector", 2), ("q4", "a", "keyword", 1), ("q4", "c", "keyword", 2)]
    assert asked == [2]


def test_a_quick_index_reads_its_own_fields_alone(spark):
    docs = spark.createDataFrame([("a", "Red house", "Red house. A blue door", 5.0)], "document_uuid string, document_title string, document_summary string, authority_rank_score double")
    docs = docs.withColumn("key_facts", F.array("document_title"))
    own = IX.postings(docs, RT.QUICK_WEIGHTS, bits=())
    assert "document_summary" not in own._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
    cols = ["token", "document_uuid", "weight", "authority"]
    assert sorted(own.select(cols).collect()) == sorted(IX.postings(docs, RT.QUICK_WEIGHTS).select(cols).collect())
