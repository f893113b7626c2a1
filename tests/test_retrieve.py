"""Retrieval and feedback against brute force on small tables."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import feedback as FB
from lodestone.operators import retrieve as R
from lodestone.operators.windows import carry_forward, once_per_ttl, top_k


def docs(spark, rows):
    d = spark.createDataFrame(rows, "document_uuid string, document_title string, authority_rank_score double")
    return d, R.postings(d, {"document_title": 10})


ROWS = [("1", "green apple tree", 5.0), ("2", "green apples", 9.0), ("3", "apple", 1.0), ("4", "tall green tree house", 2.0), ("5", "apple green", 7.0)]


def test_all_tokens_must_match(spark):
    d, post = docs(spark, ROWS)
    q = spark.createDataFrame([("a", "green apple"), ("b", "zebra apple"), ("c", "the")], "query_id string, query string")
    got = {(r.query_id, r.document_uuid, r.candidate_rank) for r in R.keyword_candidates(q, d, 3, post=post).collect()}
    assert got == {("a", "5", 1), ("a", "1", 2), ("c", "2", 1), ("c", "5", 2), ("c", "1", 3)}


def test_one_typo_per_token_equals_brute_force(spark):
    d, post = docs(spark, ROWS)
    q = spark.createDataFrame([("a", "gren aple"), ("b", "green apples")], "query_id string, query string")
    got = {(r.query_id, r.document_uuid) for r in R.keyword_candidates(q, d, 9, num_typos=1, post=post).collect()}
    assert got == {("a", "1"), ("a", "5"), ("b", "1"), ("b", "2"), ("b", "5")}


def test_trailing_tokens_dropped_until_enough(spark):
    d, post = docs(spark, ROWS)
    q = spark.createDataFrame([("a", "green tree zebra house")], "query_id string, query string")
    got = [r.document_uuid for r in R.keyword_candidates(q, d, 9, drop_tokens=2, post=post).orderBy("candidate_rank").collect()]
    assert got == ["1", "4"]


def test_vector_topk_equals_brute_force_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    monkeypatch.setattr(R, "ITEM_BLOCK", 11)
    rnd = np.random.default_rng(3)
    m = rnd.normal(size=(60, 8)).astype(np.float32)
    rows = [(str(i), [float(v) for v in m[i]]) for i in range(60)]
    q = spark.createDataFrame(rows, "qid string, qvec array<float>")
    i = spark.createDataFrame(rows, "iid string, ivec array<float>")
    got = {}
    for r in R.vector_topk(q, i, 4, exclude_self=True).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.iid)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = u.astype(float) @ u.T.astype(float)
    np.fill_diagonal(sim, -9)
    assert got == {str(k): [str(x) for x in np.argsort(-sim[k])[:4]] for k in range(60)}


def test_same_group_offers_every_seed_its_best(spark):
    d = spark.createDataFrame([(str(i), "g" if i % 3 else "h", float(i % 7)) for i in range(40)], "document_uuid string, g string, authority_rank_score double")
    got = {}
    for r in R.same_group(d, d, "g", 3).orderBy("rank").collect():
        got.setdefault(r.seed_id, []).append(r.document_uuid)
    rows = d.collect()
    for s in rows:
        want = sorted([x for x in rows if x.g == s.g and x.document_uuid != s.document_uuid], key=lambda x: (-x.authority_rank_score, x.document_uuid))
        assert got[s.document_uuid] == [x.document_uuid for x in want[:3]]


def test_synonyms_go_one_way(spark):
    w = spark.createDataFrame([(1, "attorney"), (2, "lawyer")], "id int, word string")
    s = spark.createDataFrame([("attorney", "lawyer")], "root string, synonym string")
    assert {(r.id, r.word) for r in R.expand_synonyms(w, s).collect()} == {(1, "attorney"), (1, "lawyer"), (2, "lawyer")}


def test_once_per_ttl_equals_a_walk(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.randint(0, 2000)) for k in "ab" for _ in range(80)]
    d = spark.createDataFrame(rows, "k string, s bigint").select("k", F.timestamp_seconds("s").alias("ts"))
    got = {(r.k, r.accepted) for r in once_per_ttl(d, ["k"], "ts", 300).collect()}
    want = set()
    for k in "ab":
        last = None
        for s in sorted(x for kk, x in rows if kk == k):
            if last is None or s >= last + 300:
                want.add((k, s))
                last = s
    assert got == want


def test_carry_forward_crosses_hours(spark):
    rows = [(1, 0, "x"), (2, 1800, None), (3, 9000, None), (4, 9100, "y"), (5, 20000, None)]
    d = spark.createDataFrame(rows, "id int, s bigint, v string").select("id", F.lit("k").alias("k"), F.timestamp_seconds("s").alias("ts"), "v")
    got = {r.id: r.seen_v for r in carry_forward(d, ["k"], "ts", "id", ["v"]).collect()}
    assert got == {1: "x", 2: "x", 3: "x", 4: "y", 5: "y"}


def test_top_k_prunes_before_the_shuffle(spark):
    d = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    plan = top_k(d, ["k"], [F.desc("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_trending_scopes(spark):
    rows = [("s1", "q", 1, "u", "Rome", "Italy"), ("s1", "q", 1, "u", "Rome", "Italy"), ("s2", "q", 1, "u", None, "Italy")]
    d = spark.createDataFrame(rows, "session_id string, query string, doc_key int, clicked_url string, city string, country string") \
        .withColumn("ts", F.timestamp_seconds(F.lit(0)))
    got = {(r.place, r.score) for r in FB.trending(d, ["city", "country"]).collect()}
    assert got == {("Rome", 1), ("Italy", 2), ("general", 2)}
    got = {(r.place, r.score) for r in FB.trending(d, ["city", "country"], dedupe_scope="session").collect()}
    assert got == {("Rome", 1), ("Italy", 1), ("general", 2)}


def test_reload_changes_no_store_age(spark):
    s = spark.createDataFrame([("h", "q one", 2, 1, 100, 100 + 7 * 86400)], "query_hash string, query string, search_count bigint, result_count bigint, created bigint, expires bigint")
    log = spark.createDataFrame([("Q, one!", 5)], "query string, results_count bigint").withColumn("ts", F.timestamp_seconds(F.lit(10**6)))
    h = FB.X.store_hash(F.lit("q one"))
    r = FB.store_queries(s.withColumn("query_hash", h), log).first()
    assert (r.search_count, r.result_count, r.expires) == (3, 5, 100 + 7 * 86400)
