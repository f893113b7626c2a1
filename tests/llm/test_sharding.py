import zlib

import pytest

from lodestone.llm import sharding as S


@pytest.mark.parametrize("n,shards,bucket", [(0, 16, 1 << 20), (1, 16, 1 << 20), (5, 16, 8), (333, 16, 200), (320, 7, 1 << 20)])
def test_law_slots_and_rows(spark, n, shards, bucket):
    rows = [(k % 50 if k % 7 else None, [None, "", "é" * (k % 5), "w" * (2000 if k == 3 else 3)][k % 4], k, "s", 9) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _pos int, _bucket string, slot int")
    got = S.shard(df, shards, bucket_bytes=bucket).collect()
    assert sorted(str((r.doc_id, r.text, r._pos, r._bucket)) for r in got) == sorted(str(r[:4]) for r in rows)
    sizes = [sorted(r.slot for r in got if r.shard == s) for s in range(shards)]
    assert all(x == list(range(len(x))) for x in sizes)
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1


def test_order_is_mixed_and_repeatable(spark):
    df = spark.range(2000).selectExpr("id as doc_id", "cast(id as string) as text").coalesce(1)
    a, b = ([(r.doc_id, r.shard, r.slot) for r in S.shard(df, 4, bucket_bytes=2000).collect()] for _ in range(2))
    assert sorted(a) == sorted(b)
    order = [i for i, s, k in sorted(a, key=lambda r: r[1:])]
    assert sum(abs(x - y) for x, y in zip(order, order[1:])) / 2000 > 400
    assert sorted(a) != sorted((r.doc_id, r.shard, r.slot) for r in S.shard(df, 4, bucket_bytes=2000, seed=7).collect())


def test_equal_rows_spread_over_buckets(spark):
    df = spark.createDataFrame([(1, "same text")] * 400, "doc_id long, text string")
    sizes = [r["count"] for r in S.scatter_and_permute(df, 8, tie=["doc_id"]).groupBy("_bucket").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 120


def test_files_hold_the_shards(spark, tmp_path):
    df = spark.createDataFrame([(k, f"t{k}") for k in range(40)], "doc_id long, text string")
    S.write_shards(S.shard(df, 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40 and back.select("shard").distinct().count() == 4


def test_query_columns(spark, data):
    from lodestone.llm.queries import op2_sharding
    from pyspark.sql import functions as F
    got = {r.doc_id: r for r in op2_sharding(spark, data).collect()}
    for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect():
        b = (r.text or "").encode()
        assert (got[r.doc_id].size, got[r.doc_id].text_crc32) == (len(b) + 1, zlib.crc32(b))


def test_offsets_add_up_over_runs(spark):
    counts = spark.createDataFrame([(k, k % 7 + 1) for k in range(100) if k % 13], "_bucket int, count long")
    got = {r["_bucket"]: r["_start"] for r in S.offsets(counts, 8).collect()}
    before, want = 0, {}
    for k in (k for k in range(100) if k % 13):
        want[k], before = before, before + k % 7 + 1
    assert got == want


def test_every_bucket_is_a_task_of_its_own(spark):
    rows = spark.range(4000).select("id")
    dealt = S.scatter_and_permute(rows, 50)
    from pyspark.sql import functions as F
    files = dealt.select("_bucket", F.input_file_name().alias("f")).groupBy("f").agg(F.countDistinct("_bucket").alias("n")).collect()
    assert len(files) == 50 and all(r.n == 1 for r in files)
