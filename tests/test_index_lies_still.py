"""A search moves its requests, never the kept tables of the index; ids that several rows share keep an entry for each."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import index as IX
from lodestone.sources.built import built
from lodestone.sources.tables import Tables

DOCS = "document_uuid string, document_title string, document_summary string, key_facts array<string>, authority_rank_score double"
WEIGHTS = {"document_title": 10, "document_summary": 1, "key_facts": 4}


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_neither_blocks_nor_postings_are_shuffled(spark, tmp_path, no_broadcast):
    spark.createDataFrame([(1, "x")], "r_regionkey int, r_name string").write.parquet(str(tmp_path / "region.parquet"))
    t = Tables(spark, str(tmp_path))
    docs = spark.createDataFrame([(f"d{k}", "kar mor" if k % 3 else "kar", f"nev word{k}", ["kar nev"], float(k % 5)) for k in range(200)], DOCS)
    index = IX.build(docs, WEIGHTS, keep=lambda part, make, by: built(t, f"still_{part}", ("region",), make, by))
    sets = spark.createDataFrame([("kar mor",), ("kar mor nev",)], "token_key string")
    found = IX._read(IX._requests(IX._asked(sets, index, None), index), index, False)
    second = IX._probed(found, F.array("second"), index, False)
    for name, df in (("blocks", found), ("probe", second)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if f"lodestone_still_{name}" in line]
        assert scans and all("Bucketed: true" in line for line in scans), name
    got = {(r.token_key, r.document_uuid) for r in IX.all_hits(sets, index).collect()}
    assert got == {(k, f"d{i}") for k in ("kar mor", "kar mor nev") for i in range(200) if i % 3}


def test_shared_and_unknown_ids(spark):
    rows = [("a", "kar", None, [], 3.0), ("a", "mor", None, [], None), ("b", "kar", None, [], None), (None, "kar", None, [], 1.0), ("c", "mor", "kar", [], 2.0)]
    index = IX.build(spark.createDataFrame(rows, DOCS), WEIGHTS)
    entries = index.blocks.select("token", "weight", F.explode("entries").alias("e")).select("token", "weight", "e.document_uuid", "e.authority").collect()
    key = lambda r: (r[0], r[1], r[2], r[3] is None, r[3] or 0)
    both = [(t, 10, "a", x) for t in ("kar", "mor") for x in (3.0, None)]
    assert sorted(map(tuple, entries), key=key) == sorted([*both, ("kar", 10, "b", None), ("kar", 1, "c", 2.0), ("mor", 10, "c", 2.0)], key=key)
    assert index.heads.where("token = 'kar' AND weight = 10").agg(F.sum("n"), F.min("least"), F.max("most")).first()[:] == (3, 3.0, 3.0)
