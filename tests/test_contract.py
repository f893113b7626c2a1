"""Driver contract, plan checks, invariants and stream equality."""

import json

from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.operators import facets as FA
from lodestone.operators import ingest as IN
from lodestone.operators.analytics import count_by
from lodestone.sources import Tables
from lodestone.sources import mapping as M
from lodestone.streaming import streams as ST


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_statement_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200


def test_sections_are_complete():
    ids = {n[:3] for n in entry.queries()}
    for letter, n in dict(a=22, b=29, c=55, d=26, e=16, f=15, g=10, h=26, i=17, j=6).items():
        assert {f"{letter}{k:02d}" for k in range(1, n + 1)} <= ids


def test_plans_without_row_python_or_cross_joins(spark, data):
    q = entry.queries()
    for name in ("b10_match_tokens", "f01_facet_counts", "g01_shopping", "h01_session_table", "h06_popular_queries", "d16_same_subject", "i01_trending"):
        p = plan(q[name](spark, data))
        assert "BatchEvalPython" not in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_scan_reads_only_named_columns(spark, data):
    p = plan(entry.queries()["f06_filter_results"](spark, data))
    assert "text" not in p.split("ReadSchema:")[1] and "EqualTo(lang,en)" in p


def test_facets_sum_to_total_and_pages_partition(spark, data):
    t = Tables(spark, data)
    d = t.documents.select("doc_id", "lang", "source").cache()
    f = FA.facet_counts(d, ["lang", "source"]).groupBy("field").agg(F.sum("n").alias("n")).collect()
    assert {r.n for r in f} == {d.count()}
    pages = [{r.doc_id for r in FA.paginate(d, ["lang"], [F.asc("doc_id")], p, 50).collect()} for p in (1, 2, 3, 4)]
    assert sum(map(len, pages)) == d.count() and len(set().union(*pages)) == d.count()


def test_counters_as_stream_equal_batch(spark, data):
    t = Tables(spark, data)
    got = {(r.day.date(), r.value, r.n) for r in ST.replay_counters(t).collect() if r.dim == "event_type"}
    want = {(r.event_date, r.event_type, r.n) for r in count_by(M.events(t), "event_type").collect()}
    assert got == want


def test_vocabulary_maps(spark):
    m = {"term:new york:us_state": {"term": "new york", "category": "US State", "pos": "['noun']", "rank": "100"},
         "other": {"term": "Jazz", "category": "Keyword", "pos": "noun", "rank": "75.0"}, "term::x": {"category": "x"}}
    d = spark.createDataFrame([(json.dumps(m),)], "value string")
    got = {(r.term, r.category, r.pos, r.entity_type, r.rank) for r in IN.load_vocabulary(d).collect()}
    assert got == {("new york", "US State", "noun", "bigram", 100), ("jazz", "Keyword", "noun", "unigram", 75)}


def test_rejected_rows_carry_every_reason(spark):
    d = spark.createDataFrame([("t", "s", "c", "article", "news", "nope", ["k"] * 11, 120.0)],
                              "document_title string, document_summary string, document_category string, document_data_type string, "
                              "document_schema string, document_url string, primary_keywords array<string>, authority_score double")
    ok, bad = IN.validate_documents(d, schema="news")
    assert ok.count() == 0
    assert bad.first().errors == ["document_url not a URL", "primary_keywords size", "authority_score out of range", "document_category not allowed"]


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
