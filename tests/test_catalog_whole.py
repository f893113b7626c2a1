"""Registered queries that do the whole job of their operator."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.operators import vocab as V
from lodestone.sources import Tables
from lodestone.sources import mapping as M


def test_suggestions_reach_the_fuzzy_tier(spark, data):
    got = entry.queries()["c24_suggest_fuzzy"](spark, data).collect()
    fuzzy = [r for r in got if r.tier == 3]
    assert fuzzy and all("fuzzy" in r.tiers and 1 <= r.distance <= 2 and len(r.prefix) >= 3 for r in fuzzy)
    t = Tables(spark, data)
    p = M.typed_prefixes(t)
    p = p.unionAll(p.select(F.concat(F.lit("is "), "prefix")))
    more = {(r.prefix, r.text) for r in entry.queries()["c26_autocomplete"](spark, data).collect()}
    less = {(r.prefix, r.text) for r in V.autocomplete(p, M.vocabulary_by_category(t), M.scored_questions(t), 10, fuzzy=False).collect()}
    assert more - less


def test_request_without_a_place_meets_every_supplier(spark, data):
    suppliers = {str(r.s_suppkey) for r in spark.read.parquet(f"{data}/supplier.parquet").collect()}
    got = [r.document_uuid for r in entry.queries()["d05_place_filters_all"](spark, data).where("query_id = '11'").collect()]
    assert set(got) == suppliers and len(got) == len(suppliers)


def test_ids_are_fetched_from_all_documents(spark, data):
    got = {r.doc_id for r in entry.queries()["a14_fetch_by_ids_all"](spark, data).collect()}
    less = {r.k for r in M.clicks(Tables(spark, data)).select("k").distinct().collect()}
    assert max(less) < 100 and len(got - less) > 5


def test_plain_names_are_the_whole_queries():
    sql = entry.oracle_sql()
    for name, more in (("a14_fetch_by_ids", "_all"), ("c24_suggest", "_fuzzy"), ("c26_autocomplete", "_fuzzy"), ("c30_typo_candidates", "_full"), ("d05_place_filters", "_all")):
        assert sql[name] == sql[name + more] and name in entry.queries()
