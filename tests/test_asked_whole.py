"""Asked queries are used whole, however long: what their last words say counts as their SQL says."""

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.sources import mapping as M
from lodestone.sources.tables import Tables

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TALK = "conv_id bigint, turn bigint, role string, text string"
#: More than 500 characters in front of the words that count.
LONG = "filler " * 90


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("asked")
    words = "harbour lantern velvet " * 60
    docs = [(1, words, "fr", "src1", 10), (2, "copper meadow " * 3, "de", "src2", 10), (3, "quartz window " * 3, "en", "src3", 10)]
    talk = [(k, 0, "user", LONG + end) for k, end in enumerate(["harbour lantern velvet", "copper meadow newest", "quartz window cheap", "copper", "harbour", "newest reviews"] * 5)]
    talk += [(k, 0, "user", "short harbour") for k in range(30, 35)]
    tables = {"documents": (docs, DOCS), "conversations": (talk, TALK), "labels": ([(1, 1, 0)], "doc_id bigint, quality int, toxic int")}
    for name, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_no_asked_query_is_cut(spark, folder):
    t = Tables(spark, folder)
    asked = {r.query_id: r.query for r in M.asked_queries(t).collect()}
    log = {r.query_id: r.query for r in M.query_log(t).collect()}
    assert asked.keys() == log.keys() and len(log) == 35
    assert all(log[k] in asked[k] for k in log)
    assert min(len(q) for q in log.values()) < 500 < max(len(q) for q in log.values())


@pytest.mark.parametrize("name", ["c44_entities", "c53_dynamic_weights", "c54_boosted_query", "c55_search_params"])
def test_last_words_count(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in found.description]
    want = sorted((tuple(map(str, r)) for r in found.fetchall()))
    got = sorted(tuple(map(str, r)) for r in entry.queries()[name](spark, folder).select(cols).collect())
    assert got == want and got
