"""Cleaning expressions on literal values."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X


def one(spark, value, fn, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("raw, want", [
    ("  a \t b\nc  ", "a bc"), ("<x>{y}|[z]^`", "xyz"), (None, ""), ("q" * 600, "q" * 500)])
def test_sanitize_query(spark, raw, want):
    assert one(spark, raw, X.sanitize_query) == want


@pytest.mark.parametrize("raw, want", [
    ("NYC", "New York"), ("atl", "Atlanta"), ("los angeles", "Los Angeles"), ("nowhere", "Atlanta"), (None, "Atlanta")])
def test_normalize_city(spark, raw, want):
    assert one(spark, raw, X.normalize_city) == want


TEMPORAL = [
    ("events in 1963", "years", "1963"), ("music from the 1960s", "decades", "1960s"), ("history 1955 to 1968", "ranges", "1955,1968"),
    ("19th century literature", "centuries", "19"), ("harlem renaissance artists", "eras", "harlem renaissance"),
    ("civil rights era speeches", "eras", "civil rights era"), ("last decade achievements", "relative", "last decade"),
    ("events in 2020", "years", "2020"), ("the roaring 1920s", "decades", "1920s"), ("from 1865 to 1877", "ranges", "1865,1877"),
    ("jazz age music", "eras", "jazz age"), ("past year news", "relative", "past year"), ("black history in 1954", "years", "1954"),
    ("post-war migration", "eras", "post-war"), ("antebellum south", "eras", "antebellum")]


@pytest.mark.parametrize("txt, kind, want", TEMPORAL)
def test_temporal(spark, txt, kind, want):
    r = one(spark, txt, X.temporal_expressions)
    assert [str(x) for x in r[kind]] == [want]
    others = {"years", "decades", "ranges"} - {kind}
    assert all(not r[k] for k in others)


@pytest.mark.parametrize("raw, want", [("georgia", ["GA", "Georgia"]), ("NY", ["New York", "Ny"]), ("Atlantis", ["Atlantis"])])
def test_state_variants(spark, raw, want):
    assert one(spark, raw, X.state_variants) == want


@pytest.mark.parametrize("ip, want", [("10.0.0.1", True), ("110.0.0.1", False), ("172.31.1.1", True), ("172.32.1.1", False),
                                      ("localhost", True), ("", True), ("8.8.8.8", False), ("fe80::1", True)])
def test_private_ip(spark, ip, want):
    assert one(spark, ip, X.is_private_ip) is want


@pytest.mark.parametrize("raw, want", [("['noun', 'x']", "noun"), ('["Verb"]', "verb"), ("[]", "unknown"), (None, "unknown"),
                                       ("US City", "proper_noun"), ("Adjective", "adjective")])
def test_normalize_pos(spark, raw, want):
    assert one(spark, raw, X.normalize_pos) == want


@pytest.mark.parametrize("raw, want", [("12", 12), ("12.9", 12), ("x", 0), (None, 0), ("nan", 0)])
def test_parse_rank(spark, raw, want):
    assert one(spark, raw, X.parse_rank) == want


def test_truncate_query_drops_fillers_and_caps(spark):
    assert one(spark, "Please find me the best soul food", X.truncate_query) == "soul food"
    assert len(one(spark, " ".join(["w"] * 60), X.truncate_query).split()) == 40


def test_question_slug(spark):
    assert one(spark, "Who was  Ida B. Wells?", X.question_slug) == "questions:who_was_ida_b_wells"


@pytest.mark.parametrize("raw, want", [("2024-03-05T10:00:00", "Mar 05, 2024"), ("2024-03-05", "Mar 05, 2024"), ("soon", "soon")])
def test_format_date(spark, raw, want):
    assert one(spark, raw, X.format_date) == want
