"""The block index and its searches against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import index as IX
from lodestone.sources.built import built, fingerprint
from lodestone.sources.tables import Tables

WEIGHTS = {"document_title": 10, "document_summary": 1, "key_facts": 4}
WORDS = [f"{a}{b}{c}" for a in "kmn" for b in "aeo" for c in "rsv"] + ["common", "frequent"]


def collection(seed, n=400):
    r = random.Random(seed)
    draw = lambda k: [r.choice(WORDS[:27]) for _ in range(k)] + ["common"] * (r.random() < 0.9) + ["frequent"] * (r.random() < 0.5)
    rows = []
    for k in range(n):
        title, facts, text = draw(r.randint(0, 2)), draw(r.randint(0, 3)), draw(r.randint(0, 6))
        rows.append((f"d{k}", " ".join(title), " ".join(text) or None, facts, float(r.randint(0, 4)) if k % 50 else None))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "document_uuid string, document_title string, document_summary string, key_facts array<string>, authority_rank_score double")


def weight_of(row, token):
    return sum(w for f, w in ((row[1], 10), (row[2] or "", 1), (" ".join(row[3]), 4)) if token in f.split())


def brute(rows, key, alts=None):
    out = []
    for r in rows:
        ws = [max(weight_of(r, a) for a in [t, *(alts or {}).get(t, [])]) for t in key.split()]
        if all(ws):
            out.append((-sum(ws), r[4] is None, -(r[4] or 0), r[0]))
    return sorted(out)


def sets(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "token_key string")


def queries(seed, n=40):
    r = random.Random(seed)
    return sorted({" ".join(sorted(set(r.choice([*WORDS, "absent"] if r.random() < 0.5 else WORDS[27:]) for _ in range(r.randint(1, 4))))) for _ in range(n)} | {"", "common", "frequent", "common frequent"})


@pytest.fixture(scope="module")
def small(spark):
    rows = collection(1)
    mp = pytest.MonkeyPatch()
    mp.setattr(IX, "BLOCK", 16)
    cut = IX.in_blocks
    mp.setattr(IX, "in_blocks", lambda post, docs: cut(post, docs, 16))
    index = IX.build(frame(spark, rows), WEIGHTS)
    mp.undo()
    return rows, index


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.token_key, []).append((-r.text_match, r.authority is None, -(r.authority or 0), r.document_uuid))
    return {k: sorted(v) for k, v in out.items()}


def test_blocks_are_bounded_and_hold_every_posting(small):
    rows, index = small
    assert index.blocks.select(F.max(F.size("entries"))).first()[0] <= 40
    assert index.heads.agg(F.sum("n")).first()[0] == index.probe.count() == index.blocks.select(F.explode("entries")).count()
    terms = {r.token: (r.df, r.top) for r in index.terms().collect()}
    assert terms == {w: (sum(1 for r in rows if weight_of(r, w)), max(weight_of(r, w) for r in rows)) for w in WORDS}


def test_all_hits_equal_brute_force(spark, small):
    rows, index = small
    keys = queries(2)
    want = {k: brute(rows, k) for k in keys if k}
    assert got(IX.all_hits(sets(spark, keys), index)) == {k: v for k, v in want.items() if v}
    totals = {r.token_key: r.total for r in IX.set_totals(sets(spark, keys), index).collect()}
    assert totals == {k: len(v) for k, v in want.items() if v}


def test_variants_stand_for_tokens(spark, small):
    rows, index = small
    alts = {"kar": ["kas", "mar"], "common": ["frequent"], "absent": ["kar"]}
    keys = ["kar", "absent", "common kar", "absent common", "absent frequent kar"]
    variants = spark.createDataFrame([(t, a) for t, v in alts.items() for a in v], "token string, alt string")
    assert got(IX.all_hits(sets(spark, keys), index, variants)) == {k: v for k in keys if (v := brute(rows, k, alts))}


@pytest.mark.parametrize("k", [1, 5, 30])
def test_best_hits_equal_brute_force(spark, small, k):
    rows, index = small
    keys = queries(3)
    assert got(IX.best_hits(sets(spark, keys), index, k)) == {q: v[:k] for q in keys if q and (v := brute(rows, q))}


def test_best_hits_leave_hopeless_blocks_unread(spark, small, monkeypatch):
    rows, index = small
    read, plain = [], IX._read
    monkeypatch.setattr(IX, "_read", lambda req, ix, several: read.append(req.count()) or plain(req, ix, several))
    IX.best_hits(sets(spark, ["frequent"]), index, 5).count()  # an eighth of the documents hold it in all three fields
    assert sum(read) < index.heads.where("token = 'frequent'").count() / 3


def test_empty_collections_and_sets(spark):
    index = IX.build(frame(spark, []), WEIGHTS)
    assert IX.all_hits(sets(spark, ["common"]), index).count() == 0 and IX.best_hits(sets(spark, ["common"]), index, 3).count() == 0
    assert IX.all_hits(sets(spark, []), IX.build(frame(spark, collection(4, 5)), WEIGHTS)).count() == 0


def test_stored_tables_follow_their_sources(spark, tmp_path):
    path, made = str(tmp_path / "region.parquet"), []

    def table():
        return built(Tables(spark, str(tmp_path)), "regions", ("region",), lambda: made.append(1) or spark.read.parquet(path).groupBy("r_name").count(), "r_name")

    spark.createDataFrame([(1, "a"), (2, "a")], "r_regionkey int, r_name string").write.parquet(path)
    assert [tuple(r) for r in table().collect()] == [("a", 2)] and table().count() == 1 and len(made) == 1
    before = fingerprint(spark, path)
    spark.createDataFrame([(3, "b")], "r_regionkey int, r_name string").write.mode("append").parquet(path)
    assert fingerprint(spark, path) != before
    assert sorted(tuple(r) for r in table().collect()) == [("a", 2), ("b", 1)] and len(made) == 2


def test_a_join_moves_the_request_and_not_the_index(spark, tmp_path):
    spark.createDataFrame([(k, f"r{k % 9}") for k in range(500)], "r_regionkey int, r_name string").write.parquet(str(tmp_path / "region.parquet"))
    t = Tables(spark, str(tmp_path))
    table = built(t, "by_name", ("region",), lambda: t.region, "r_name")
    asked = spark.createDataFrame([("r1",), ("r2",)], "r_name string")
    plan = asked.hint("merge").join(table, "r_name")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
