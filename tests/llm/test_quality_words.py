"""Laws of the quality rules that hold at every length."""

import random

from lodestone.llm import quality as Q


def drawn(n, words, seed=3):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def test_junk_of_few_words_is_rejected_at_every_length(spark):
    junk, prose = [f"word{chr(97 + k)}" for k in range(20)], [f"term{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(600)]
    sizes = [1900, 2000, 2001, 2500, 20000]
    docs = spark.createDataFrame([(k, drawn(n, junk)) for k, n in enumerate(sizes)] + [(100 + k, drawn(n, prose)) for k, n in enumerate(sizes)], "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in Q.judge(docs).collect()}
    assert got == {k: (False, False) for k in range(len(sizes))} | {100 + k: (False, True) for k in range(len(sizes))}


def test_longer_junk_is_never_better():
    for d in (1, 20, 99, 100, 150, 400):
        rejected = [Q.few_distinct_words(Q.Features(" ".join(str(k % d) for k in range(n)))) for n in range(500, 60000, 500)]
        assert rejected == sorted(rejected)


def test_statement_and_operator_agree_on_long_junk(spark, tmp_path):
    import duckdb

    words = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    rows = [(k, drawn(n, words[:d], seed=k)) for k, (n, d) in enumerate((n, d) for n in (1500, 2000, 2001, 3000, 9000) for d in (20, 40, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    said = con.execute(f"SELECT doc_id, kept FROM ({Q.SQL})").fetchall()
    assert dict(said) == {r.doc_id: r.kept for r in Q.judge(docs).collect()}
    assert not dict(said)[9]  # 3,000 words drawn from 20
