"""A search with a limit reads the index in few rounds."""

from lodestone.operators import index as IX


def test_a_set_with_too_few_hits_needs_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(IX, "BLOCK", 64)
    monkeypatch.setattr(IX.in_blocks, "__defaults__", (64,))
    n = 2000  # each token has 1,000 documents or more, two documents hold both
    rows = [(f"d{i:04d}", ("red" if i % 2 else "blue") + (" red blue" if i in (10, 11) else ""), float(i % 7)) for i in range(n)]
    index = IX.build(spark.createDataFrame(rows, "document_uuid string, document_title string, authority_rank_score double"), {"document_title": 1}, bits=())
    rounds, read = [], IX._read
    monkeypatch.setattr(IX, "_read", lambda *a: rounds.append(1) or read(*a))
    sets = spark.createDataFrame([("blue red",), ("red",)], "token_key string")
    got = IX.best_hits(sets, index, 5).collect()
    assert sorted(r.document_uuid for r in got if r.token_key == "blue red") == ["d0010", "d0011"]
    red = sorted((-a, d) for d, t, a in rows if "red" in t)[:5]
    assert sorted((-r.authority, r.document_uuid) for r in got if r.token_key == "red") == red
    assert len(rounds) <= 4  # 5, 64, 512, 4,096 postings; 5, 15, 45, ... 1,215 needed six
