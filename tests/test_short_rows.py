"""Rows of a search carry the forms of one token, not those of all tokens of their set."""

import pytest

from lodestone.operators import index as IX

DOCS = "document_uuid string, document_title string, document_summary string, key_facts array<string>, authority_rank_score double"


@pytest.mark.parametrize("several", [False, True])
def test_lists_of_all_tokens_do_not_travel(spark, monkeypatch, several):
    words = ["kar", "mor", "nev", "tol", "ris"]
    docs = spark.createDataFrame([(f"d{k}", " ".join(words[: 1 + k % 5]), None, [], 1.0) for k in range(50)], DOCS)
    index = IX.build(docs, {"document_title": 10})
    made, plain = {}, IX.materialize
    monkeypatch.setattr(IX, "materialize", lambda df, label: made.setdefault(label, plain(df, label)))
    sets = spark.createDataFrame([(" ".join(sorted(words[:n])),) for n in range(1, 6)], "token_key string")
    variants = spark.createDataFrame([(w, v) for w in words for v in words], "token string, alt string") if several else None
    got = {}
    for r in IX.all_hits(sets, index, variants).collect():
        got.setdefault(len(r.token_key.split()), set()).add(int(r.document_uuid[1:]) % 5 + 1)
    assert got == {n: set(range(1 if several else n, 6)) for n in range(1, 6)}
    for label in ("index-found", "index-second"):
        kinds = dict(made[label].dtypes)
        assert not [c for c, kind in kinds.items() if kind.startswith("array<array")], (label, kinds)
