"""Many sets are searched in slices of the documents; what is found is what joins with the index find."""

import random

import pytest

from lodestone.operators import index as IX
from lodestone.operators import slices as SL

DOCS = "document_uuid string, document_title string, document_summary string, key_facts array<string>, authority_rank_score double"
WEIGHTS = {"document_title": 10, "document_summary": 1, "key_facts": 4}
WORDS = [f"{a}{b}{c}" for a in "kmn" for b in "aeo" for c in "rs"]


def collection(seed, n, twice):
    r = random.Random(seed)
    draw = lambda k: [r.choice(WORDS) for _ in range(k)]
    rows = [(f"d{k}" if k % 41 else None, " ".join(draw(r.randint(0, 3))), " ".join(draw(r.randint(0, 9))) or None, draw(r.randint(0, 4)), float(r.randint(0, 4)) if k % 9 else None)
            for k in range(n)]
    # ids that several documents share: all of the row again, and the id with another authority
    return rows + [row if k % 2 or twice == "all" else (*row[:4], 77.0) for k, row in enumerate(rows[:: 1 if twice == "all" else 6]) if twice]


def found(df, several):
    # of an id with several authorities one is kept where a set has more than one token
    loose = lambda r: len(r.token_key.split()) > 1
    return sorted((r.token_key, r.document_uuid, r.text_match, sorted(r.fields), None if loose(r) else str(r.authority)) for r in df.collect())


@pytest.mark.parametrize("several", [False, True])
@pytest.mark.parametrize("twice", ["some", "all"])
def test_slices_find_what_joins_find(spark, monkeypatch, several, twice):
    r = random.Random(7)
    index = IX.build(spark.createDataFrame(collection(3, 300, twice), DOCS), WEIGHTS)
    keys = sorted({" ".join(sorted(set(r.choice([*WORDS, "absent"] if r.random() < 0.3 else WORDS) for _ in range(r.randint(1, 4))))) for _ in range(120)} | {""})
    sets = spark.createDataFrame([(k,) for k in keys], "token_key string")
    variants = spark.createDataFrame([(a, b) for a in [*WORDS, "absent"] for b in WORDS if a[:2] == b[:2] or a == "absent"], "token string, alt string") if several else None
    want = found(IX.all_hits(sets, index, variants), several)
    monkeypatch.setattr(IX, "JOINED", -1)
    monkeypatch.setattr(IX, "_complete", None)  # what joins the sets with the index
    monkeypatch.setattr(SL, "LEAST", 64)
    monkeypatch.setattr(SL, "PACK", 100)
    got = found(IX.all_hits(sets, index, variants), several)
    assert got == want and len(got) > 200


def test_rows_are_looked_up_a_part_at_a_time():
    import pyarrow as pa
    n = 50
    post = pa.RecordBatch.from_pydict({"form": [k // n for k in range(3 * n)], "weight": [1 + k // n for k in range(3 * n)], "fields": pa.array([1] * (3 * n), pa.int32()),
                                       "document_uuid": [f"d{k % n * (1 + k // n)}" for k in range(3 * n)], "authority": [1.0] * (3 * n)})
    sets = pa.RecordBatch.from_pydict({"token_key": ["a b", "c", "a b c", "a b"], "ids": pa.array([[0, 1], [2], [0, 1, 2], [0, 1]], pa.list_(pa.int64()))})
    a, b, c = ({k * m for k in range(n)} for m in (1, 2, 3))
    want = sorted([("a b", k, 3) for k in a & b] + [("c", k, 3) for k in c] + [("a b c", k, 6) for k in a & b & c])
    for at_once, size in ((1 << 20, 1 << 16), (7, 3), (1, 1)):
        mp = pytest.MonkeyPatch()
        mp.setattr(SL, "AT_ONCE", at_once), mp.setattr(SL, "BATCH", size)
        made = list(SL._search([post], [sets], []))
        mp.undo()
        assert sorted((r["token_key"], int(r["document_uuid"][1:]), r["text_match"]) for x in made for r in x.to_pylist()) == want
        assert all(len(r["fields"]) == len(r["token_key"].split()) for x in made for r in x.to_pylist())
        assert max(x.num_rows for x in made) <= size
