"""The merged lists come from one search."""

from lodestone.catalog import section_d as D
from lodestone.operators import index as IX
from lodestone.sources.tables import Tables


def test_merge_searches_once(spark, data, monkeypatch):
    calls, plain_hits = [], IX.all_hits
    monkeypatch.setattr(IX, "all_hits", lambda *a, **b: calls.append(1) or plain_hits(*a, **b))
    D.d11(Tables(spark, data))
    assert len(calls) == 1
