"""Vector search over cells against brute force, and what it leaves out."""

import numpy as np
import pytest

from lodestone.operators import retrieve as R
from lodestone.operators import vectors as VX


def clustered(seed, clusters=12, each=60, dim=8, spread=0.03):
    r = np.random.default_rng(seed)
    mid = r.normal(size=(clusters, dim))
    return np.repeat(mid, each, axis=0) + spread * r.normal(size=(clusters * each, dim))


def case(seed):
    x = clustered(seed)
    x[100:180] = x[100]  # copies
    x[200:203] = 0
    x[300] *= 1e6
    q = np.concatenate([x[::37], np.zeros((1, 8)), -x[5:6]])
    return x.astype(np.float32), q.astype(np.float32)


def frames(spark, x, q, key=lambda k: "a"):
    items = spark.createDataFrame([(f"{k:04}", [float(v) for v in row], key(k)) for k, row in enumerate(x)] + [("null", None, "a")], "iid string, ivec array<float>, key string")
    return spark.createDataFrame([(f"q{k}", [float(v) for v in row], key(k)) for k, row in enumerate(q)], "qid string, qvec array<float>, key string"), items


def brute(x, q, same=lambda i, j: True):
    x, q = x.astype(float), q.astype(float)
    n, m = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    d = np.round(1 - (q @ x.T) / np.where(n == 0, 1, n)[:, None] / np.where(m == 0, 1, m)[None, :], 9)
    return {f"q{i}": sorted((d[i, j], f"{j:04}") for j in range(len(x)) if same(i, j)) for i in range(len(q))}


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.qid, []).append((r.distance, r.iid))
    return {k: sorted(v) for k, v in out.items()}


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert [i for _, i in a[k]] == [i for _, i in b[k]], k
        assert np.allclose([d for d, _ in a[k]], [d for d, _ in b[k]], atol=1e-8)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 9)
    monkeypatch.setattr(R, "ITEM_BLOCK", 40)


def test_nearest_equal_brute_force(spark, small):
    x, q = case(1)
    qs, items = frames(spark, x, q)
    want = brute(x, q)
    for k in (1, 7):
        close(got(R.vector_topk(qs, items, k)), {i: v[:k] for i, v in want.items()})


def test_keys_and_bands_equal_brute_force(spark, small):
    x, q = case(2)
    key = lambda k: "ab"[k % 2] if k % 9 else f"rare{k % 4}"
    qs, items = frames(spark, x, q, key)
    want = brute(x, q, lambda i, j: key(i) == key(j))
    close(got(R.vector_topk(qs, items, 5, keyed=True)), {i: v[:5] for i, v in want.items() if v})
    band = {i: [t for t in v if t[0] <= 0.3] for i, v in brute(x, q).items()}
    close(got(R.vector_topk(qs.drop("key"), items.drop("key"), None, lo=0.7)), {i: v for i, v in band.items() if v})


def test_far_cells_are_not_met(spark, small, monkeypatch):
    x = clustered(3).astype(np.float32)
    qs, items = frames(spark, x, x[::24])
    met, plain = [], VX._meet
    monkeypatch.setattr(VX, "_meet", lambda m, items, cells, *a: met.append(m.join(cells, ["key", "cell", "ring"]).groupBy().sum("n").first()[0] or 0) or plain(m, items, cells, *a))
    close(got(R.vector_topk(qs, items, 5)), {i: v[:5] for i, v in brute(x, x[::24]).items()})
    assert sum(met) < 0.35 * len(x) * len(x[::24])


def test_pivots_of_nothing_and_of_copies():
    assert len(VX.pivots(np.zeros((5, 3)), 4)) == 0
    assert len(VX.pivots(np.ones((50, 3)), 4)) == 1
    assert len(VX.pivots(np.eye(6), 4)) == 4
