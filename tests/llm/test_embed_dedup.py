import numpy as np
import pytest

from lodestone.llm import embed_dedup as E


def brute(rows, threshold=0.9):
    good = []
    for k, (i, v) in enumerate(rows):
        ok = i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) if ok else None)
    n, comp = [0] * len(rows), [r[0] for r in rows]
    link = [[a is not None and b is not None and x != y and len(a) == len(b) and a @ b >= threshold for y, b in enumerate(good)] for x, a in enumerate(good)]
    n = [int(sum(r)) for r in link]
    for _ in rows:
        for x in range(len(rows)):
            for y in range(len(rows)):
                if link[x][y]:
                    comp[x] = comp[y] = min(comp[x], comp[y])
    return [(i, n[k], comp[k], i is not None and comp[k] == i) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("block", [7, 2048])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows, base = [], rng.normal(size=(12, 16))
    for k in range(90):
        v = base[k % 12] * rng.uniform(0.1, 9) + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.35, 1.5])
        rows.append((k, [float(np.float32(x)) for x in v]))
    rows += [(100 + k, rows[5][1]) for k in range(20)]
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [1.0, None] + [0.0] * 14), (204, [float("nan")] * 16), (205, [float("inf")] + [1.0] * 15),
             (None, rows[5][1]), (206, [1.0, 0.0]), (207, [2.0, 0.1]), (208, [3.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, mult int, cid int")
    got = [tuple(r) for r in E.near_duplicates(df, block=block).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


def test_suffix_bound_drops_no_pair():
    rng = np.random.default_rng(9)
    u = E._unit(rng.normal(size=(700, 24)) + np.repeat(rng.normal(size=(70, 24)) * 2, 10, axis=0))
    _, axes = np.linalg.eigh(u.T @ u)
    i, j = E.linked_pairs(u, u, axes[:, ::-1], 0.9, True)
    s = u @ u.T
    want = {(x, y) for x, y in zip(*np.nonzero(s >= 0.9)) if x < y}
    assert want and {(x, y) for x, y in zip(i, j) if s[x, y] >= 0.9} == want


def test_empty_and_unusable(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    got = E.near_duplicates(spark.createDataFrame([(1, None), (None, [1.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(["(1, 0, 1, True)", "(None, 0, None, False)"])
