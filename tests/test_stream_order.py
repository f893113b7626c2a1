"""Events of a hot key are put in order by runs, without holding the key whole."""

import numpy as np
import pandas as pd

from lodestone.streaming import streams as ST


def frames(n, size, seed=5):
    r = np.random.default_rng(seed)
    d = pd.DataFrame({"ts": pd.to_datetime(r.integers(0, n // 3, n), unit="ms"), "event_id": r.permutation(n), "kind": r.integers(0, 4, n).astype("int8")})
    return [d[k:k + size] for k in range(0, n, size)]


def test_runs_give_the_order_of_the_whole():
    for n, size, rows in ((1000, 37, 100), (1000, 37, 10000), (999, 999, 10), (5, 1, 1), (1000, 100, 500)):
        parts = frames(n, size)
        d = pd.concat(parts).sort_values(["ts", "event_id"], kind="stable")
        want = list(zip(d.ts.astype("datetime64[ms]").astype("int64"), d.event_id, d.kind))
        got = list(ST._in_order(iter(parts), rows))
        assert [tuple(map(int, x)) for g in got for x in g] == [tuple(map(int, x)) for x in want]
        assert max(map(len, got)) <= max(rows, n // max(rows, 1) + size + 1)
    assert list(ST._in_order(iter([]))) == []
