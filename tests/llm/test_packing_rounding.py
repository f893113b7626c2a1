"""What rounding leaves for best fit does not grow with the corpus."""

import numpy as np

from lodestone.llm import packing as K


def test_leftover_is_bounded_by_the_patterns(monkeypatch):
    left, fit = [], K.best_fit
    monkeypatch.setattr(K, "best_fit", lambda items, units: left.append(int(items.sum())) or fit(items, units))
    for seed in range(12):
        r = np.random.default_rng(seed)
        units = 64
        shape = r.dirichlet(np.full(units, 0.5))
        for n in (10**4, 10**8):
            demand = np.concatenate([[0], np.floor(shape * n)]).astype(np.int64)
            got = K.whole_patterns(demand, units)
            assert (sum(k * p for p, k in got) == demand).all()
            assert all(k > 0 and p @ np.arange(units + 1) <= units for p, k in got)
            assert left[-1] <= 8 * units, (seed, n, left[-1])
