"""A pair of blocks is compared in bounded memory."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from lodestone.operators import retrieve as RT


def _blocks(nq, ni, width=8):
    rng = np.random.default_rng(3)
    make = lambda n: list(rng.integers(-3, 4, (n, width)).astype(np.float32))  # noqa: E731  # few values: ties and zero vectors
    return (pd.DataFrame({"qid": [f"v{i}" for i in range(nq)], "qvec": make(nq)}), pd.DataFrame({"iid": [f"v{i}" for i in range(ni)], "ivec": make(ni)}))


def test_a_full_pair_of_blocks_stays_small():
    a, b = _blocks(RT.QUERY_BLOCK, RT.ITEM_BLOCK)
    tracemalloc.start()
    got = RT.block_topk(a, b, 10, exclude_self=True)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 200
    assert len(got) == 10 * len(a)


@pytest.mark.parametrize("k,lo", [(5, None), (None, 0.7), (500, None)])
def test_slices_give_what_one_pass_gives(monkeypatch, k, lo):
    a, b = _blocks(300, 400)
    parts = RT.block_topk(a, b, k, True, lo)
    monkeypatch.setattr(RT, "QUERY_SLICE", 10**6)
    whole = RT.block_topk(a, b, k, True, lo)
    pd.testing.assert_frame_equal(parts.reset_index(drop=True), whole.reset_index(drop=True))
    assert RT.block_topk(a.iloc[:0], b, k).empty
