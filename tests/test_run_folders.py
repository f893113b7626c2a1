"""A key whose events fit in memory makes no folder."""

import pandas as pd

from lodestone.streaming import streams as ST


def test_small_keys_make_no_folder(monkeypatch):
    made = []
    real = ST.tempfile.TemporaryDirectory
    monkeypatch.setattr(ST.tempfile, "TemporaryDirectory", lambda **k: made.append(1) or real(**k))
    frame = pd.DataFrame({"ts": pd.to_datetime([3000, 1000, 2000, 1000], unit="ms"), "event_id": [1, 2, 3, 1]})
    want = [(1000, 1), (1000, 2), (2000, 3), (3000, 1)]
    for rows, folders in ((None, 0), (2, 1)):
        got = [(int(r["ms"]), int(r["id"])) for part in ST._in_order(iter([frame[:2], frame[2:]]), rows) for r in part]
        assert got == want and len(made) == folders
    assert not list(ST._in_order(iter([])))
