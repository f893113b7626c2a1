"""The seconds of a key move packed, a row for each key of a batch and span."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa

from lodestone.operators import windows as WN


def test_a_batch_gives_a_row_for_each_key_and_span():
    r = random.Random(3)
    rows = [(r.choice(["a", None]), r.randint(-9 << 20, 9 << 20)) for _ in range(500)]
    made = list(WN._packed(iter([pa.RecordBatch.from_pydict({"k": pa.array([k for k, _ in rows], pa.string()), "accepted": pa.array([s for _, s in rows], pa.int64())})])))
    got = [(x["k"], x["_span"] * WN.SPAN + int(s)) for b in made for x in b.to_pylist() for s in np.cumsum(x["_gaps"])]
    assert sorted(map(str, got)) == sorted(map(str, set(rows)))
    assert sum(b.num_rows for b in made) == len({(k, s // WN.SPAN) for k, s in rows}) < 20


def test_seconds_of_many_batches_and_spans_are_walked_in_order(spark):
    r = random.Random(5)
    rows = [(r.choice("ab"), r.randint(0, 3), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randint(0, 3 * WN.SPAN))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "s string, k int, ts timestamp").repartition(9)
    got = sorted((x.s, x.k, x.accepted) for x in WN.once_per_ttl(df, ["s", "k"], "ts", 20000).collect())
    want, last = [], {}
    for s, k, ts in sorted(rows, key=lambda x: x[2]):
        sec = int(ts.replace(tzinfo=dt.timezone.utc).timestamp())
        if (s, k) not in last or sec >= last[s, k] + 20000:
            last[s, k] = sec
            want.append((s, k, sec))
    assert got == sorted(want) and len(got) > 1000
