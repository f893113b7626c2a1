"""Keys of pairs with swaps are joined by a shuffle: they never pass through the driver."""

import random

from lodestone.operators import vocab as V


def test_keys_are_no_broadcast(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(3, 7))) for _ in range(60)]
    w = spark.createDataFrame([(x,) for x in words[:20]], "word string")
    t = spark.createDataFrame([(x,) for x in words], "term string")
    met = V.near_terms(w, t, 2, loose=True)
    got = [(r.word, r.term) for r in met.collect()]
    assert len(got) == len(set(got))
    assert {(x, x) for x in words[:20]} <= set(got)
    plan = met._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Broadcast" not in plan and "ShuffledHashJoin" in plan
