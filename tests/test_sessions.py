"""The batch cooldown against a plain walk over the alerts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from exposark.plans import sessions


def test_cooldown_is_a_plain_walk_and_collects_no_arrays(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), i, rng.randrange(4000) * 1.5) for i in range(3000)]
    rows += [(4, 10_000 + i, float(t)) for i, t in enumerate([0, 29.5, 30, 30, 59, 60, 200, 230, 259.999])]
    rows += [(4, 20_000, None)]
    want, last = [], {}
    for s, i, t in sorted((x for x in rows if x[2] is not None), key=lambda x: (x[2], x[1])):
        if t - last.get(s, float("-inf")) >= sessions.COOLDOWN_SECONDS:
            want.append((s, i))
            last[s] = t
    df = spark.createDataFrame(rows, "session_id long, frame_id long, t double").select("session_id", "frame_id", F.col("t").cast("timestamp").alias("ts"))
    out = sessions.with_cooldown(df)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert "collect_list" not in out._jdf.queryExecution().toString()
