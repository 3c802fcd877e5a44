"""Rules as a join against the same rules one by one; visits and the cooldown against plain walks, on keys that hold most rows."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from exposark.operators import advice, rules
from exposark.plans import sessions


def test_rules_as_a_join_are_the_rules_in_the_row(spark):
    kinds = ["email", "phone", "password", "person_name", "organization", "location", "aadhaar", "pan", "credit_card", "cvv", "dob", "author", "unknown_type"]
    rng = random.Random(4)
    sets = spark.createDataFrame([(i, rng.sample(kinds, rng.randint(0, 6))) for i in range(300)] + [(300, None), (301, []), (302, ["email", "email"])], "doc_id long, types array<string>")
    rows = sets.where("types IS NOT NULL").select("doc_id", F.explode_outer(advice.fired(F.col("types"))).alias("s")).where("s IS NOT NULL").select("doc_id", "s.*")
    assert sorted(map(tuple, rules.fired(sets, rules.scenario_rules(spark)).collect())) == sorted(map(tuple, rows.collect()))


def test_ten_thousand_rules(spark):
    rng = random.Random(5)
    kinds = [f"k{i}" for i in range(200)]
    table = [(i, f"r{i}", "LOW", rng.sample(kinds, rng.randint(1, 4)), rng.sample(kinds, 2), rng.sample(kinds, rng.randint(0, 1)), [rng.sample(kinds, 2)] if i % 5 == 0 else []) for i in range(10_000)]
    table += [(10_000, "nothing required", "LOW", [], ["k1"], [], []), (10_001, "never there", "LOW", ["k1", "absent"], [], [], []), (10_002, "twice", "LOW", ["k2", "k2"], [], [], [])]
    sets = [(i, ["k2", *rng.sample(kinds, 30)]) for i in range(60)]
    want = set()
    for i, own in sets:
        own = set(own)
        for _, name, _, need, _, absent, unless in table:
            if need and own.issuperset(need) and not own.intersection(absent) and not any(own.issuperset(u) for u in unless):
                want.add((i, name))
    own, every = spark.createDataFrame(sets, "doc_id long, types array<string>"), spark.createDataFrame(table, rules.SCHEMA)
    for counts in (None, rules.type_counts(own)):
        frame = rules.fired(own, every, counts=counts)
        got = [(r["doc_id"], r["scenario"]) for r in frame.collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    assert "Cartesian" not in frame._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in frame._jdf.queryExecution().executedPlan().toString()


def frames(n, seed):
    rng = random.Random(seed)
    rows, t = [], defaultdict(float)
    for i in range(n):
        key = 1 if rng.random() < 0.7 else rng.choice([2, 3, None])
        t[key] += rng.choice([0.0, 1.0, 5.0, 29.0, 30.0, 31.0, 3599.0, 3600.0, 3601.0, 9000.0])
        rows.append((key, i, t[key], rng.choice([5.0, 20.0, 50.0])))
    rng.shuffle(rows)
    return rows


def test_visits_and_cooldown_plainly(spark):
    rows = frames(800, 8)
    table = spark.createDataFrame(rows, "session_id long, frame_id long, t double, score double").select("session_id", "frame_id", F.timestamp_seconds("t").alias("ts"), "score")
    by = defaultdict(list)
    for key, frame, t, score in sorted(rows, key=lambda r: (r[2], r[1])):
        by[key].append((frame, t, score))
    visits, passed = [], []
    for key, all_rows in by.items():
        last = None
        for frame, t, score in all_rows:
            if last is None or t - last >= 3600:
                visits.append([key, t, t, 0, 0])
            visits[-1][2:] = [t, visits[-1][3] + 1, visits[-1][4] + (score >= 20)]
            last = t
        cool = float("-inf")
        for frame, t, score in all_rows:
            if score >= 20 and t - cool >= 30:
                passed.append((key, frame))
                cool = t
    got = sessions.visits(table, 3600).select("session_id", F.col("began").cast("double"), F.col("ended").cast("double"), "n_frames", "n_alerts").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(tuple(v)) for v in visits)
    cooled = sessions.with_cooldown(sessions.alerts(table)).collect()
    assert sorted(map(repr, map(tuple, cooled))) == sorted(map(repr, passed))
