"""Streams by event time: rows that come in another order, late or twice, give what the batch plans give over the same rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from exposark.plans import sessions
from exposark.streaming import events

SCHEMA = "session_id long, frame_id long, ts timestamp, score double"
LAST = 10**6


@pytest.fixture
def replay(spark, tmp_path):
    """A function that writes rows (session, frame, seconds, score) shuffled within the lateness into files of a batch each, with an end that moves the watermark beyond them all, and streams them."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    events.use_rocksdb(spark)

    def run(rows, name, files=4):
        rows = sorted(rows, key=lambda r: r[2])
        rng = random.Random(1)
        size = -(-len(rows) // files)
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        for a, b in zip(parts, parts[1:], strict=False):  # every other row of the first part moves on to the last, the others one part forward
            for i in range(0, min(len(a), len(b)), 2):
                a[i], b[i] = b[i], a[i]
        for i, part in enumerate([*parts, [(0, LAST, LAST, 0.0), (0, LAST + 1, LAST, 99.0)], [(0, LAST + 2, LAST + 90_000, 99.0)], [(0, LAST + 3, LAST + 180_000, 0.0), (0, LAST + 4, LAST + 180_000, 99.0)]]):
            rng.shuffle(part)
            frame = spark.createDataFrame([(a, b, float(t), s) for a, b, t, s in part], "session_id long, frame_id long, t double, score double")
            frame.select("session_id", "frame_id", F.timestamp_seconds("t").alias("ts"), "score").coalesce(1).write.mode("append").parquet(str(tmp_path / name / f"{i:03}"))
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*"))

    yield run
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def taken(spark, stream, tmp_path, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"check_{name}")).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.table(name), query.lastProgress


def made(n, seed):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2, 3]), i, i * 7 + rng.randint(0, 3), rng.choice([5.0, 50.0])) for i in range(n)]


def as_table(spark, rows):
    return spark.createDataFrame([(a, b, float(t), s) for a, b, t, s in rows], "session_id long, frame_id long, t double, score double").select("session_id", "frame_id", F.timestamp_seconds("t").alias("ts"), "score")


@pytest.mark.parametrize("everywhere", [False, True])
def test_cooldown_by_event_time_is_the_batch_plan(spark, tmp_path, replay, everywhere):
    rows = made(300, 2)
    out, progress = taken(spark, events.cooled_alerts(replay(rows, "in"), everywhere=everywhere), tmp_path, f"cooled_{everywhere}")
    got = sorted((r["session_id"], r["frame_id"]) for r in out.collect() if r["frame_id"] < LAST)
    table = as_table(spark, [(0 if everywhere else a, b, t, s) for a, b, t, s in rows])
    assert got == sorted(map(tuple, sessions.with_cooldown(sessions.alerts(table)).collect())) and got
    assert sum(o["numRowsTotal"] for o in progress["stateOperators"]) < 20  # slots and times that the watermark passed are gone


def test_visits_by_event_time_are_the_batch_plan(spark, tmp_path, replay):
    rows = [(1 + (i % 3 == 0), i, 10_000 + i * 61 + (i // 40) * 5000, 50.0 if i % 4 else 1.0) for i in range(200)]
    out, _ = taken(spark, events.visits(replay(rows, "in"), "40 minutes", late="12 hours"), tmp_path, "visits")
    got = sorted(map(repr, map(tuple, out.where("session_id > 0").collect())))
    assert got == sorted(map(repr, map(tuple, sessions.visits(as_table(spark, rows), 2400).select(out.columns).collect())))


def test_frames_sent_twice_count_once(spark, tmp_path, replay):
    rows = made(100, 3)
    out, progress = taken(spark, events.once(replay([*rows, *rows[::3]], "in")), tmp_path, "once")
    assert sorted(r["frame_id"] for r in out.where(f"frame_id < {LAST}").collect()) == list(range(100))


def test_sessions_without_alerts_get_their_row(spark, tmp_path, replay):
    alerts = replay([(1, 10, 100, 50.0), (1, 11, 4000, 50.0), (2, 12, 90_000, 50.0), (4, 13, 50, 50.0)], "alerts", files=2)
    starts = replay([(1, 1, 60, 0.0), (2, 2, 60, 0.0), (3, 3, 70, 0.0)], "starts", files=1).select("session_id", F.col("ts").alias("started_at"))
    out, _ = taken(spark, events.sessions_with_alerts(starts, alerts), tmp_path, "joined")
    assert sorted((r["session_id"], r["frame_id"] or 0) for r in out.where("session_id > 0").collect()) == [(1, 10), (1, 11), (2, 0), (3, 0)]
