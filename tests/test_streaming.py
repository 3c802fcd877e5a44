from __future__ import annotations

from pyspark.sql import functions as F

from exposark.plans import sessions
from exposark.streaming import monitor

SCHEMA = "session_id long, frame_id long, ts timestamp, score double"


def write_frames(spark, path):
    times = [0, 10, 29, 30, 45, 61]
    rows = [(s, 100 * s + i, t, 50.0 if t != 45 or s else 5.0) for s in (1, 2) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "session_id long, frame_id long, t long, score double").select("session_id", "frame_id", F.timestamp_seconds("t").alias("ts"), "score")
    df.coalesce(1).write.parquet(path)
    return df


def test_cooldown_stream_equals_batch(spark, tmp_path):
    batch = write_frames(spark, str(tmp_path / "in"))
    stream = monitor.cooled_alerts(monitor.frame_stream(spark, str(tmp_path / "in"), SCHEMA))
    monitor.to_table(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [(1, 100), (1, 103), (1, 105), (2, 200), (2, 203), (2, 205)]
    assert got == sorted(map(tuple, sessions.with_cooldown(sessions.alerts(batch)).collect()))


def test_counters_stream_equals_batch(spark, tmp_path):
    batch = write_frames(spark, str(tmp_path / "in"))
    stream = monitor.session_counters(monitor.frame_stream(spark, str(tmp_path / "in"), SCHEMA))
    q = stream.writeStream.format("memory").queryName("counters").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counters").collect())) == sorted(map(tuple, sessions.counters(batch).collect()))


def test_text_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\ny")
    q = monitor.text_arrivals(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrivals").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["text"] for r in spark.table("arrivals").collect()] == ["x\ny"]
