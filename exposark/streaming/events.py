"""Monitors by event time: what arrives late or twice gives the rows that it would have given in order, and state ends with the watermark.

All take frames or alerts as streams with a column ts, and how late a row may come. They run on tables as well, where lateness means nothing (but for the cooldown, whose batch form is
``plans.sessions.with_cooldown``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from exposark.plans.sessions import ALERT_SCORE, COOLDOWN_SECONDS

LATE = "1 hour"
#: Alerts wait for the watermark in slots of so many seconds, which are what is in memory at once.
SLOT_SECONDS = 60
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that timers and maps of state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def once(frames: DataFrame, late: str = LATE, keys: tuple[str, ...] = ("session_id", "frame_id")) -> DataFrame:
    """frames without those that are there already: a frame that is sent again within the lateness is dropped, whatever its time says."""
    return frames.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def visits(frames: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    """Visits of each session, parted where nothing came for the gap; a visit is given once, when the watermark has passed its end."""
    by = frames.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w"))
    out = by.agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("n_frames"), F.count_if(F.col("score") >= ALERT_SCORE).alias("n_alerts"), F.max("score").alias("max_score"))
    return out.drop("w")


def sessions_with_alerts(sessions: DataFrame, alerts: DataFrame, late: str = LATE, longest: str = "1 day") -> DataFrame:
    """Each session (session_id, started_at) with each of its alerts (session_id, frame_id, ts, score) from its start on for as long as a session lasts; a session without any has one row of nulls, given
    when no alert of it can come any more."""
    left = sessions.withWatermark("started_at", late).select(F.col("session_id"), "started_at")
    right = alerts.withWatermark("ts", late).select(F.col("session_id").alias("of"), "frame_id", "ts", "score")
    near = (F.col("session_id") == F.col("of")) & (F.col("ts") >= F.col("started_at")) & (F.col("ts") <= F.col("started_at") + F.expr(f"INTERVAL {longest}"))
    return left.join(right, near, "left_outer").drop("of")


class Cooldown(StatefulProcessor):
    """Alerts in order of time, each at least so many seconds after the last one that passed. Rows wait in slots of time until the watermark has passed their slot; a slot is put in order,
    walked and forgotten. What stays of a key is one time, and nothing at all once it was quiet for a cooldown beyond the watermark."""

    def __init__(self, seconds: float) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t double")
        self.waiting = handle.getMapState("waiting", "slot long", "t array<double>, frame array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:  # one Arrow batch at a time
            for slot, own in part.groupby((part["t"] // SLOT_SECONDS).astype("int64")):
                slot = (int(slot),)
                times, frames = self.waiting.getValue(slot) if self.waiting.containsKey(slot) else ([], [])
                self.waiting.updateValue(slot, ([*times, *own["t"].tolist()], [*frames, *own["frame_id"].tolist()]))
                self.handle.registerTimer((slot[0] + 1) * SLOT_SECONDS * 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        last = self.last.get()[0] if self.last.exists() else float("-inf")
        passed = []
        for slot in sorted(k[0] for k in self.waiting.keys()):  # noqa: SIM118
            if (slot + 1) * SLOT_SECONDS * 1000 > until:
                break
            times, frames = self.waiting.getValue((slot,))
            for t, frame in sorted(zip(times, frames, strict=True)):
                if t - last >= self.seconds:
                    passed.append((key[0], frame, t))
                    last = t
            self.waiting.removeKey((slot,))
        if passed:
            self.last.update((last,))
            self.handle.registerTimer(int((last + self.seconds) // SLOT_SECONDS + 2) * SLOT_SECONDS * 1000)
        elif self.last.exists() and until >= (last + self.seconds) * 1000:
            self.last.clear()  # whatever comes next passes
        yield pd.DataFrame({"k": pd.Series([p[0] for p in passed], dtype="int64"), "frame_id": pd.Series([p[1] for p in passed], dtype="int64"), "t": pd.Series([p[2] for p in passed], dtype="float64")})


def cooled_alerts(frames: DataFrame, late: str = LATE, seconds: float = COOLDOWN_SECONDS, everywhere: bool = False) -> DataFrame:
    """session_id (0 for all), frame_id and ts of the alerts that pass a cooldown, by session or, everywhere, over all sessions, which is one key and so one task: meant for what one person is shown.

    The rows are those of ``with_cooldown`` over the same alerts in order, whatever the order of arrival within the lateness.
    """
    alerts = frames.where(F.col("score") >= ALERT_SCORE).withWatermark("ts", late)
    key = F.lit(0).cast("long") if everywhere else F.coalesce(F.col("session_id").cast("long"), F.lit(-1).cast("long"))
    rows = alerts.select(key.alias("k"), F.col("frame_id").cast("long").alias("frame_id"), "ts", F.col("ts").cast("double").alias("t"))
    out = rows.groupBy("k").transformWithStateInPandas(statefulProcessor=Cooldown(seconds), outputStructType="k long, frame_id long, t double", outputMode="Append", timeMode="EventTime")
    return out.select(F.col("k").alias("session_id"), "frame_id", F.timestamp_seconds("t").alias("ts"))
