"""Monitor sessions and alerts as batch plans; the streams in exposark.streaming give the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ALERT_SCORE = 20
COOLDOWN_SECONDS = 30


def frames(scans: DataFrame) -> DataFrame:
    """Frames of sessions, one session an owner."""
    return scans.select(F.col("owner_id").alias("session_id"), F.col("scan_id").alias("frame_id"), F.col("upload_date").alias("ts"), "score", "risk")


def counters(f: DataFrame) -> DataFrame:
    return f.groupBy("session_id").agg(F.count("*").alias("n_frames"), F.count_if(F.col("score") >= ALERT_SCORE).alias("n_alerts"))


def alerts(f: DataFrame) -> DataFrame:
    return f.where(F.col("score") >= ALERT_SCORE)


def alerts_of(alert_rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Alerts of the given sessions."""
    return alert_rows.join(sessions, "session_id", "left_semi")


def islands(rows: DataFrame, gap: float, key: str = "session_id", tie: str = "frame_id", width: float = 3600.0) -> DataFrame:
    """rows (key, t in seconds, tie and others) with island: the time at which the run of rows began in which no two neighbours are so many seconds apart, by key.

    Rows are put in order within stretches of time; the last time of the stretch before, and the last beginning of an island before, come from a table of a row a stretch. So no key's rows pass through one task.
    """
    # the key in a struct is equal to itself where it is null too, and one partitioning serves windows and joins
    rows = rows.withColumn("__k", F.struct(key)).withColumn("__at", F.floor(F.col("t") / width))
    whole = Window.partitionBy("__k").orderBy("__at")
    ends = rows.groupBy("__k", "__at").agg(F.max("t").alias("__last")).withColumn("__before", F.lag("__last").over(whole)).drop("__last")
    inner = Window.partitionBy("__k", "__at").orderBy("t", tie)
    placed = rows.join(ends, ["__k", "__at"])
    far = F.coalesce(F.col("t") - F.coalesce(F.lag("t").over(inner), F.col("__before")) >= gap, F.lit(True))
    begun = placed.withColumn("__begin", F.when(far, F.col("t"))).drop("__before")
    carried = begun.groupBy("__k", "__at").agg(F.max("__begin").alias("__latest"))
    carried = carried.withColumn("__carry", F.max("__latest").over(whole.rowsBetween(Window.unboundedPreceding, -1))).drop("__latest")
    own = F.max("__begin").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return begun.join(carried, ["__k", "__at"]).withColumn("island", F.coalesce(own, F.col("__carry"))).drop("__k", "__at", "__begin", "__carry")


def visits(f: DataFrame, gap: float, key: str = "session_id") -> DataFrame:
    """Visits of each key, parted where nothing came for so many seconds or more: key, began, ended (times of the first and last frame), n_frames, n_alerts and max_score."""
    rows = f.where(F.col("ts").isNotNull()).select(key, "frame_id", "ts", "score", F.col("ts").cast("double").alias("t"))
    by = islands(rows, gap, key).groupBy(key, "island")
    out = by.agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("n_frames"), F.count_if(F.col("score") >= ALERT_SCORE).alias("n_alerts"), F.max("score").alias("max_score"))
    return out.drop("island")


def with_cooldown(alert_rows: DataFrame, seconds: int = COOLDOWN_SECONDS, key: str = "session_id") -> DataFrame:
    """Alerts at least so many seconds after the last one that passed, by key.

    An alert so long after the one before it always passes, so what lies between two such gaps is independent of the rest. Each of these
    islands is read as a stream in order of time, keeping only the last time that passed; no key's rows are held together.
    """
    rows = alert_rows.where(F.col("ts").isNotNull()).select(key, F.col("frame_id").cast("long").alias("frame_id"), F.col("ts").cast("double").alias("t"))
    parted = islands(rows, seconds, key)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, float("-inf")
        for batch in batches:
            keep = []
            for here, t in zip(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True), batch.column(2).to_pylist(), strict=True):
                if here != at:
                    at, last = here, float("-inf")
                keep.append(t - last >= seconds)
                if keep[-1]:
                    last = t
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    ordered = parted.select(key, "frame_id", "t", "island").repartition(key, "island").sortWithinPartitions(key, "island", "t", "frame_id")
    return ordered.mapInArrow(passed, StructType([rows.schema[key], rows.schema["frame_id"]]))
