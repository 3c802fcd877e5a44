"""Monitors as structured streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from exposark.operators import advice, doctype
from exposark.operators import score as S
from exposark.plans.sessions import ALERT_SCORE, COOLDOWN_SECONDS
from exposark.sources.corpus import ALLOWED, extension


#: A session's state is dropped when nothing came for so long.
FORGET_AFTER_MS = 24 * 3600 * 1000
#: Events that the log shows, newest first.
SHOWN = 20


def frame_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Frames as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def text_arrivals(spark: SparkSession, path: str) -> DataFrame:
    """Text files as they arrive in a folder; not in folders below it."""
    return spark.readStream.text(path, wholetext=True, recursiveFileLookup=False).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def session_counters(frames: DataFrame) -> DataFrame:
    """Running counts of frames and alerts by session; for update or complete mode."""
    return frames.groupBy("session_id").agg(F.count("*").alias("n_frames"), F.count_if(F.col("score") >= ALERT_SCORE).alias("n_alerts"))


def cooled_alerts(frames: DataFrame, seconds: int = COOLDOWN_SECONDS) -> DataFrame:
    """Alerts at least so many seconds after the last one that passed, by session; the state is one time a session.

    Rows of one trigger are taken in order of time; a row older than the last alert that passed is dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # nothing came for so long that whatever comes next passes
            state.remove()
            return
        last = state.get[0] if state.exists else float("-inf")
        rows = pd.concat([b[["ts", "frame_id"]] for b in batches]).sort_values(["ts", "frame_id"])
        passed = []
        for frame, ts in zip(rows["frame_id"], rows["ts"], strict=True):
            t = ts.timestamp()
            if t - last >= seconds:
                passed.append((key[0], frame))
                last = t
        state.update((last,))
        state.setTimeoutDuration(FORGET_AFTER_MS)
        yield pd.DataFrame(passed, columns=["session_id", "frame_id"])

    alerts = frames.where(F.col("score") >= ALERT_SCORE)
    return alerts.groupBy("session_id").applyInPandasWithState(step, "session_id long, frame_id long", "last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Run a stream over what is there, into Parquet files, with a checkpoint to go on from."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def file_events(arrivals: DataFrame) -> DataFrame:
    """Events of files as they arrive: path, name, score, risk, types, alert and at. arrivals: path, text; files that the agent does not read are left out.

    A file is scanned by its text as an upload is; an alert is due for levels that are worth one.
    """
    rows = arrivals.where(extension(F.col("path")).isin(*ALLOWED["agent"]))
    rows = doctype.with_final(rows)
    base = S.with_row_score(rows.drop("score", "risk"), "findings", "doc_type")
    scored = base.withColumn("agent", doctype.agent_score(F.col("score"), F.col("boost"), F.col("risk")))
    return scored.select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("agent.score").alias("score"), F.col("agent.risk").alias("risk"), F.array_sort("types").alias("types"), advice.worth_an_alert(F.col("agent.risk")).alias("alert"), F.current_timestamp().alias("at")
    )


def event_log(spark: SparkSession, path: str, shown: int = SHOWN) -> DataFrame:
    """The newest events of a log, newest first."""
    return spark.read.parquet(path).orderBy(F.desc("at"), "path").limit(shown)


def event_counts(spark: SparkSession, path: str) -> DataFrame:
    """How many files a log has, and how many of them were worth an alert."""
    return spark.read.parquet(path).agg(F.count("*").alias("total_scanned"), F.count_if("alert").alias("total_alerts"))


def live_feed(alerts: DataFrame, most: int = 6) -> DataFrame:
    """The newest alerts of a monitor."""
    return alerts.orderBy(F.desc("ts"), F.desc("frame_id")).limit(most)


class Watch:
    """A watched folder: started, stopped and started again it goes on where it was, as the checkpoint has what was read. Files that arrive while it is stopped are read later, none twice."""

    def __init__(self, spark: SparkSession, folder: str, log: str, checkpoint: str) -> None:
        self.spark, self.folder, self.log, self.checkpoint = spark, folder, log, checkpoint
        self.running = None

    def start(self, seconds: int | None = None):
        """Read what is there and stop, or look again after so many seconds."""
        writer = file_events(text_arrivals(self.spark, self.folder)).writeStream.format("parquet").option("path", self.log).option("checkpointLocation", self.checkpoint).outputMode("append")
        self.running = (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()
        return self.running

    def stop(self) -> None:
        if self.running is not None:
            self.running.stop()
            self.running = None
