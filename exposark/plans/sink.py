"""Where scans go: two tables, scans and findings, written by batch so that a batch that is written again replaces itself.

A batch is written in three steps: its scans, with their findings in the row, into the folder of its number; its findings, one a row, from what the first step wrote, so that
detection runs once; and its number into the table of commits. Each step replaces its folder as a whole. A batch counts once its number is committed, so readers see both tables' rows of
it or none, and a failure between two steps is mended by writing the batch again, which is what a stream does with the batch it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposark.operators import doctype
from exposark.operators import score as S
from exposark.operators import advice
from exposark.plans import store
from exposark.sources.corpus import ALLOWED, extension


class ScanSink:
    """The tables under a path. key: the scans' key, unique over all batches; commit numbers are of one stream or loader, named by origin."""

    def __init__(self, path: str, key: str = "scan_id", origin: str = "stream") -> None:
        self.path, self.key, self.origin = path.rstrip("/"), key, origin

    def _at(self, table: str, batch: int) -> str:
        return f"{self.path}/{table}/origin={self.origin}/batch={batch}"

    def write(self, scans: DataFrame, batch: int) -> None:
        """Write a batch of scans (key, findings and other columns); may be called again with the same batch. Fits foreachBatch."""
        spark = scans.sparkSession
        kept = store.stored_scans(scans) if {"extracted_text", "source"} <= set(scans.columns) else scans
        kept.write.mode("overwrite").parquet(self._at("scans", batch))
        written = spark.read.schema(kept.schema).parquet(self._at("scans", batch))
        store.stored_findings(written, self.key).write.mode("overwrite").parquet(self._at("findings", batch))
        sums = written.agg(F.count("*").alias("n_scans"), F.coalesce(F.sum(F.size("findings")), F.lit(0)).alias("n_findings"))
        sums.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(self._at("commits", batch))

    def commits(self, spark: SparkSession) -> DataFrame:
        """origin, batch, n_scans, n_findings and at of every whole batch."""
        return spark.read.option("basePath", f"{self.path}/commits").parquet(f"{self.path}/commits")

    def _whole(self, spark: SparkSession, table: str) -> DataFrame:
        rows = spark.read.option("basePath", f"{self.path}/{table}").parquet(f"{self.path}/{table}")
        return rows.join(self.commits(spark).select("origin", "batch"), ["origin", "batch"], "left_semi")

    def scans(self, spark: SparkSession) -> DataFrame:
        return self._whole(spark, "scans")

    def findings(self, spark: SparkSession) -> DataFrame:
        return self._whole(spark, "findings")

    def start(self, scans: DataFrame, checkpoint: str, seconds: int | None = None):
        """Run a stream of scans into the tables: over what is there, or every so many seconds."""
        writer = scans.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def file_scans(files: DataFrame, source: str = "file", reader: str | None = None) -> DataFrame:
    """Scans of files (path, text, error), batch or stream: scan_id (a hash of the path and the text), filename, source, extracted_text, findings, types, doc_type, score, risk, alert and error.

    A file with an error, or of an extension that the reader does not take, is a scan of score 0 without findings that says so; it is not left out.
    """
    taken = F.lit(True) if reader is None else extension(F.col("path")).isin(*ALLOWED[reader])
    error = F.coalesce(F.col("error"), F.when(~taken, "unsupported format"))
    rows = files.select("path", F.when(error.isNull(), F.col("text")).alias("text"), error.alias("error"))
    rows = doctype.with_final(rows)
    base = S.with_row_score(rows.drop("score", "risk"), "findings", "doc_type")
    scored = base.withColumn("agent", doctype.agent_score(F.col("score"), F.col("boost"), F.col("risk")))
    fine = F.col("error").isNull()
    return scored.select(
        F.xxhash64("path", F.coalesce("text", "error")).alias("scan_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.lit(source).alias("source"), F.col("text").alias("extracted_text"), "findings",
        F.array_sort("types").alias("types"), "doc_type", F.when(fine, F.col("agent.score")).otherwise(0.0).alias("score"), F.when(fine, F.col("agent.risk")).otherwise("LOW").alias("risk"), (fine & advice.worth_an_alert(F.col("agent.risk"))).alias("alert"), "error",
    )


def errors(scans: DataFrame) -> DataFrame:
    """filename and error of the scans that failed."""
    return scans.where(F.col("error").isNotNull()).select("filename", "error")
