"""Scans and findings as tables: what is stored of them, deletions with what hangs on them, and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exposark.operators.advice import lookup

#: Characters of a text that a scan of a source keeps, characters of a finding, and findings of a scan.
TEXT_KEPT = {"batch": 2000, "metadata": 2000, "social": 5000, "url": 10_000}
VALUE_KEPT = 500
FINDINGS_KEPT = 60


def kept_text(text: Column, source: Column) -> Column:
    """The part of a text that a source's scan stores; all of it for other sources."""
    most = lookup(source, TEXT_KEPT)
    return F.when(most.isNull(), text).otherwise(F.substring(text, F.lit(1), most))


def stored_scans(scans: DataFrame) -> DataFrame:
    """scans as stored: extracted_text cut by source."""
    return scans.withColumn("extracted_text", kept_text(F.col("extracted_text"), F.col("source")))


def stored_findings(scans: DataFrame, key: str = "scan_id") -> DataFrame:
    """key, position, type and value of each scan's findings as stored. scans: key, findings, an array of (type, value)."""
    rows = scans.select(key, F.posexplode(F.slice("findings", 1, FINDINGS_KEPT)).alias("position", "f"))
    return rows.select(key, "position", "f.type", F.substring("f.value", 1, VALUE_KEPT).alias("value"))


def delete(parents: DataFrame, children: DataFrame, gone: Column, key: str = "scan_id") -> tuple[DataFrame, DataFrame]:
    """What is left of parents and of their children once the parents for which gone holds are deleted. A test that is null keeps the row."""
    test = F.coalesce(gone, F.lit(False))
    return parents.where(~test), children.join(parents.where(test).select(key), key, "left_anti")


def purged(parents: DataFrame, children: DataFrame, pattern: str, least: float = 75, key: str = "scan_id") -> tuple[DataFrame, DataFrame]:
    """Deletion of the scans whose source is like a pattern, in which _ stands for any character, and whose score is at least so high."""
    return delete(parents, children, F.col("source").like(pattern) & (F.col("score") >= least), key)


def without_prefix(scans: DataFrame) -> DataFrame:
    """scans without the old type prefix in their texts; where a scan has no label, the prefix gives it."""
    pattern = r"^\[Document Type:\s*(.+?)\]\n?"
    text, label = F.col("extracted_text"), F.col("label")
    named = F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 1)))
    return scans.withColumn("label", F.coalesce(F.nullif(label, F.lit("")), named, label)).withColumn("extracted_text", F.regexp_replace(text, pattern, ""))


def write_by_time(scans: DataFrame, path: str, rows_per_group: int = 100_000) -> None:
    """scans in folders by day of upload_date, each file sorted by owner, with Bloom filters on scan_id: a tenant's days read few files, a look-up few row groups."""
    days = scans.withColumn("day", F.to_date("upload_date"))
    dealt = days.repartitionByRange("day", "owner_id").sortWithinPartitions("day", "owner_id", "upload_date")
    writer = dealt.write.mode("overwrite").partitionBy("day").option("parquet.bloom.filter.enabled#scan_id", "true").option("parquet.bloom.filter.expected.ndv#scan_id", str(rows_per_group))
    writer.option("parquet.block.row.count.limit", str(rows_per_group)).parquet(path)


def of_owner(spark: SparkSession, path: str, owner: int, since: str, until: str) -> DataFrame:
    """A tenant's scans of some days: folders are chosen by day, row groups by owner."""
    return spark.read.parquet(path).where(F.col("day").between(F.to_date(F.lit(since)), F.to_date(F.lit(until))) & (F.col("owner_id") == owner))


def by_ids(spark: SparkSession, path: str, wanted: list[tuple[int, int]]) -> DataFrame:
    """The scans of a few (scan_id, owner_id), each by its own owner alone: the ids reach the Bloom filters."""
    pair = F.struct("scan_id", "owner_id").isin([F.struct(F.lit(s).cast("long"), F.lit(o).cast("long")) for s, o in wanted])
    return spark.read.parquet(path).where(F.col("scan_id").isin(*(s for s, _ in wanted)) & pair)


def looked_up(scans: DataFrame, wanted: DataFrame) -> DataFrame:
    """The scans that are asked for, each by its own owner alone. wanted: scan_id, owner_id."""
    return scans.join(wanted.distinct(), ["scan_id", "owner_id"], "left_semi")


def sessions_with_alerts(sessions: DataFrame, alerts: DataFrame, key: str = "session_id") -> DataFrame:
    """Every session with its alerts' number, highest score and time of the last; zero and nulls where there are none."""
    of = alerts.groupBy(key).agg(F.count("*").alias("n_alerts"), F.max("score").alias("max_score"), F.max("ts").alias("last_alert"))
    return sessions.join(of, key, "left").withColumn("n_alerts", F.coalesce("n_alerts", F.lit(0)))
