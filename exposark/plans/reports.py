"""Data of the reports: each is a plan over scans or findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposark.functions import tables
from exposark.operators import score
from exposark.operators.score import lookup


def score_history(scans: DataFrame) -> DataFrame:
    return scans.agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 1).alias("avg_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"), F.count_if(F.col("risk") == "CRITICAL").alias("n_critical"), F.count_if(F.col("risk") == "HIGH").alias("n_high")
    )


def batch_report(scans: DataFrame, key: str = "job_id") -> DataFrame:
    level = lambda x: F.count_if(F.col("risk") == x).alias(f"n_{x.lower()}")
    return scans.groupBy(key).agg(F.count("*").alias("n_files"), F.sum("n_findings").alias("n_findings"), F.round(F.avg("score"), 1).alias("avg_score"), *(level(x) for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW")))


def sensitive_summary(findings: DataFrame, most: int = 10) -> DataFrame:
    """By type: how many values, the first ones in order, and how many more there are. Only the first ones of a type are gathered."""
    w = Window.partitionBy("type").orderBy("value")
    first = findings.select("type", "value", F.row_number().over(w).alias("k")).where(F.col("k") <= most)
    values = first.groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("first_values"))
    counts = findings.groupBy("type").agg(F.count("*").alias("n"))
    return counts.join(values, "type").select("type", "n", F.array_join("first_values", " | ").alias("first_values"), F.greatest(F.col("n") - most, F.lit(0)).alias("n_more"))


def pooled_scores(findings: DataFrame, key: str) -> DataFrame:
    """key, combined_score and risk of all findings of a key taken together, as if of one document. findings: key, type."""
    rows = score.scores_of(findings, key)
    return rows.select(key, F.col("score").alias("combined_score"), score.risk(F.col("score"), "document", F.col("hard")).alias("risk"))


def friendly_types(types: Column, most: int = 3) -> Column:
    """Names of the first types, and how many more there are."""
    names = F.transform(F.slice(types, 1, most), lambda t: F.coalesce(lookup(t, tables.TYPE_LABELS), F.initcap(F.replace(t, F.lit("_"), F.lit(" ")))))
    more = F.size(types) - most
    return F.when(more > 0, F.concat(F.array_join(names, ", "), F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(F.array_join(names, ", "))


def source_label(source: Column) -> Column:
    known = F.coalesce(lookup(source, tables.SOURCE_LABELS), F.nullif(source, F.lit("")), F.lit("Unknown"))
    return F.when(F.startswith(source, F.lit("metadata")), "Metadata Scanner").otherwise(known)


def source_colour(source: Column) -> Column:
    return F.coalesce(lookup(source, tables.SOURCE_COLOURS), F.lit(tables.SOURCE_COLOUR_DEFAULT))


def first_and_latest(scans: DataFrame) -> DataFrame:
    """By owner the first and the latest scan in time."""
    at = F.struct("upload_date", "scan_id")
    return scans.groupBy("owner_id").agg(F.min_by("scan_id", at).alias("first_scan"), F.max_by("scan_id", at).alias("latest_scan"), F.max_by("score", at).alias("latest_score"))


def normalised(scans: DataFrame) -> DataFrame:
    """scan_id and the score between the lowest (0) and the highest (1) of all; one half where all are equal."""
    ends = scans.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    rows = scans.join(F.broadcast(ends), F.lit(True))  # one row
    return rows.select("scan_id", F.round(F.when(F.col("high") == F.col("low"), 0.5).otherwise((F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))), 6).alias("height"))


def metadata_text(fields: DataFrame, key: str = "file_id") -> DataFrame:
    """key and the fields of a file as lines, sensitive ones first; a file has few fields. fields: as metadata_fields gives them."""
    line = F.concat("label", F.lit(": "), "value")
    part = lambda test: F.array_join(F.array_sort(F.collect_list(F.when(test, line))), "\n")
    return fields.groupBy(key).agg(F.concat(F.lit("Sensitive:\n"), part(F.col("risk").isNotNull()), F.lit("\nOther:\n"), part(F.col("risk").isNull())).alias("text"))
