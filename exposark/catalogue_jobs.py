"""Queries over batches of documents: files by type, totals over jobs, and the counts of a report."""

from __future__ import annotations

from pyspark.sql import functions as F

from exposark.catalogue import SCORES_SQL, in_rows
from exposark.functions import tables
from exposark.operators import doctype, score
from exposark.operators.score import lookup
from exposark.registry import query
from exposark.sources import corpus as C

PER_JOB = 10

JOBS_SQL = f"""{SCORES_SQL},
files AS (SELECT doc_id, doc_id // {PER_JOB} AS job_id, score, risk FROM leveled),
kinds AS (SELECT DISTINCT doc_id, type FROM findings),
job_types AS (SELECT job_id, type, count(*) AS n FROM kinds JOIN files USING (doc_id) GROUP BY ALL),
type_texts AS (SELECT job_id, string_agg(type || '=' || n, ', ' ORDER BY n DESC, type) AS type_files FROM job_types GROUP BY job_id),
jobs AS (SELECT job_id, count(*) AS n_files, count(*) FILTER (WHERE risk IN ('MEDIUM', 'HIGH', 'CRITICAL')) AS n_alerts, round(avg(score), 1) AS avg_score, max(score) AS max_score,
  arg_max(risk, CASE risk WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS highest_risk FROM files GROUP BY job_id)"""


def jobs(spark, sf_dir):
    """job_id, n_files, n_alerts, avg_score, max_score, highest_risk and types, a map of each type to the files that hold it, of every ten documents.

    A type counts once a file, in the row, so a job's types are sums of a dozen columns, however many files it has.
    """
    rows = score.with_row_score(in_rows(spark, sf_dir), "findings").withColumn("types", doctype.types_of(F.col("findings"))).withColumn("job_id", F.floor(F.col("doc_id") / PER_JOB))
    known = sorted(tables.DOCUMENT_WEIGHTS)
    worst = F.max(F.struct(lookup(F.col("risk"), tables.RISK_RANK, 0).alias("rank"), F.col("risk")))["risk"]
    counts = [F.count_if(F.array_contains("types", t)).alias(f"n_{t}") for t in known]
    out = rows.groupBy("job_id").agg(F.count("*").alias("n_files"), F.count_if(F.col("risk").isin("MEDIUM", "HIGH", "CRITICAL")).alias("n_alerts"), F.round(F.avg("score"), 1).alias("avg_score"), F.max("score").alias("max_score"), worst.alias("highest_risk"), *counts)
    pairs = F.filter(F.array(*(F.struct(F.lit(t).alias("key"), F.col(f"n_{t}").alias("value")) for t in known)), lambda p: p["value"] > 0)
    return out.select("job_id", "n_files", "n_alerts", "avg_score", "max_score", "highest_risk", F.map_from_entries(pairs).alias("types"))


def most_first(types):
    """A map of types to numbers as text, the most frequent first."""
    ordered = F.array_sort(F.transform(F.map_entries(types), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("type"))))
    return F.nullif(F.array_join(F.transform(ordered, lambda x: F.concat(x["type"], F.lit("="), (-x["n"]).cast("string"))), ", "), F.lit(""))


@query(f"WITH {JOBS_SQL} SELECT job_id, n_files, n_alerts, avg_score, max_score, highest_risk, type_files FROM jobs LEFT JOIN type_texts USING (job_id)")
def batch_job_types(spark, sf_dir):
    """Each job with how many of its files hold each type."""
    return jobs(spark, sf_dir).withColumn("type_files", most_first(F.col("types"))).drop("types")


@query(f"""WITH {JOBS_SQL}, every AS (SELECT type, sum(n)::BIGINT AS n FROM job_types GROUP BY type)
SELECT count(*) AS n_jobs, sum(n_files)::BIGINT AS n_files, sum(n_alerts)::BIGINT AS n_alerts, round(avg(avg_score), 1) AS avg_score, max(max_score) AS max_score,
  arg_max(highest_risk, CASE highest_risk WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS highest_risk, (SELECT string_agg(type || '=' || n, ', ' ORDER BY n DESC, type) FROM every) AS type_counts FROM jobs""")
def all_jobs_types(spark, sf_dir):
    """All jobs together: sums, the plain mean of the jobs' means, the highest level, and files by type."""
    rows = jobs(spark, sf_dir)
    known = sorted(tables.DOCUMENT_WEIGHTS)
    worst = F.max(F.struct(lookup(F.col("highest_risk"), tables.RISK_RANK, 0).alias("rank"), F.col("highest_risk").alias("risk")))["risk"]
    counts = [F.sum(F.coalesce(F.try_element_at("types", F.lit(t)), F.lit(0))).alias(f"n_{t}") for t in known]
    out = rows.agg(F.count("*").alias("n_jobs"), F.sum("n_files").alias("n_files"), F.sum("n_alerts").alias("n_alerts"), F.round(F.avg("avg_score"), 1).alias("avg_score"), F.max("max_score").alias("max_score"), worst.alias("highest_risk"), *counts)
    pairs = F.filter(F.array(*(F.struct(F.lit(t).alias("key"), F.col(f"n_{t}").alias("value")) for t in known)), lambda p: p["value"] > 0)
    return out.select("n_jobs", "n_files", "n_alerts", "avg_score", "max_score", "highest_risk", most_first(F.map_from_entries(pairs)).alias("type_counts"))


REPORTED = {"password": ("password",), "aadhaar": ("aadhaar",), "pan": ("pan_card",), "cards": ("credit_card", "cvv"), "otp": ("otp",), "dob": ("dob",), "email": ("email",), "phone": ("phone",), "faces": ("face_detected",), "id_doc": ("id_card_visible",)}


@query(f"""WITH {SCORES_SQL}, reported AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE type IN ({', '.join(repr(t) for t in types)})) AS {name}" for name, types in REPORTED.items())} FROM findings GROUP BY doc_id)
SELECT l.doc_id, CAST(floor(score) AS INT) AS score, risk, {", ".join(f"coalesce({name}, 0) AS {name}" for name in REPORTED)} FROM leveled l LEFT JOIN reported USING (doc_id)""")
def report_counts(spark, sf_dir):
    """The twelve numbers at the head of a document's report."""
    rows = score.with_row_score(in_rows(spark, sf_dir), "findings")
    n = lambda types: F.size(F.filter("findings", lambda f: f["type"].isin(*types))).cast("long")
    return rows.select("doc_id", F.floor("score").cast("int").alias("score"), "risk", *(n(types).alias(name) for name, types in REPORTED.items()))
