"""Scores of findings and the levels of the risk profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposark.functions import tables
from exposark.functions import text as T


def lookup(key: Column, table: dict, default=None) -> Column:
    """A fixed table as a conditional; null where the key is absent and there is no default."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def ladder(weight: Column, n: Column, second: float = 0.7, more: float = 0.5) -> Column:
    """Points for n findings of a type: the first in full, the second less, each further one less still."""
    return F.when(n == 1, weight * 1.0).when(n == 2, weight * (1 + second)).otherwise(weight * (1 + second) + weight * more * (n - 2))


def risk(score: Column, profile: str, hard: Column | None = None) -> Column:
    """The level of a score in a profile."""
    rules = tables.RISK_PROFILES[profile]
    out = None
    for level in ("CRITICAL", "HIGH", "MEDIUM", "LOW"):
        if level in rules:
            least, also = rules[level]
            test = score > least if also == "over" else score >= least
            if also == "hard":
                test = test & (F.coalesce(hard, F.lit(False)) if hard is not None else F.lit(False))
            out = F.when(test, level) if out is None else out.when(test, level)
    return out.otherwise(rules["else"])


def type_counts(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    return findings.groupBy(key, "type").agg(F.count("*").alias("n"))


def with_row_score(docs: DataFrame, findings: str, doc_type: str | None = None) -> DataFrame:
    """docs with score and risk of an array of findings in the row: all within the row, without a shuffle. Soft types count SOFT_CAP at most in calm documents, which those of no stated type are."""
    kinds = F.array_distinct(F.transform(F.col(findings), lambda f: f["type"]))
    count = lambda k: F.size(F.filter(F.col(findings), lambda f: f["type"] == k))
    weighed = F.transform(kinds, lambda k: F.struct(k.alias("type"), lookup(k, tables.DOCUMENT_WEIGHTS, tables.DOCUMENT_DEFAULT).cast("double").alias("weight"), count(k).alias("n")))
    rows = docs.withColumn("__points", F.transform(weighed, lambda x: F.struct(x["type"].alias("type"), ladder(x["weight"], x["n"]).alias("points"))))
    total = lambda keep: F.aggregate(F.filter("__points", keep), F.lit(0.0), lambda a, x: a + x["points"])
    rows = rows.withColumn("__soft", total(lambda x: x["type"].isin(*tables.SOFT_TYPES))).withColumn("__firm", total(lambda x: ~x["type"].isin(*tables.SOFT_TYPES)))
    rows = rows.withColumn("__hard", F.exists("__points", lambda x: x["type"].isin(*tables.HARD_TYPES)))
    cap = F.least("__soft", F.lit(float(tables.SOFT_CAP)))
    capped = cap if doc_type is None else F.when(F.col(doc_type).isin(*tables.CALM_DOCUMENTS), cap).otherwise(F.col("__soft"))
    raw = F.least(F.round(capped + F.col("__firm"), 1), F.lit(100.0))
    rows = rows.withColumn("score", F.when(F.col("__hard"), F.greatest(raw, F.lit(40.0))).otherwise(raw))
    return rows.withColumn("risk", risk(F.col("score"), "document", F.col("__hard"))).drop("__points", "__soft", "__firm", "__hard")


def scores_of(findings: DataFrame, key: str = "doc_id", doc_type: str = "generic") -> DataFrame:
    """key, score, and whether there is a hard type, of every key that has findings (key, type). Both groupings share one shuffle by key and type after sums in each task."""
    points = ladder(lookup(F.col("type"), tables.DOCUMENT_WEIGHTS, tables.DOCUMENT_DEFAULT), F.col("n"))
    typed = type_counts(findings, key).withColumn("points", points)
    soft, hard = F.col("type").isin(*tables.SOFT_TYPES), F.col("type").isin(*tables.HARD_TYPES)
    sums = typed.groupBy(key).agg(F.sum(F.when(soft, F.col("points")).otherwise(0.0)).alias("soft"), F.sum(F.when(~soft, F.col("points")).otherwise(0.0)).alias("firm"), F.max(hard).alias("hard"))
    capped = F.least(F.col("soft"), F.lit(float(tables.SOFT_CAP))) if doc_type in tables.CALM_DOCUMENTS else F.col("soft")
    raw = F.least(F.round(capped + F.col("firm"), 1), F.lit(100.0))
    return sums.select(key, F.when(F.col("hard"), F.greatest(raw, F.lit(40.0))).otherwise(raw).alias("score"), "hard")


def document_scores(docs: DataFrame, findings: DataFrame, key: str = "doc_id", doc_type: str = "generic") -> DataFrame:
    """key, score and risk of every document by findings in rows of their own; those without findings score 0."""
    out = docs.select(key).join(scores_of(findings, key, doc_type), key, "left")
    score = F.coalesce("score", F.lit(0.0))
    return out.select(key, score.alias("score"), risk(score, "document", F.col("hard")).alias("risk"))


def url_scores(pages: DataFrame, findings: DataFrame, key: str = "page_id") -> DataFrame:
    """key, score and risk of every page; types without a weight do not count."""
    typed = type_counts(findings, key).withColumn("points", ladder(lookup(F.col("type"), tables.URL_WEIGHTS, 0), F.col("n"), 0.5, 0.3))
    sums = typed.groupBy(key).agg(F.least(F.round(F.sum("points"), 1), F.lit(100.0)).alias("score"))
    score = F.coalesce("score", F.lit(0.0))
    return pages.select(key).join(sums, key, "left").select(key, score.alias("score"), risk(score, "url").alias("risk"))


def with_url_score(pages: DataFrame, findings: str = "findings") -> DataFrame:
    """pages with score and risk by the findings in their rows; types without a weight do not count."""
    kinds = F.array_distinct(F.transform(F.col(findings), lambda f: f["type"]))
    points = lambda t: ladder(lookup(t, tables.URL_WEIGHTS, 0), F.size(F.filter(F.col(findings), lambda f: f["type"] == t)), 0.5, 0.3)
    rows = pages.withColumn("score", F.least(F.round(F.aggregate(kinds, F.lit(0.0), lambda a, t: a + points(t)), 1), F.lit(100.0)))
    return rows.withColumn("risk", risk(F.col("score"), "url"))


def social_score(contacts: Column, fields: Column, exposure: Column) -> Column:
    """Score of a public profile: what its text holds (contacts, 100 at most), what its fields expose, both arrays of (type, value), and how the profile exposes its owner.

    Addresses and phones of businesses count half, a personal exposure adds 10, and a profile of nobody stays at 11 or below.
    """
    sum_of = lambda found: F.aggregate(found, F.lit(0.0), lambda a, f: a + lookup(f["type"], tables.SOCIAL_WEIGHTS, 3))
    halves = F.aggregate(F.filter(contacts, lambda f: f["type"].isin("email", "phone")), F.lit(0.0), lambda a, f: a + lookup(f["type"], tables.SOCIAL_WEIGHTS, 0) * 0.5)
    total = F.least(F.round(sum_of(contacts), 1), F.lit(100.0)) + sum_of(fields)
    moved = F.when(exposure == "public_business", total - halves).when(exposure == "personal_exposure", total + 10).when(exposure == "anonymous", F.least(total, F.lit(11.0))).otherwise(total)
    return F.greatest(F.lit(0.0), F.least(F.round(moved, 1), F.lit(100.0)))


def screen_score(types: Column) -> Column:
    """Sum of the weights of an array of types, at most 100."""
    return F.least(F.aggregate(types, F.lit(0), lambda a, t: a + lookup(t, tables.SCREEN_WEIGHTS, 5)), F.lit(100))


def metadata_fields(fields: DataFrame, key: str = "file_id") -> DataFrame:
    """key, field, label, value, weight and risk of each field that says something: its weight, raised by what leaks in its value. Informational fields have no risk.

    fields: key, field, value. Placeholders count as nothing, and fields of the picture's form are left out.
    """
    from exposark.operators.detect import metadata_findings, meaningful

    known = fields.withColumn("value", meaningful(F.col("value"))).where(F.col("value").isNotNull() & ~F.col("field").isin("image_format", "image_size", "image_mode", "gps_maps_link", "sheets"))
    known = known.withColumn("leak", metadata_findings(F.col("value")))
    weight = lookup(F.col("field"), tables.METADATA_WEIGHTS, 0)
    raised = F.when(F.col("field") == "tracked_changes", F.lit(20)).when(F.col("leak") == "local_path", F.greatest(weight, F.lit(25))).when(F.col("leak").isNotNull(), F.greatest(weight, F.lit(20))).otherwise(weight)
    known = known.withColumn("weight", raised)
    label = F.when(F.col("leak") == "local_path", "Local File Location").otherwise(F.coalesce(lookup(F.col("field"), tables.FIELD_LABELS), F.initcap(F.replace("field", F.lit("_"), F.lit(" ")))))
    level = F.when((F.col("weight") > 0) | F.col("leak").isNotNull(), F.when(F.col("weight") >= 25, "CRITICAL").when(F.col("weight") >= 15, "HIGH").otherwise("MEDIUM"))
    name = F.when(F.col("leak") == "local_path", "local_path").otherwise(F.col("field"))
    return known.select(key, name.alias("field"), label.alias("label"), F.substring("value", 1, 200).alias("value"), "weight", level.alias("risk"))


def metadata_scores(fields: DataFrame, key: str = "file_id") -> DataFrame:
    """key, score, n_sensitive and risk of each file by its metadata fields."""
    sums = metadata_fields(fields, key).groupBy(key).agg(F.least(F.sum("weight"), F.lit(100)).cast("double").alias("score"), F.count("risk").alias("n_sensitive"))
    return sums.withColumn("risk", risk(F.col("score"), "metadata"))


def combined_score(document: Column, entities: Column, vision: Column, boost: Column, doc_type: Column, hard: Column) -> Column:
    """The final score of a file; calm academic types without hard findings are damped to 12 at most."""
    total = F.least(document + entities + F.least(vision, F.lit(60.0)) + boost, F.lit(100.0))
    return F.when(doc_type.isin("project_synopsis", "ml_notebook") & ~hard, F.least(total * 0.1, F.lit(12.0))).otherwise(total)


def confidence(kind: Column, value: Column) -> Column:
    """Confidence of a pattern finding, from 0 to 1."""
    number = T.digits(value)
    good = (
        F.when(kind == "email", value.rlike(r"^[^@]+@[^@]+\.[A-Za-z]{2,}$"))
        .when(kind == "phone", number.rlike("^[6-9][0-9]{9}$"))
        .when(kind == "aadhaar", number.rlike("^[2-9][0-9]{11}$"))
        .when(kind == "pan_card", value.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"))
    )
    base = lookup(kind, tables.CONFIDENCE, 0.5)
    shifted = F.when(good.isNull(), base).when(good, base + 0.10).otherwise(base - 0.15)
    shifted = F.when(kind == "password", base + 0.15 * F.least(T.entropy(value) / 4, F.lit(1.0))).otherwise(shifted)
    return F.round(F.greatest(F.least(shifted, F.lit(1.0)), F.lit(0.0)), 3)


def confidence_label(c: Column) -> Column:
    return F.when(c >= 0.75, "HIGH").when(c >= 0.45, "MEDIUM").otherwise("LOW")
