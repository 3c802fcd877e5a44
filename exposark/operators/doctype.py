"""What kind of document a text is, by its words and findings, and the final score of a file.

All of it is told in the row, without a shuffle: keywords come from one pass over the text for all rules (keywords.py), the rest are column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposark.functions import tables
from exposark.operators import classify, detect, keywords, score

def types_of(findings: Column) -> Column:
    return F.array_distinct(F.transform(findings, lambda f: f["type"]))


def with_inferred(docs: DataFrame, text: str = "text", types: str = "types", found: Column | None = None) -> DataFrame:
    """docs with inferred, a struct(doc_type, boost, confidence): the rule with most keywords, the first of equals. found: the text's keywords where they are known.

    An identity document without its number is a project paper if two words say so, else generic; a screen of credentials without any is an authentication screen.
    """
    def fit(i: int, name: str, boost: int, need: tuple, more: tuple, least: int) -> Column:
        n = keywords.count(F.col("__words"), keywords.ids(need + more))
        sure = F.when(n >= 2 * least, "HIGH").otherwise("MEDIUM")
        test = (n >= least) & keywords.any_of(F.col("__words"), keywords.ids(need)) if need else n >= least
        return F.when(test, F.struct(n.alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("doc_type"), F.lit(boost).alias("boost"), sure.alias("confidence")))

    rows = docs.withColumn("__words", found if found is not None else keywords.found(F.col(text)))
    fits = F.array_max(F.array(*(fit(i, *rule) for i, rule in enumerate(tables.TYPE_RULES))))
    papers = keywords.count(F.col("__words"), keywords.ids(tables.PAPER_WORDS))
    rows = rows.withColumn("__best", fits)
    best = F.col("__best.doc_type")
    has = lambda *kinds: F.arrays_overlap(F.col(types), F.array(*map(F.lit, kinds)))
    kind = lambda name, boost, sure: F.struct(F.lit(name).alias("doc_type"), F.lit(boost).alias("boost"), F.lit(sure).alias("confidence"))
    bare = ((best == "aadhaar_card") & ~has("aadhaar")) | ((best == "pan_card_doc") & ~has("pan_card"))
    inferred = (
        F.when(best.isNull(), kind("generic", 0, "LOW"))
        .when(bare & (papers >= 2), kind("project_synopsis", 0, "HIGH"))
        .when(bare, kind("generic", 0, "LOW"))
        .when((best == "screenshot_credential") & ~has(*tables.CREDENTIAL_TYPES), kind("screenshot_auth", 0, "HIGH"))
        .otherwise(F.struct(best.alias("doc_type"), F.col("__best.boost").alias("boost"), F.col("__best.confidence").alias("confidence")))
    )
    return rows.withColumn("inferred", inferred).drop("__words", "__best")


def resolved(keyword: Column, inferred: Column, types: Column) -> Column:
    """struct(doc_type, boost): the keyword classifier's type where it is sure (0.6) and has the findings that its type needs, else the inferred one."""
    name = keyword["doc_type"]
    backed = F.lit(True)
    for kind, needed in tables.NEEDED_EVIDENCE.items():
        backed = backed & ((name != kind) | F.arrays_overlap(types, F.array(*map(F.lit, needed))))
    own = F.struct(name.alias("doc_type"), classify.boost(name).cast("int").alias("boost"))
    return F.when((keyword["confidence"] >= 0.6) & backed, own).otherwise(F.struct(inferred["doc_type"].alias("doc_type"), inferred["boost"].cast("int").alias("boost")))


def entity_points(entities: Column, doc_type: Column) -> Column:
    """Points of named entities, an array of (type, weight): by type the first one's weight up the ladder, times 1.4; soft types count 15 at most in calm documents."""
    kinds = F.array_distinct(F.transform(entities, lambda e: e["type"]))

    def points(kind: Column) -> Column:
        own = F.filter(entities, lambda e: e["type"] == kind)
        return score.ladder(F.get(own, F.lit(0))["weight"].cast("double"), F.size(own)) * 1.4

    total = lambda keep: F.aggregate(F.filter(kinds, keep), F.lit(0.0), lambda a, k: a + points(k))
    soft = total(lambda k: k.isin(*tables.ENTITY_SOFT_TYPES))
    capped = F.when(doc_type.isin(*tables.CALM_DOCUMENTS), F.least(soft, F.lit(float(tables.SOFT_CAP)))).otherwise(soft)
    return F.round(total(lambda k: ~k.isin(*tables.ENTITY_SOFT_TYPES)) + capped, 1)


def vision_points(seen: Column) -> Column:
    """Points of what pictures show, an array of (weight, confidence): 1.2 times their products, 60 at most."""
    return F.least(F.aggregate(seen, F.lit(0.0), lambda a, x: a + x["weight"] * x["confidence"] * 1.2), F.lit(60.0))


def vision_findings(seen: Column) -> Column:
    """Findings (type, weight, confidence) of what detectors saw, a struct(faces, face_confidence, id_document, id_confidence, signature, signature_confidence, codes, code_confidence); an id document needs a confidence of 0.6."""
    kind = lambda test, name, weight, sure: F.when(test, F.struct(F.lit(name).alias("type"), F.lit(weight).alias("weight"), sure.cast("double").alias("confidence")))
    return F.array_compact(
        F.array(
            kind(seen["faces"] > 0, "face_detected", 22, seen["face_confidence"]),
            kind(seen["id_document"] & (seen["id_confidence"] >= 0.6), "id_card_visible", 30, seen["id_confidence"]),
            kind(seen["signature"], "signature_visible", 12, seen["signature_confidence"]),
            kind(seen["codes"] > 0, "qr_barcode", 15, seen["code_confidence"]),
        )
    )


def agent_score(document: Column, boost: Column, risk: Column) -> Column:
    """struct(score, risk) of a watched file: the document's score and its type's boost; where there is one, the level follows the sum alone."""
    total = F.least(document + boost, F.lit(100.0))
    return F.struct(total.alias("score"), F.when(boost > 0, score.risk(total, "agent")).otherwise(risk).alias("risk"))


def with_final(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with types, doc_type, boost, score and risk of each file, by text alone: findings, the resolved type, its boost, and damping of calm papers."""
    rows = docs.withColumn("__found", keywords.found(F.col(text)))
    rows = rows.withColumn("__first", classify.keyword_class_of(F.col("__found")))
    rows = rows.withColumn("__academic", classify.is_academic(F.col("__found"), F.col("__first.doc_type")))
    rows = rows.withColumn("findings", detect.document_findings(F.col(text), F.col("__academic"))).withColumn("types", types_of(F.col("findings")))
    rows = with_inferred(rows, text, found=F.col("__found")).withColumn("__kind", resolved(F.col("__first"), F.col("inferred"), F.col("types")))
    rows = rows.withColumn("doc_type", F.col("__kind.doc_type")).withColumn("boost", F.col("__kind.boost"))
    rows = score.with_row_score(rows, "findings", "doc_type")
    hard = F.arrays_overlap("types", F.array(*map(F.lit, tables.HARD_TYPES)))
    total = F.least(F.col("score") + F.col("boost"), F.lit(100.0))
    final = F.round(F.when(F.col("doc_type").isin(*tables.CALM_TYPES) & ~hard, F.least(total * 0.1, F.lit(12.0))).otherwise(total), 2)
    rows = rows.withColumn("__final", final)
    level = F.when((F.col("__final") >= 80) & hard, "CRITICAL").when(F.col("__final") >= 35, "HIGH").when(F.col("__final") >= 15, "MEDIUM").when((F.col("__final") > 0) | (F.size("findings") > 0), "LOW").otherwise("SAFE")
    return rows.withColumn("risk", level).withColumn("score", F.col("__final")).drop("__found", "__first", "__academic", "__kind", "__final", "inferred")
