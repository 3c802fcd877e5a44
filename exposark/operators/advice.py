"""Rule engines: findings joined with the advice, remediation and scenario tables. The tables are constants of a few rows, so they are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exposark.functions import tables
from exposark.functions import text as T
from exposark.operators.score import lookup


def recommendations(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, type, n and severity of each type that has advice. counts: key, type, n."""
    table = counts.sparkSession.createDataFrame(tables.ADVICE, "type string, up_to int, low string, high string")
    joined = counts.join(F.broadcast(table), "type")
    return joined.select(key, "type", "n", F.when(F.col("n") > F.col("up_to"), F.col("high")).otherwise(F.col("low")).alias("severity"))


def remediation(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, type, n and urgency of every type; types without a row of their own get the default."""
    table = counts.sparkSession.createDataFrame(list(tables.URGENCY.items()), "type string, urgency string")
    return counts.join(F.broadcast(table), "type", "left").select(key, "type", "n", F.coalesce("urgency", F.lit(tables.URGENCY_DEFAULT)).alias("urgency"))


def remediation_summary(plans: DataFrame, key: str = "doc_id") -> DataFrame:
    return plans.groupBy(key).agg(F.count("*").alias("n_types"), F.count_if(F.col("urgency") == "IMMEDIATE").alias("n_immediate"))


def fired(types: Column) -> Column:
    """The scenarios that an array of types fires, as an array of (scenario, severity, likelihood): those whose required types are all there.

    Types go by their aliases. The likelihood follows the share of a scenario's types, optional ones too, that are there. Dynamic scenarios stand back where another tells as much.
    """

    def rules(own: Column) -> Column:
        has = lambda kinds: F.size(F.array_intersect(own, F.array(*map(F.lit, kinds)))) == len(kinds)
        needs = {s: need for s, _, need, _ in tables.SCENARIOS}

        def rule(name: str, severity: str, need: tuple[str, ...], more: tuple[str, ...], test: Column) -> Column:
            share = F.size(F.array_intersect(own, F.array(*map(F.lit, need + more)))) / len(need + more)
            likely = F.when(share >= 0.8, "Very High").when(share >= 0.5, "High").when(share >= 0.3, "Medium").otherwise("Low")
            return F.when(test, F.struct(F.lit(name).alias("scenario"), F.lit(severity).alias("severity"), likely.alias("likelihood")))

        every = [rule(s, sev, need, opt, has(need)) for s, sev, need, opt in tables.SCENARIOS]
        every += [rule(s, sev, need, (), has(need) & (~F.arrays_overlap(own, F.array(*map(F.lit, absent))) if absent else F.lit(True))) for s, sev, need, absent in tables.COMBINED_SCENARIOS]
        for s, sev, need, others in tables.DYNAMIC_SCENARIOS:
            test = has(need)
            for other in others:
                test = test & ~has(needs[other])
            every.append(rule(s, sev, need, (), test))
        return F.array_compact(F.array(*every))

    return T.let(F.array_distinct(F.transform(types, lambda t: F.coalesce(lookup(t, tables.ALIASES), t))), rules)


def scenarios(types: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, scenario, severity and likelihood of each scenario that a key's types fire. types: key, type; few types a key, so they are gathered in one row."""
    rows = types.groupBy(key).agg(F.collect_set("type").alias("types"))
    return rows.select(key, F.explode(fired(F.col("types"))).alias("s")).select(key, "s.*")


def threat(score: Column, found: Column) -> Column:
    """A score and points for each scenario of an array, up to 100; half the score where there is none."""
    points = F.aggregate(found, F.lit(0), lambda a, s: a + lookup(s["severity"], tables.SEVERITY_POINTS, 0))
    return F.round(F.when(F.size(found) == 0, score * 0.5).otherwise(F.least(score + points, F.lit(100.0))), 1)


def threat_scores(base: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and threat of rows with a score, by scenarios in rows of their own."""
    rows = found.groupBy(key).agg(F.collect_list(F.struct("severity")).alias("found"))
    return base.join(rows, key, "left").select(key, threat(F.col("score"), F.coalesce("found", F.array().cast("array<struct<severity:string>>"))).alias("threat"))


def catalogue(spark: SparkSession) -> DataFrame:
    """scenario, severity, required and optional types of every static scenario, in order."""
    rows = [(i, s, sev, list(need), list(more)) for i, (s, sev, need, more) in enumerate(tables.SCENARIOS)]
    return spark.createDataFrame(rows, "seq int, scenario string, severity string, required array<string>, optional array<string>")


def attacks(types: Column) -> Column:
    """The attacks that an array of types makes possible, one a type, in the order in which the types come, as an array of (type, attack, severity)."""
    known = F.filter(F.array_distinct(types), lambda t: t.isin(*(k for k, _, _ in tables.ATTACKS)))
    names, levels = {k: n for k, n, _ in tables.ATTACKS}, {k: v for k, _, v in tables.ATTACKS}
    return F.transform(known, lambda t: F.struct(t.alias("type"), lookup(t, names).alias("attack"), lookup(t, levels).alias("severity")))


def metadata_advice(fields: DataFrame, key: str = "file_id") -> DataFrame:
    """key, title and severity of the advice for a file's metadata: strip it if a field is sensitive, turn off location tags if there is a place."""
    from exposark.operators.score import metadata_fields

    rows = metadata_fields(fields, key).where(F.col("risk").isNotNull())
    flags = rows.groupBy(key).agg(F.count("*").alias("n"), F.max(F.col("field") == "gps_full").alias("gps"))
    advice = F.array_compact(F.array(F.struct(F.lit("Strip Metadata Before Sharing").alias("title"), F.lit("HIGH").alias("severity")), F.when(F.col("gps"), F.struct(F.lit("Disable Camera GPS").alias("title"), F.lit("CRITICAL").alias("severity")))))
    return flags.select(key, F.explode(advice).alias("a")).select(key, "a.*")


def worth_an_alert(level: Column) -> Column:
    """Whether a level is told to the user at once."""
    return level.isin("MEDIUM", "HIGH", "CRITICAL")


def severity(kind: Column, n: Column) -> Column:
    """Severity of the advice for n findings of a type; null for types without advice."""
    out = None
    for name, up_to, low, high in tables.ADVICE:
        value = F.when(n > up_to, high).otherwise(low)
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out


def general_advice(level: Column) -> Column:
    """Severity of the one advice that every scan gets, by its level."""
    return F.when(level.isin("CRITICAL", "HIGH"), "HIGH").when(level == "MEDIUM", "MEDIUM").otherwise("LOW")
