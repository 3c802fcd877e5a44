"""Rules that fire where a set of types holds all that they require, as a join: the rules are a table of any size.

Each rule is filed under the rarest of the types that it requires. A set meets only the rules filed under one of its types, and what it requires beside
that is compared within the row. So the work follows the pairs that meet, not sets times rules, and nothing is unrolled into the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposark.functions import tables
from exposark.operators.score import lookup

SCHEMA = "seq int, scenario string, severity string, required array<string>, optional array<string>, absent array<string>, unless array<array<string>>"


def scenario_rules(spark: SparkSession) -> DataFrame:
    """The scenarios as rules: seq, scenario, severity, required and optional types, types of which none may be there, and sets of types of which none may be there as a whole."""
    needs = {s: list(need) for s, _, need, _ in tables.SCENARIOS}
    rows = [(s, sev, list(need), list(more), [], []) for s, sev, need, more in tables.SCENARIOS]
    rows += [(s, sev, list(need), [], list(absent), []) for s, sev, need, absent in tables.COMBINED_SCENARIOS]
    rows += [(s, sev, list(need), [], [], [needs[o] for o in others]) for s, sev, need, others in tables.DYNAMIC_SCENARIOS]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def type_counts(sets: DataFrame, types: str = "types") -> DataFrame:
    """at and n: how many sets hold each type; a row a type."""
    return sets.select(F.explode(F.array_distinct(types)).alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n"))


def filed(rules: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """rules with at, the rarest type that each requires, by the sets that hold each type (at, n); of equally rare ones the first by name. Rules that require nothing, or a type that no set holds, never fire and are left out.

    Without such counts the rarest is the one that fewest rules require, which asks nothing of the sets.
    """
    single = rules.select("seq", F.explode(F.array_distinct("required")).alias("at"))
    known = single.groupBy("at").agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    best = single.join(known, "at", "left").groupBy("seq").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at")).alias("best"))
    return rules.join(best.where("best.n > 0"), "seq").withColumn("at", F.col("best.at")).drop("best")


def fired(sets: DataFrame, rules: DataFrame, key: str = "doc_id", types: str = "types", counts: DataFrame | None = None) -> DataFrame:
    """key, scenario, severity and likelihood of each rule that a set of types fires. sets: key, types (an array, aliases allowed); a null or empty set fires none. counts: as type_counts gives them, where sets are cheap to read twice."""
    known = F.array_distinct(F.transform(F.coalesce(F.col(types), F.array().cast("array<string>")), lambda t: F.coalesce(lookup(t, tables.ALIASES), t)))
    own = sets.select(key, known.alias("own"))
    met = own.select(key, "own", F.explode("own").alias("at")).join(filed(rules, counts), "at")
    holds = lambda kinds: F.size(F.array_intersect(kinds, F.col("own"))) == F.size(F.array_distinct(kinds))
    met = met.where(holds(F.col("required")) & ~F.arrays_overlap("absent", "own") & ~F.exists("unless", holds))
    every = F.array_distinct(F.concat("required", "optional"))
    share = F.size(F.array_intersect(every, F.col("own"))) / F.size(every)
    likely = F.when(share >= 0.8, "Very High").when(share >= 0.5, "High").when(share >= 0.3, "Medium").otherwise("Low")
    return met.select(key, "scenario", "severity", likely.alias("likelihood"))
