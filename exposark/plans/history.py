"""Analytics over the scan history: each question is one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposark.functions import tables
from exposark.operators.score import lookup


def tenths(score: Column) -> Column:
    """A score as a decimal, so that sums are the same in any order; null where it is no tenth."""
    exact = score.try_cast("decimal(18,1)")
    return F.when(exact.cast("double") == score, exact)


def rounded(x: Column) -> Column:
    """A double to a tenth, halves away from zero; what is negative stays so, -0.0 too."""
    return F.when(F.abs(x) < 1e15, F.signum(x) * F.floor(F.abs(x) * 10 + 0.5) / 10).otherwise(x)


def half_tenth(total: Column, n: Column) -> Column:
    """Whether total / n lies exactly between two tenths."""
    return (F.abs(total) * 20) % (n * 2) == n


def same(rows: DataFrame, few: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rows whose keys, nulls included, are among few, with the columns of both."""
    few = few.withColumnsRenamed({k: f"of_{k}" for k in keys})
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return rows.join(few, test).drop(*(f"of_{k}" for k in keys))


def with_mean(rows: DataFrame, keys: tuple[str, ...], *more: Column) -> DataFrame:
    """By keys: more aggregates, and avg_score, the mean score to a tenth.

    Sums are exact. Only where a mean lies exactly between two tenths does the order decide in doubles; for such groups, of which one with n scans is one with a chance of about 1 / n,
    the scores are added in the order of scan_id, as SQL adds them in one thread.
    """
    exact = tenths(F.col("score"))
    groups = rows.groupBy(*keys).agg(*more, F.count("score").alias("_n"), F.sum(exact).alias("_total"), F.count(exact).alias("_exact"), F.min("score").alias("_least"))
    in_order = (F.col("_exact") < F.col("_n")) | half_tenth(F.col("_total"), F.col("_n")) | ((F.col("_total") == 0) & (F.col("_least") < 0))
    w = Window.partitionBy(*keys).orderBy("scan_id")
    near = same(rows.where("score IS NOT NULL").select(*keys, "scan_id", "score"), groups.where(in_order).select(*keys, "_n"), keys)
    near = near.withColumn("k", F.row_number().over(w)).withColumn("_added", F.sum("score").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    added = near.where(F.col("k") == F.col("_n")).select(*(F.col(k).alias(f"of_{k}") for k in keys), "_added")
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    mean = F.coalesce("_added", F.col("_total").cast("double")) / F.nullif(F.col("_n"), F.lit(0))
    return groups.join(added, test, "left").withColumn("avg_score", rounded(mean)).drop("_n", "_total", "_exact", "_least", "_added", *(f"of_{k}" for k in keys))


def timeline(scans: DataFrame, owner: int) -> DataFrame:
    return scans.where(F.col("owner_id") == owner).select("scan_id", F.date_format("upload_date", "yyyy-MM-dd").alias("day"), "score", "risk", "n_findings")


def timelines(scans: DataFrame) -> DataFrame:
    """The timeline of every owner."""
    return scans.select("owner_id", "scan_id", F.date_format("upload_date", "yyyy-MM-dd").alias("day"), "score", "risk", "n_findings")


def summary(scans: DataFrame) -> DataFrame:
    """By owner: scans, mean, highest and lowest score, findings."""
    rows = with_mean(scans, ("owner_id",), F.count("*").alias("n_scans"), F.max("score").alias("max_score"), F.min("score").alias("min_score"), F.sum("n_findings").alias("n_findings"))
    return rows.select("owner_id", "n_scans", "avg_score", "max_score", "min_score", "n_findings")


def risk_distribution(scans: DataFrame) -> DataFrame:
    return scans.groupBy("risk").agg(F.count("*").alias("n"))


def most_common_risk(scans: DataFrame) -> DataFrame:
    """By owner the level with most scans; of equal ones that seen first."""
    counts = scans.groupBy("owner_id", "risk").agg(F.count("*").alias("n"), F.min(F.struct("upload_date", "scan_id")).alias("first"))
    best = counts.groupBy("owner_id").agg(F.max("n").alias("n"))
    tied = counts.join(best, ["owner_id", "n"]).groupBy("owner_id").agg(F.min(F.struct("first", "risk", "n")).alias("x"))
    return tied.select("owner_id", F.col("x.risk").alias("risk"), F.col("x.n").alias("n"))


def trend(scans: DataFrame) -> DataFrame:
    """By owner the mean of the later half less that of the earlier half, in order of time; a middle row counts for neither.

    Hours are summed first, and an owner's hours tell in which of them its halves end; only the scans of those hours are put in order, so that no owner's scans are one task.
    Sums are exact. Only where the difference lies exactly between two tenths, on the bounds of the labels or at 0 does the order decide in doubles: the scans of these owners are added in order
    of time, as SQL adds them. An owner of n scans is one of them with a chance of about 1 / n.
    """
    rows = scans.select("owner_id", "score", tenths(F.col("score")).alias("exact"), "upload_date", "scan_id", F.date_trunc("hour", "upload_date").alias("hour"))
    hours = rows.groupBy("owner_id", "hour").agg(F.count("*").alias("m"), F.sum("exact").alias("sum"), F.count_if(F.col("exact").isNull()).alias("odd"))
    w = Window.partitionBy("owner_id")
    hours = hours.withColumn("before", F.coalesce(F.sum("m").over(w.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("m").over(w))
    hours = hours.withColumn("half", F.greatest(F.floor(F.col("n") / 2), F.lit(1)))
    after = F.col("before") + F.col("m")
    early, late = after <= F.col("half"), F.col("before") >= F.col("n") - F.col("half")
    ends = ((F.col("before") < F.col("half")) & (after > F.col("half"))) | ((F.col("before") < F.col("n") - F.col("half")) & (after > F.col("n") - F.col("half")))
    part = lambda test, value, name: F.sum(F.when(test, F.col(value))).alias(name)
    whole = hours.groupBy("owner_id").agg(F.max("n").alias("n"), F.max("half").alias("half"), F.sum("odd").alias("odd"), part(early & ~ends, "sum", "early"), part(late & ~ends, "sum", "late"))
    near = same(rows, hours.where(ends).select("owner_id", "hour", "before", "n", "half"), ("owner_id", "hour"))
    near = near.withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("owner_id", "hour").orderBy("upload_date", "scan_id")))
    single = near.groupBy(F.col("owner_id").alias("o")).agg(part(F.col("k") <= F.col("half"), "exact", "more_early"), part(F.col("k") > F.col("n") - F.col("half"), "exact", "more_late"))
    total = lambda x: F.coalesce(x, F.lit(0)) + F.coalesce(f"more_{x}", F.lit(0))
    sums = whole.join(single, F.col("owner_id").eqNullSafe(F.col("o")), "left").withColumn("gap", total("late") - total("early"))
    in_order = (F.col("n") > 1) & ((F.col("odd") > 0) | (F.col("gap") == 0) | (F.abs("gap") == F.col("half") * 5) | half_tenth(F.col("gap"), F.col("half")))
    w = w.orderBy("upload_date", "scan_id")
    added = same(rows, sums.where(in_order).select("owner_id", "n", "half"), ("owner_id",)).withColumn("k", F.row_number().over(w))
    run = lambda test: F.sum(F.when(test, F.col("score"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.col("half")
    added = added.withColumn("added", run(F.col("k") > F.col("n") - F.col("half")) - run(F.col("k") <= F.col("half"))).where(F.col("k") == F.col("n"))
    sums = sums.drop("o").join(added.select(F.col("owner_id").alias("o"), "added"), F.col("owner_id").eqNullSafe(F.col("o")), "left")
    sums = sums.withColumn("moved", F.coalesce("added", F.col("gap").cast("double") / F.col("half")))
    label = F.when(F.col("n") < 2, "neutral").when(F.col("moved") > 5, "worsening").when(F.col("moved") < -5, "improving").otherwise("stable")
    return sums.select("owner_id", F.when(F.col("n") < 2, 0.0).otherwise(rounded(F.col("moved"))).alias("change"), label.alias("trend"))


def by_source(scans: DataFrame) -> DataFrame:
    source = F.when(F.startswith("source", F.lit("metadata")), "metadata").otherwise(F.col("source"))
    rows = with_mean(scans.select(source.alias("source"), "scan_id", "score"), ("source",), F.count("*").alias("n"), F.max("score").alias("max_score"), F.min("score").alias("min_score"))
    return rows.select("source", "n", "avg_score", "max_score", "min_score")


def recent(scans: DataFrame, k: int = 20) -> DataFrame:
    """The newest k scans."""
    return scans.orderBy(F.desc("upload_date"), F.desc("scan_id")).limit(k).select("scan_id", "owner_id", "score", "risk", "source")


def daily_average(scans: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Each of the last days with its mean score, null where there was no scan."""
    spark = scans.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.to_date(F.lit(as_of)), days - 1), F.to_date(F.lit(as_of)))).alias("day"))
    since = F.date_sub(F.to_date(F.lit(as_of)), days - 1)
    recent = scans.where((F.to_date("upload_date") >= since) & (F.to_date("upload_date") <= F.to_date(F.lit(as_of))))
    means = with_mean(recent.select(F.to_date("upload_date").alias("day"), "scan_id", "score"), ("day",), F.count("*").alias("n"))
    return F.broadcast(calendar).join(means, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "avg_score", F.coalesce("n", F.lit(0)).alias("n"))


def dashboard(scans: DataFrame) -> DataFrame:
    level = lambda *x: F.count_if(F.col("risk").isin(*x))
    return scans.agg(F.count("*").alias("n"), level("CRITICAL", "HIGH").alias("n_high"), level("MEDIUM").alias("n_medium"), level("LOW", "SAFE").alias("n_low"), F.round(F.avg("score"), 0).alias("avg_score"))


def top_per_source(scans: DataFrame, k: int = 3) -> DataFrame:
    """The k highest scores of each source."""
    w = Window.partitionBy("source").orderBy(F.desc("score"), "scan_id")
    return scans.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("source", "rank", "scan_id", "score")


def batch_jobs(scans: DataFrame, per_job: int = 10) -> DataFrame:
    """Scans gathered in jobs: files, alerts, highest score and level, mean score."""
    jobs = scans.withColumn("job_id", F.floor(F.col("scan_id") / per_job))
    worst = F.max(F.struct(lookup(F.col("risk"), tables.RISK_RANK, 0).alias("rank"), F.col("risk")))
    rows = with_mean(jobs, ("job_id",), F.count("*").alias("n_files"), F.count_if(F.col("score") >= 75).alias("n_alerts"), F.max("score").alias("max_score"), worst.alias("w"))
    return rows.select("job_id", "n_files", "n_alerts", "max_score", "avg_score", F.col("w.risk").alias("highest_risk"))


def across_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count("*").alias("n_jobs"), F.sum("n_files").alias("n_files"), F.sum("n_alerts").alias("n_alerts"), F.round(F.avg("avg_score"), 1).alias("avg_score"), F.max("max_score").alias("max_score"))


def moving_averages(scans: DataFrame, spans: tuple[int, ...] = (7, 30)) -> DataFrame:
    """By owner and day, from the owner's first scan to the last: scans, mean score (null on days without any), and means over the last 7 and 30 days, the day itself included.

    Days are summed before anything is put in order, and the calendar of an owner has a row a day, so no task holds an owner's scans.
    """
    days = scans.where("upload_date IS NOT NULL").groupBy("owner_id", F.to_date("upload_date").alias("day")).agg(F.sum(F.col("score").cast("decimal(18,1)")).cast("double").alias("total"), F.count("score").alias("n"))
    ends = days.groupBy(F.col("owner_id").alias("o")).agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("d"))
    filled = ends.join(days, F.col("owner_id").eqNullSafe(F.col("o")) & (F.col("day") == F.col("d")), "left").select(F.col("o").alias("owner_id"), F.col("d").alias("day"), F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.partitionBy("owner_id").orderBy(F.unix_date("day"))
    exact = F.col("total").cast("decimal(18,1)")  # tenths add up to the same in any order
    moved = [(F.sum(exact).over(w.rangeBetween(1 - k, 0)).cast("double") / F.nullif(F.sum("n").over(w.rangeBetween(1 - k, 0)), F.lit(0))).alias(f"avg_{k}") for k in spans]
    return filled.select("owner_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", (F.col("total") / F.nullif(F.col("n"), F.lit(0))).alias("avg_score"), *moved)
