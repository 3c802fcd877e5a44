"""The timelines of all owners."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import functions as F

from exposark import catalogue
from exposark.plans import history

SF = "/root/testdata/sf0.001"


def test_timelines_have_every_scan_of_every_owner(spark):
    out = catalogue.QUERIES["hist_timelines"](spark, SF)
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert out.count() == events.count()
    assert out.select("owner_id").distinct().count() == events.select("user_id").distinct().count()
    seven = catalogue.QUERIES["hist_timeline"](spark, SF)
    assert sorted(map(repr, out.where("owner_id = 7").drop("owner_id").collect())) == sorted(map(repr, seven.collect()))


def _at_ties(owners: int = 400, n: int = 20) -> list[tuple]:
    """(scan_id, owner_id, score in tenths) of owners whose mean, and whose halves' difference, lie exactly between two tenths."""
    import random

    deal, rows = random.Random(11), []
    for owner in range(owners):
        tenths = [deal.randrange(1, 1000) for _ in range(n)]
        tenths[0] += -(sum(tenths) - n // 2) % n  # the whole is a half tenth off
        tenths[-1] += 5 - (sum(tenths[n // 2 :]) - sum(tenths[: n // 2])) % 10 if owner % 2 else 0  # and so are the halves of every second owner
        rows += [(owner * n + k, owner, t) for k, t in enumerate(tenths)]
    return rows


def _to_a_tenth(x: float) -> float:
    return math.copysign(math.floor(abs(x) * 10 + 0.5) / 10, x)


def _dealt(spark, rows: list[tuple]):
    """The rows, dealt over 7 partitions against their order."""
    made = spark.createDataFrame([(s, o, t / 10, 1) for s, o, t in rows], "scan_id long, owner_id long, score double, n_findings long")
    return made.withColumn("upload_date", F.timestamp_seconds(F.col("scan_id") * 2500)).repartition(7, F.hash("scan_id")).sortWithinPartitions(F.desc("scan_id"))


def _sums(rows: list[tuple], first: int = 0, last: int | None = None) -> dict[int, tuple[float, int]]:
    """By owner the scores in order, added in doubles, and how many they are."""
    every: dict[int, list[float]] = {}
    for _, owner, t in sorted(rows, key=lambda r: r[0]):
        every.setdefault(owner, []).append(t / 10)
    return {o: (functools.reduce(operator.add, v[first:last], 0.0), len(v[first:last])) for o, v in every.items()}


def test_means_between_two_tenths_do_not_hang_on_the_order_of_partitions(spark):
    rows = _at_ties()
    wanted = {o: _to_a_tenth(s / n) for o, (s, n) in _sums(rows).items()}
    assert {r["owner_id"]: r["avg_score"] for r in history.summary(_dealt(spark, rows)).collect()} == wanted


def test_trends_between_two_tenths_are_those_of_scores_added_in_order(spark):
    rows = _at_ties() + [(10**6 + k, 10**6, t) for k, t in enumerate((3, 6, 1, 8))] + [(10**6 + 9, None, 7)]
    late, early = _sums(rows, 10), _sums(rows, 0, 10)
    late[10**6], early[10**6] = (0.1 + 0.8, 2), (0.3 + 0.6, 2)
    wanted = {o: repr(_to_a_tenth(late[o][0] / late[o][1] - early[o][0] / early[o][1])) for o in late if o is not None}
    found = {r["owner_id"]: repr(r["change"]) for r in history.trend(_dealt(spark, rows)).collect()}
    assert found.pop(None) == "0.0"
    assert found == wanted
