"""Which entities stand, one rule at a time."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from exposark.operators import entities

WORDS = entities.Words(noise=("hello", "sir"), technical=("python", "project", "learning"), libraries=("python",), no_organisation=("academic year",), algorithms=("gradient", "boosting"), no_place=("report",), excluded=("paya se",))
CASES = [
    ("Asha Rao", "PERSON", False, True), ("Paya Se", "PERSON", False, False), ("Hello", "PERSON", False, False), ("Hello Sir", "PERSON", False, False), ("Bo", "PERSON", False, False), ("Asha R4o", "PERSON", False, False), ("Asha-Rao", "PERSON", False, False),
    ("snake_case", "ORG", False, False), ("camelCase", "ORG", False, False), ("sklearn.svm", "ORG", False, False), ("a/b", "ORG", False, False), ("K-Means", "ORG", False, False), ("PROBLEM", "ORG", False, False), ("IBM", "ORG", False, True),
    ("Python Club", "PERSON", False, False), ("Project Club", "ORG", False, True), ("Python Club", "ORG", False, False), ("Project Club", "ORG", True, False), ("Department of Physics", "ORG", False, False), ("Oxford University", "ORG", False, True),
    ("Academic Year Board", "ORG", False, False), ("Smith &", "ORG", False, False), ("Gradient Boosting", "ORG", False, False), ("Report", "GPE", False, False), ("Pune", "GPE", False, True),
    ("12 May 1999", "DATE", False, True), ("12 May 1999", "DATE", True, False), ("2024", "DATE", False, False), ("2023-24", "DATE", False, False), ("last week", "DATE", False, False), ("4532 1234 5678 9012", "DATE", False, False), ("4532 1234 5678", "DATE", False, False),
    ("Rs 500", "MONEY", False, True), ("500 000", "MONEY", False, False), ("Ab-1234", "CARDINAL", False, True), ("AB-1234", "CARDINAL", False, False), ("three", "CARDINAL", False, False), ("v1.2", "CARDINAL", False, False), ("9876543210", "CARDINAL", False, False), ("1234 5678 9012", "CARDINAL", False, False), ("12345", "CARDINAL", False, True),
    ("1AB12CD345", "CARDINAL", False, False), ("", "PERSON", False, False), (None, "ORG", False, False),
]


def test_each_rule(spark):
    rows = spark.createDataFrame([(i, v, k, a) for i, (v, k, a, _) in enumerate(CASES)], "i int, value string, label string, academic boolean")
    got = rows.select("i", entities.stands(F.col("value"), F.col("label"), F.col("academic"), WORDS).alias("s")).orderBy("i").collect()
    assert [(v, k, a, r["s"]) for (v, k, a, _), r in zip(CASES, got, strict=True)] == CASES


@pytest.mark.parametrize(("value", "label", "good"), [("Django Labs", "ORG", True), ("build", "LOC", False), ("Payase", "GPE", False)])
def test_default_words(spark, value, label, good):
    assert spark.createDataFrame([(value, label)], "v string, l string").select(entities.stands(F.col("v"), F.col("l"))).first()[0] is good
