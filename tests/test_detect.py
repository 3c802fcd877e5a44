"""Birth dates in all their forms, and the classes of the web profile."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from exposark.operators import detect


@pytest.fixture(scope="module")
def found(spark):
    def run(expression, rows):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, url string")
        return [[tuple(f) if not isinstance(f, str) else f for f in r[1]] for r in df.select("i", expression(F.col("text"), F.col("url")).alias("f")).orderBy("i").collect()]

    return run


def test_birth_dates(found):
    cases = [
        ("D.O.B: 1/2/1990", ["1/2/1990"]), ("birth date is 15-08-1995", ["15-08-1995"]), ("Date of Birth (as per ID): 12 January 1990", ["12 January 1990"]),
        ("dob 1/2/1850 dob 3/4/1990", ["3/4/1990"]), ("DOB: 15/08/1995 or 12 Jan 1990", ["12 Jan 1990"]), ("date  of birth: 15/08/1995", ["15/08/1995"]),
        ("date of issue 15/08/1995", []), ("dob " + "x" * 81 + " 15/08/1995", []), ("dob 31/12/99", ["31/12/99"]), ("DOB: 15/08/1995 DOB: 16/08/1995", ["15/08/1995"]), (None, []),
    ]
    assert found(lambda t, u: detect.birth_dates(t), [(t, "") for t, _ in cases]) == [want for _, want in cases]


def web(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, url string")
    return [[tuple(f) for f in r["findings"]] for r in detect.with_url_findings(df).orderBy("i").collect()]


def test_web_classes(spark):
    far = " x" * 150
    cases = [
        ("ann.lee@gmail.com", "https://shop.com/", {("personal_email", "ann.lee@gmail.com")}),
        ("a.b@shop.com", "https://www.shop.com/x", {("public_contact", "a.b@shop.com")}),
        ("shopping1@gmail.com", "https://shop.com", {("public_contact", "shopping1@gmail.com")}),
        ("info@other.com", "https://shop.com", {("public_contact", "info@other.com")}),
        ("x.y@uni.edu", "https://shop.com", {("public_contact", "x.y@uni.edu")}),
        ("Reach us: ann.lee@gmail.com", "https://a.com", {("public_contact", "ann.lee@gmail.com")}),
        ("ann.lee@gmail.com is the director", "https://a.com", {("public_contact", "ann.lee@gmail.com")}),
        ("contact" + far + " ann.lee@gmail.com" + far + " contact", "https://a.com", {("personal_email", "ann.lee@gmail.com")}),
        ("ann.lee@gmail.com", "https://a.org/", {("public_contact", "ann.lee@gmail.com")}),
        ("9876543210", "https://a.com", {("phone", "9876543210")}),
        ("9876543210", "https://a.ac.in", {("public_phone", "9876543210")}),
        ("helpline 9876543210", "https://a.com", {("public_phone", "9876543210")}),
        ("born on 15/08/1995", "https://a.com", {("dob", "15/08/1995")}),
        ("CVC 123", "https://a.com", {("cvv", "123")}),
        ("ABCDE1234F", "https://a.com", {("pan", "ABCDE1234F")}),
        ("ABCDE1234F HTTP HTML JSON XML API URL", "https://a.com", set()),
        ("pan card ABCDE1234F HTTP HTML JSON XML API URL", "https://a.com", {("pan", "ABCDE1234F")}),
    ]
    got = web(spark, [(t, u) for t, u, _ in cases])
    assert [set(x) for x in got] == [want for *_, want in cases]
    assert web(spark, [("Ann.lee@gmail.com ann.lee@gmail.com", "https://a.com")]) == [[("personal_email", "Ann.lee@gmail.com")]]


def test_many_values_take_time_in_proportion(spark):
    """A page of 20000 addresses: words and values are placed once each, and equal ones found by sorting."""
    text = " ".join(f"a{i}.b@mail{i}.com" for i in range(20_000)) + " contact"
    began = time.time()
    (found,) = web(spark, [(text + " " + text.upper(), "https://x.com")])
    assert len(found) == 20_000 and time.time() - began < 30
    assert [t for t, _ in found].count("public_contact") < 30
