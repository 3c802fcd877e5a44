from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from exposark.functions import tables
from exposark.functions import text as T
from exposark.operators import advice, classify, detect, score
from exposark.sources import corpus as C
from exposark.sources import pages as P


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(("number", "good"), [("4532015112830366", True), ("4532015112830367", False), ("", False)])
def test_luhn(spark, number, good):
    assert one(spark, number, T.luhn) == good


@pytest.mark.parametrize(("number", "good"), [("2363", True), ("2364", False), ("200000000009", True), ("999999999999", True)])
def test_verhoeff(spark, number, good):
    assert one(spark, number, T.verhoeff) == good


def test_entropy(spark):
    assert round(one(spark, "Secret@123", T.entropy), 4) == 3.1219
    assert one(spark, "", T.entropy) == 0


@pytest.mark.parametrize(
    ("text", "types"),
    [
        ("write to a.b@example.org", {"email"}),
        ("call 9876543210 today", {"phone"}),
        ("id 2345 6789 0123", {"aadhaar"}),
        ("ABCDE1234F", {"pan_card"}),
        ("4532 0151 1283 0366", {"credit_card", "aadhaar"}),
        ("CVV: 123", {"cvv"}),
        ("DOB: 15/08/1995", {"dob"}),
        ("Your OTP is 482913", {"otp"}),
        ("password: Secret@123", {"password"}),
        ("", set()),
        (None, set()),
    ],
)
def test_document_profile(spark, text, types):
    found = one(spark, text, detect.document_findings)
    assert {f["type"] for f in found} == types


@pytest.mark.parametrize(
    ("counts", "points", "level"),
    [({}, 0, "LOW"), ({"email": 1}, 18, "MEDIUM"), ({"email": 2}, 30.6, "MEDIUM"), ({"email": 3}, 39.6, "HIGH"), ({"cvv": 1}, 40, "HIGH"), ({"credit_card": 2}, 68, "HIGH"), ({"aadhaar": 1, "pan_card": 1}, 95, "CRITICAL"), ({"person_name": 2}, 15, "MEDIUM"), ({"qr_barcode": 1}, 10, "LOW")],
)
def test_document_scores(spark, counts, points, level):
    docs = spark.createDataFrame([(1,)], "doc_id long")
    findings = spark.createDataFrame([(1, t, str(i)) for t, n in counts.items() for i in range(n)], "doc_id long, type string, value string")
    row = score.document_scores(docs, findings).first()
    assert (row["score"], row["risk"]) == (points, level)


def test_url_scores(spark):
    pages = spark.createDataFrame([(i,) for i in range(5)], "page_id long")
    found = [(0, "personal_email"), (1, "credit_card"), (2, "credit_card"), (2, "credit_card"), (3, "credit_card"), (3, "cvv")]
    got = {r["page_id"]: (r["score"], r["risk"]) for r in score.url_scores(pages, spark.createDataFrame([(k, t, "x") for k, t in found], "page_id long, type string, value string")).collect()}
    assert got == {0: (5, "LOW"), 1: (35, "HIGH"), 2: (52.5, "HIGH"), 3: (75, "CRITICAL"), 4: (0, "SAFE")}


def test_risk_rises_with_score(spark):
    for profile in tables.RISK_PROFILES:
        df = spark.range(0, 101).select(F.col("id").alias("s"), score.risk(F.col("id").cast("double"), profile, F.lit(True)).alias("r")).orderBy("s")
        ranks = [tables.RISK_RANK[r["r"]] for r in df.collect()]
        assert ranks == sorted(ranks)


@pytest.mark.parametrize(("types", "ids"), [(["email"], {"phishing_email"}), (["email", "password"], {"phishing_email", "credential_stuffing"}), (["aadhaar", "pan_card"], {"aadhaar_impersonation", "pan_financial_fraud", "full_kyc_theft"}), (["credit_card"], {"card_cloning"}), (["credit_card", "cvv"], {"cvv_card_fraud", "card_cloning"}), (["pan"], {"pan_financial_fraud"})])
def test_scenarios(spark, types, ids):
    found = advice.scenarios(spark.createDataFrame([(1, t) for t in types], "doc_id long, type string"))
    assert {r["scenario"] for r in found.collect()} == ids


@pytest.mark.parametrize(("text", "kind", "sure"), [("passport", "passport", 0.6667), ("passport nationality", "passport", 0.7833), ("passport nationality republic of india", "passport", 0.89), ("nothing", "generic", 0.0), (None, "generic", 0.0), ("guide build", "generic", 0.0)])
def test_keyword_class(spark, text, kind, sure):
    got = one(spark, text, classify.keyword_class)
    assert (got["doc_type"], got["confidence"]) == (kind, sure)


def test_masking_leaves_nothing(spark):
    out = one(spark, "a.b@example.org paid 4532015112830366, token = abcdef", T.masked)
    assert out == "[EMAIL] paid [CARD], token = [SECRET]"


def test_metadata(spark):
    rows = [(1, "author", "A B"), (2, "subject", "x@y.org"), (3, "gps_full", "1"), (3, "gps_latitude", "1"), (3, "gps_longitude", "1"), (4, "path", "C:\\Users\\x")]
    got = {r["file_id"]: (r["score"], r["risk"]) for r in score.metadata_scores(spark.createDataFrame(rows, "file_id long, field string, value string")).collect()}
    assert got == {1: (15, "LOW"), 2: (20, "MEDIUM"), 3: (60, "HIGH"), 4: (25, "MEDIUM")}


def test_links_and_kinds(spark):
    assert one(spark, "https://drive.google.com/file/d/abc_1/view", C.resolved_link)["download"].endswith("id=abc_1")
    assert one(spark, "https://x.com/a", C.platform) == "twitter"
    assert one(spark, "https://max.com/a", C.platform) == "unsupported"
    assert not one(spark, "http://192.168.1.1/", C.is_allowed)
    assert one(spark, bytearray(b"%PDF-1.7"), C.sniffed, "binary") == ".pdf"
    assert one(spark, "<p>a<script>x</script></p><p>b&amp;c</p>", lambda h: P.lines(P.page(h)["text"])) == "a\nb&c"


def test_garbage(spark):
    assert [one(spark, t, detect.is_garbage) for t in ("ab", "aaaab", "#tag", "fine", "a-!?.", "###tag", "xzqlove")] == [True, True, False, False, True, True, True]


def test_clean_lines(spark):
    assert one(spark, "  Abc \nabc\n##!!\nxy\nDef 1", T.clean_lines) == "Abc\nDef 1"
