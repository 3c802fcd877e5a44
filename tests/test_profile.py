"""The document queries over a corpus with findings of every type, against values worked out by hand."""

from __future__ import annotations

import pytest

from exposark import catalogue

DOCS = (
    (1, "CVV: 123", {"cvv"}, 40.0, "HIGH"),
    (2, "Your OTP is 482913", {"otp"}, 30.0, "MEDIUM"),
    (3, "call 9876543210 today", {"phone"}, 15.0, "MEDIUM"),
    (4, "DOB: 15/08/1995", {"dob"}, 25.0, "MEDIUM"),
    (5, "Patient name: Asha Rao", {"person_name"}, 15.0, "MEDIUM"),
    (6, "ID No: EMP-4411", {"id_number"}, 15.0, "MEDIUM"),
    (7, "mail a.b@example.org or 9876543210", {"email", "phone"}, 33.0, "MEDIUM"),
    (8, "card 4532015112830366 CVV: 123", {"credit_card", "cvv"}, 78.0, "HIGH"),
    (9, "nothing at all", set(), 0.0, "LOW"),
    (10, None, set(), 0.0, "LOW"),
)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("profile"))
    spark.createDataFrame([(i, t, "en", "s") for i, t, *_ in DOCS], "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return path


def rows(spark, sf, name):
    return sorted(map(tuple, catalogue.QUERIES[name](spark, sf).collect()))


def test_every_type_is_counted(spark, sf):
    assert rows(spark, sf, "doc_finding_counts") == sorted((i, t, 1) for i, _, types, *_ in DOCS for t in types)


def test_every_type_is_scored(spark, sf):
    assert rows(spark, sf, "doc_exposure_score") == [(i, s, r) for i, _, _, s, r in DOCS]
    assert rows(spark, sf, "doc_without_findings") == [(9,), (10,)]


def test_scenarios_of_the_other_types(spark, sf):
    fired = {(r[0], r[1]) for r in rows(spark, sf, "scenario_division")}
    assert {(3, "sim_swap"), (7, "account_takeover"), (8, "cvv_card_fraud"), (2, "otp_account_takeover")} <= fired
    assert (8, "card_cloning") in fired
