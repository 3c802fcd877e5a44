"""The keyword automaton against patterns and plain searches, and its rules on awkward texts."""

from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from exposark.functions import tables
from exposark.operators import classify, doctype, keywords

SOME = sorted({w for w, _ in keywords.vocabulary()})


def plainly(text):
    """The numbers of the keywords by one pattern each."""
    low, out = text.lower(), []
    for (word, how), k in keywords.vocabulary().items():
        w = re.escape(word)
        edge = r"(?=\W|$)" if word[-1].isalnum() else r"(?=\w)"
        pattern = {keywords.ANYWHERE: w, keywords.CHANGES: rf"\b{w}\b", keywords.EDGES: rf"(?<!\w){w}{edge}"}[how]
        if re.search(pattern, low):
            out.append(k)
    return sorted(out)


@given(st.lists(st.one_of(st.sampled_from(SOME), st.sampled_from([" ", "", "_", "x", "É", "7", ".", "\n", "日"])), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_automaton_plainly(text):
    assert keywords.automaton().found(text) == plainly(text)


def test_each_rule_reads_its_own_keywords(spark):
    texts = [(i, " ; ".join(words)) for i, (_, _, words) in enumerate(tables.KEYWORD_RULES)] + [(98, None), (99, "")]
    out = {r["i"]: r["c"] for r in spark.createDataFrame(texts, "i int, text string").select("i", classify.keyword_class(F.col("text")).alias("c")).collect()}
    assert [out[i]["doc_type"] for i in range(len(tables.KEYWORD_RULES))] == [name for name, _, _ in tables.KEYWORD_RULES]
    assert out[98]["doc_type"] == out[99]["doc_type"] == "generic"


def test_type_rules_need_what_they_need(spark):
    rows = spark.createDataFrame([(1, "nationality and place of birth", []), (2, "passport, nationality", []), (3, "aadhaar", ["aadhaar"]), (4, "aadhaar", []), (5, "aadhaar vtu usn", []), (6, None, [])], "i int, text string, types array<string>")
    out = {r["i"]: r["inferred"]["doc_type"] for r in doctype.with_inferred(rows).collect()}
    assert out == {1: "generic", 2: "passport", 3: "aadhaar_card", 4: "generic", 5: "project_synopsis", 6: "generic"}


def test_the_two_ways_to_ask_for_papers_agree(spark):
    texts = [(i, t) for i, t in enumerate(["knn and k-means", "def f(x)", "sklearn", "objective; methodology", "a plain text", "Semester", "synopsises", "unit 1 references", "", None])]
    rows = spark.createDataFrame(texts, "i int, text string").withColumn("found", keywords.found(F.col("text")))
    both = rows.select("i", classify.is_academic(F.col("found"), classify.keyword_class_of(F.col("found"))["doc_type"]).alias("a"), classify.calm_in_row(F.lower(F.coalesce("text", F.lit("")))).alias("b")).collect()
    assert [r["a"] for r in both] == [r["b"] for r in both] and {r["a"] for r in both} == {True, False}


def test_work_is_one_pass_and_plans_are_small(spark):
    rows = doctype.with_inferred(spark.createDataFrame([(1, "x", [])], "i int, text string, types array<string>"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "rlike" not in plan.lower()
