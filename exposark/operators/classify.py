"""Document classes from keywords."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposark.functions import tables
from exposark.operators import keywords


def keyword_class(text: Column, filename: Column | None = None) -> Column:
    """struct(confidence, order, doc_type) by the words of a text and its file name: of the rules with enough keywords the one with most (three count at most), the first on a tie."""
    return keyword_class_of(keywords.found(F.concat_ws(" ", text, filename) if filename is not None else text))


def keyword_class_of(found: Column) -> Column:
    """The same from the keywords found."""

    def fit(i: int, name: str, least: int, words: tuple) -> Column:
        n = keywords.count(found, keywords.ids(words, keywords.CHANGES))
        sure = F.least(F.lit(0.55) + F.least(n, F.lit(3)) / 3.0 * 0.35, F.lit(0.89))
        return F.when(n >= least, F.struct(F.round(sure, 4).alias("confidence"), F.lit(-i).alias("order"), F.lit(name).alias("doc_type")))

    nothing = F.struct(F.lit(0.0).alias("confidence"), F.lit(0).alias("order"), F.lit("generic").alias("doc_type"))
    return F.coalesce(F.array_max(F.array(*(fit(i, *rule) for i, rule in enumerate(tables.KEYWORD_RULES)))), nothing)


def is_academic(found: Column, doc_type: Column) -> Column:
    """Whether a text is a paper, a certificate or a program, by the keywords found."""
    return doc_type.isin(*tables.CALM_TYPES) | keywords.any_of(found, keywords.ids(tables.ACADEMIC_WORDS, keywords.ANYWHERE))


def calm_in_row(low: Column) -> Column:
    """Whether a lower-cased text is academic, as an expression that may stand in a branch: detectors ask it of the few texts with tokens that look like passwords, so those alone pay for it."""
    hits = lambda words: F.size(F.filter(words, lambda w: F.contains(low, w) & F.rlike(low, F.concat(F.lit(r"\b"), w, F.lit(r"\b")))))
    counted = [(name, least, hits(F.array(*map(F.lit, words)))) for name, least, words in tables.KEYWORD_RULES]
    first = F.array_max(F.array(*(F.when(n >= least, F.struct(F.least(n, F.lit(3)).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("doc_type"))) for i, (name, least, n) in enumerate(counted))))
    return F.exists(F.array(*map(F.lit, tables.ACADEMIC_WORDS)), lambda w: F.contains(low, w)) | F.coalesce(first["doc_type"].isin(*tables.CALM_TYPES), F.lit(False))


def with_evidence(doc_type: Column, types: Column) -> Column:
    """The type, or generic where it needs findings of a type that is not there."""
    out = doc_type
    for name, needed in tables.NEEDED_EVIDENCE.items():
        out = F.when((doc_type == name) & ~F.arrays_overlap(types, F.array(*map(F.lit, needed))), F.lit("generic")).otherwise(out)
    return out


def boost(doc_type: Column) -> Column:
    from exposark.operators.score import lookup

    return lookup(doc_type, tables.TYPE_BOOST, 0)


def exposure_class(platform: Column, fields: Column, findings: Column) -> Column:
    """How a public profile exposes its owner: public_business, personal_exposure, anonymous or professional_public. fields: a map; findings: an array of (type, value)."""
    field = lambda *names: F.lower(F.coalesce(*(F.nullif(F.try_element_at(fields, F.lit(n)), F.lit("")) for n in names), F.lit("")))
    bio, user, shown, place = field("bio", "headline"), field("username", "handle"), field("display_name"), field("location")
    business = (F.lower(platform) == "linkedin") | bio.rlike("company|ceo|founder|official|business|corp|inc|director")
    own_mail = F.exists(findings, lambda f: (f["type"] == "email") & F.lower(f["value"]).rlike(r"gmail\.com|yahoo\.com|hotmail\.com|outlook\.com|protonmail\.com"))
    phone = F.exists(findings, lambda f: f["type"] == "phone")
    contact = F.exists(findings, lambda f: f["type"].isin("email", "phone"))
    nobody = ((shown == "") | (shown == user)) & (F.length(F.trim(bio)) < 5) & ~contact & (user.rlike("bot|anon|user|guest|temp") | (F.length(user) < 3))
    return F.when(business, "public_business").when(own_mail & phone & (F.length(place) > 2), "personal_exposure").when(nobody, "anonymous").otherwise("professional_public")


def snippet(text: Column, filename: Column, most: int = 600) -> Column:
    """What a model reads of a text: without runs of signs, long hex and what is not printable ASCII, behind the file's name."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"([^a-zA-Z0-9\s])\1{3,}", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\b[0-9a-fA-F]{10,}\b", " "), r"[^\x20-\x7E\n\t]", " ")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    named = F.when(F.coalesce(filename, F.lit("")) != "", F.concat(F.lit("Document: "), filename, F.lit("\n\n"), out)).otherwise(out)
    return F.substring(named, 1, most)
