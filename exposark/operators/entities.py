"""Which named entities stand: given entities (value, label) of any recogniser are tested by form, label and words, as a column expression.

The word lists are a parameter, as they are long and depend on what a corpus is about; DEFAULT holds the short ones that the rules themselves name. What a recogniser finds is
taken as it is: none runs here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Words:
    """Word lists in small letters: values that are no entities; words that say nothing; words of technology and study; libraries and languages; parts of no organisation's name; words of algorithms;
    places that are fields of reports."""

    excluded: tuple[str, ...] = ()
    noise: tuple[str, ...] = ()
    technical: tuple[str, ...] = ()
    libraries: tuple[str, ...] = ()
    no_organisation: tuple[str, ...] = ()
    algorithms: tuple[str, ...] = ()
    no_place: tuple[str, ...] = ()


# Short word lists of the rules, units of money, and forms of register numbers.
DEFAULT = Words(
    excluded=("paya se", "paya", "se", "paise", "payase", "english & 'o", "english & ‘o"),
    libraries=("sqlalchemy", "sqlite", "mysql", "postgres", "postgresql", "mongodb", "react", "vue", "angular", "flask", "django", "fastapi", "streamlit", "pandas", "numpy", "python", "java", "javascript", "typescript", "html", "css", "documentation", "library", "framework"),
    algorithms=("nearest", "neighbors", "clustering", "decomposition", "classifier", "regression", "boosting", "ensemble", "perceptron", "activation", "convolutional", "transformer", "embedding", "preprocessing", "hyperparameter", "gradient", "optimizer", "regularization", "normalization", "backpropagation", "overfitting", "underfitting", "sklearn", "scikit", "module", "import", "function", "class"),
    no_place=("documentation", "documentation.", "problem", "technical", "specifications", "report", "project", "system", "code", "design", "testing", "build"),
)
MONEY = ("$", "₹", "€", "£", "¥", "rs", "rupee", "rupees", "dollar", "dollars", "inr", "usd")
RELATIVE_DATES = ("this", "next", "last", "recent", "week", "month", "year", "today", "tomorrow", "yesterday", "relative", "temporal")
REGISTER_NUMBERS = r"^\d[a-zA-Z]{2}\d{2}[a-zA-Z]{2}\d{3}$|^[a-zA-Z]{2,4}\d{2}[a-zA-Z]{2}\d{3}$|^[uUpP]\d{2}[a-zA-Z]{2,4}\d{2}[a-zA-Z]{1,2}\d{3,6}$"
TECHNICAL_FORM = r"_|[a-z][A-Z]|[/\\]|\.[a-zA-Z_][a-zA-Z0-9_]|^(?i:k[-\s](nearest|means|fold|nn|svm|pca|medoids|armed|way))"


def _array(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def _one_of(value: Column, words: tuple[str, ...]) -> Column:
    return value.isin(*words) if words else F.lit(False)


def _has_any(value: Column, words: tuple[str, ...]) -> Column:
    return F.exists(_array(words), lambda w: F.contains(value, w)) if words else F.lit(False)


def stands(value: Column, label: Column, academic: Column | None = None, words: Words = DEFAULT) -> Column:
    """Whether an entity stands; false for a null value. academic: whether the text is a paper or certificate, where study and technology name nobody."""
    academic = F.lit(False) if academic is None else academic
    plain = F.trim(F.coalesce(value, F.lit("")))
    low = F.lower(plain)
    is_a = lambda *labels: label.isin(*labels)
    own = F.regexp_extract_all(low, F.lit(r"\b[a-z]{2,}\b"), F.lit(0))
    spoken = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    bare = lambda w: F.regexp_replace(w, "[^a-zA-Z0-9]", "")
    empty = F.forall(spoken, lambda w: _one_of(w, words.excluded) | _one_of(w, words.noise) | _one_of(bare(w), words.noise) | (F.length(bare(w)) < 3))
    heading = (F.upper(plain) == plain) & (low != plain) & (F.length(plain) > 4)
    technical = F.arrays_overlap(own, _array(words.technical)) if words.technical else F.lit(False)
    library = technical & F.arrays_overlap(own, _array(words.libraries)) if words.libraries else F.lit(False)
    taken = F.when(academic, technical & is_a("PERSON", "ORG", "GPE", "LOC", "DATE")).otherwise((technical & is_a("PERSON", "GPE", "LOC")) | (library & is_a("ORG")))
    no_person = plain.rlike(r"[0-9@#$!%^&*()\-+=]") | ((F.size(spoken) == 1) & (_one_of(low, words.noise) | (F.length(plain) < 4)))
    no_site = low.rlike("department|engineering|university|college|school") & low.rlike("college of|department of")
    long_words = F.regexp_extract_all(low, F.lit("[a-z]{3,}"), F.lit(0))
    no_firm = _has_any(low, words.no_organisation) | low.rlike("(&|and|or)$") | ((F.size(long_words) > 0) & (F.size(F.array_except(long_words, _array(words.algorithms))) == 0))
    joined, solid = F.regexp_replace(plain, r"\s+", ""), F.regexp_replace(plain, r"[\s\-]", "")
    no_date = academic | low.rlike(r"^\d{4}(-\d{2,4})?$") | _has_any(low, RELATIVE_DATES) | joined.rlike(r"^\d{13,19}$") | plain.rlike(r"^\d{4}\s\d{4}\s\d{4}(\s\d{4})?$")
    no_number = ~plain.rlike(r"\d") | F.contains(plain, F.lit(".")) | solid.rlike(r"^[6-9]\d{9}$|^\d{12,19}$")
    bad = (
        _one_of(low, words.excluded) | _one_of(low, words.noise) | empty | plain.rlike(TECHNICAL_FORM) | heading | taken | low.rlike(REGISTER_NUMBERS)
        | (is_a("PERSON") & no_person) | (is_a("ORG", "GPE", "LOC") & no_site) | (is_a("ORG") & no_firm) | (is_a("GPE", "LOC") & _one_of(low, words.no_place)) | (is_a("DATE") & no_date)
        | (is_a("MONEY") & ~_has_any(low, MONEY)) | (is_a("CARDINAL") & no_number)
    )
    return ~bad & (plain != "")
