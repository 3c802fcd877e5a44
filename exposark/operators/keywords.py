"""All keywords of all rules found in one pass over a text, by an Aho-Corasick automaton in Arrow batches.

A keyword counts by one of three ways of standing in a text: anywhere in it; between word edges (what is before and behind is no letter, digit or underscore; behind a keyword that ends in
a sign, a word must begin); or at changes between word and other characters. ``found`` gives the numbers of the keywords that a text has, and rules are
expressions over that array: ``count(found, ids(...))``. So the work grows with the text and the hits, not with the number of keywords or rules.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from exposark.functions import tables

ANYWHERE, EDGES, CHANGES = "anywhere", "edges", "changes"
SECRET_WORDS = ("password", "login", "account", "bank", "otp", "email", "phone", "upi", "card", "username", "security")


def way(word: str) -> str:
    """How a keyword of the type rules stands in a text: short ones and phrases between edges, longer single words anywhere."""
    return ANYWHERE if len(word) > 4 and word.isalnum() else EDGES


@functools.cache
def vocabulary() -> dict[tuple[str, str], int]:
    """The number of each (keyword, way) of all rules."""
    every = [(w, CHANGES) for _, _, words in tables.KEYWORD_RULES for w in words]
    every += [(w, way(w)) for _, _, need, more, _ in tables.TYPE_RULES for w in need + more]
    every += [(w, way(w)) for w in tables.PAPER_WORDS] + [(w, ANYWHERE) for w in (*tables.ACADEMIC_WORDS, *SECRET_WORDS)]
    return {entry: k for k, entry in enumerate(dict.fromkeys(every))}


def is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def stands(low: str, begin: int, end: int, way: str) -> bool:
    """Whether low[begin:end] stands in low in the given way."""
    if way == ANYWHERE:
        return True
    before, behind = begin > 0 and is_word(low[begin - 1]), end < len(low) and is_word(low[end])
    if way == CHANGES:
        return before != is_word(low[begin]) and behind != is_word(low[end - 1])
    return not before and behind != low[end - 1].isalnum()


class Automaton:
    """Finds which of the numbered (keyword, way) entries a text has."""

    def __init__(self, entries: Iterable[tuple[tuple[str, str], int]]) -> None:
        import ahocorasick

        self.words: dict[str, list[tuple[str, int]]] = {}
        for (word, how), k in entries:
            self.words.setdefault(word, []).append((how, k))
        self.graph = ahocorasick.Automaton()
        for word, ways in self.words.items():
            self.graph.add_word(word, (len(word), ways))
        self.graph.make_automaton()

    def found(self, text: str) -> list[int]:
        low, hits = text.lower(), set()
        for last, (length, ways) in self.graph.iter(low):
            for how, k in ways:
                if k not in hits and stands(low, last + 1 - length, last + 1, how):
                    hits.add(k)
        return sorted(hits)


@functools.cache
def automaton() -> Automaton:
    return Automaton(vocabulary().items())


@functools.cache
def _finder():
    @F.arrow_udf("array<int>")
    def keywords_found(texts: pa.Array) -> pa.Array:
        find = automaton().found
        return pa.array([find(x) if x else [] for x in texts.to_pylist()], pa.list_(pa.int32()))

    return keywords_found


def found(text: Column) -> Column:
    """The numbers of all keywords in a text (null: none), in order. Not for use inside a lambda; bind it with withColumn where several rules read it."""
    return _finder()(F.coalesce(text.cast("string"), F.lit("")))


def ids(words: Iterable[str], how: str | None = None) -> list[int]:
    """The numbers of keywords, of the type rules unless a way is given."""
    return sorted({vocabulary()[w, how or way(w)] for w in words})


def count(found: Column, numbers: list[int]) -> Column:
    """How many of the keywords were found."""
    return F.size(F.array_intersect(found, F.expr(f"array({', '.join(map(str, numbers))})"))) if numbers else F.lit(0)


def any_of(found: Column, numbers: list[int]) -> Column:
    return F.arrays_overlap(found, F.expr(f"array({', '.join(map(str, numbers))})"))
