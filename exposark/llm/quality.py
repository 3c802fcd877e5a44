"""Quality rules: fixed base rules, and a decision list learned by sequential covering and emitted as Spark conditionals.

The list is grown one rule at a time on labelled documents: a rule starts empty and takes the threshold test that gains most
(FOIL's gain), until it covers no document of the other class; it is then pruned on the part of the sample that it was not grown
on, and kept only if it is precise there. Documents that a rule covers leave the sample, and the next rule is grown. What no rule
covers is kept.

Defined results: a null or empty text has no words, fails the base rules (fewer than 50 words) and is not kept. Without
labels of both classes the list is empty. Repeated rows each get their own result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposark.llm.common import SPACES, map_rows, map_texts, needed, unpacked

WORD = re.compile(r"[^\x20\x09-\x0D]")
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

#: The learner sees so many labelled documents at most, taken by a hash of their id: a documented bound, so that fitting stays on the driver.
MAX_LABELLED = 8000
MAX_RULES = 8
MAX_TESTS = 3
MIN_PRECISION = 0.95
MIN_COVERED = 5

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_lines")


def repeated_words(words: list) -> int:
    """Words that lie in a window of three words which is in the text twice or more, the first one included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: set = set()
    twice = {w for w in windows if w in seen or seen.add(w)}
    covered = 0
    until = 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + 3 - max(i, until)
            until = i + 3
    return covered


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set = set()
    count = 0
    for line in lines:
        if line in seen:
            count += bool(WORD.search(line))
        else:
            seen.add(line)
    return count


def text_stats(text: str) -> tuple:
    """STATS of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at space and U+0009 to U+000D only
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        duplicate_lines(text),
        repeated_words(words),
        len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        len(raw) - len(raw.translate(None, b"0123456789")),
        text.count("\n") + 1,
    )


def stats(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of each whole text."""
    return map_texts(docs, lambda: text_stats, ", ".join(f"{x} long" for x in STATS))


#: What rules test: ratios of the statistics, so that they hold for texts of any length.
FEATURES: dict[str, tuple[str, str | None]] = {
    "words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "repeated_per_word": ("n_repeat_words", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
}


def feature(name: str) -> Column:
    """A feature as a Spark expression; a ratio to nothing is 0."""
    above, below = FEATURES[name]
    if below is None:
        return F.col(above).cast("double")
    return F.when(F.col(below) == 0, F.lit(0.0)).otherwise(F.col(above) / F.col(below))


@dataclass(frozen=True)
class Test:
    name: str
    over: bool  # value > threshold, else value <= threshold
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.name] > self.threshold if self.over else table[self.name] <= self.threshold

    def column(self) -> Column:
        return feature(self.name) > self.threshold if self.over else feature(self.name) <= self.threshold


def covers(rule: list[Test], table: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for test in rule:
        out &= test.holds(table)
    return out


def grow(table: dict[str, np.ndarray], bad: np.ndarray) -> list[Test]:
    """A conjunction that covers bad rows and, as far as MAX_TESTS tests can, no others."""
    rule: list[Test] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_TESTS and (~bad[inside]).any():
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        best, gain = None, 1e-9
        for name, values in table.items():
            v, b = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            cuts = np.flatnonzero(v[1:] > v[:-1])
            below_p, below_n = np.cumsum(b)[cuts], np.cumsum(~b)[cuts]
            for over, cp, cn in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(cp > 0, cp * (np.log2(cp / np.maximum(cp + cn, 1)) - np.log2(p / (p + n))), 0)
                if len(g) and g.max() > gain:
                    k = int(g.argmax())
                    best, gain = Test(name, over, float((v[cuts[k]] + v[cuts[k] + 1]) / 2)), float(g[k])
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(table)
    return rule


def prune(rule: list[Test], table: dict[str, np.ndarray], bad: np.ndarray) -> list[Test]:
    """The prefix of the rule with the best (p - n) / (p + n) on rows that it was not grown on; the longer one on a tie."""

    def worth(tests: list[Test]) -> float:
        c = covers(tests, table, len(bad))
        return (2 * int((bad & c).sum()) - int(c.sum())) / max(1, int(c.sum()))

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=[])


def learn(table: dict[str, np.ndarray], bad: np.ndarray, grown: np.ndarray) -> list[list[Test]]:
    """An ordered list of rules for bad rows. grown marks the rows to grow on; the others prune."""
    rules: list[list[Test]] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES and (bad & left & grown).sum() >= MIN_COVERED:
        part = lambda rows: ({k: v[rows] for k, v in table.items()}, bad[rows])
        rule = prune(grow(*part(left & grown)), *part(left & ~grown))
        covered = covers(rule, table, len(bad)) & left
        if not rule or (bad & covered).sum() < MIN_COVERED or (bad & covered).sum() < MIN_PRECISION * covered.sum():
            break
        rules.append(rule)
        left &= ~covered
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[list[Test]]:
    """The decision list learned from at most max_labelled documents with a quality label (0: bad). Equal inputs, equal list."""
    chosen = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)
    ids = chosen.select("doc_id").distinct()
    marked = needed(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(ids), "doc_id")  # the limit bounds what is broadcast
    rows = stats(marked).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", *(feature(k).alias(k) for k in FEATURES)).where(~base_fails_features()).dropDuplicates()
    # rows of one id may be many: the bound holds for rows too
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *FEATURES).limit(max_labelled).toPandas()
    rows = rows.sort_values(["doc_id", "quality", *FEATURES], kind="stable")
    table = {k: rows[k].to_numpy(float) for k in FEATURES}
    return learn(table, (rows["quality"] == 0).to_numpy(), rows["doc_id"].to_numpy() % 3 != 0)


def base_fails_features() -> Column:
    return (F.col("words") < MIN_WORDS) | (F.col("repeated_per_word") * 100 > MAX_REPEATED_PERCENT)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def verdict(rules: list[list[Test]]) -> Column:
    """The list as one ordered Spark conditional: the number of the first rule that covers the row, else 0."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = rule[0].column()
        for x in rule[1:]:
            test = test & x.column()
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def describe(rules: list[list[Test]]) -> list[str]:
    """The rules to read."""
    return [" and ".join(f"{x.name} {'>' if x.over else '<='} {x.threshold:g}" for x in rule) for rule in rules]


def judged(rows: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """rows (with STATS) with base_failed, the number of the rule that rejects the row (0: none), and kept."""
    return (
        rows.withColumn("base_failed", base_failed())
        .withColumn("rule", verdict(rules).cast("int"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    )


def judge(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """doc_id, STATS, base_failed, the number of the rule that rejects the row (0: none), and kept."""
    return judged(stats(docs), rules)


def kept_rows(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs, whatever their names. Each row is judged by its own text, on its way through, so nothing is shuffled."""
    rows = map_rows(docs, lambda: text_stats, ", ".join(f"{x} long" for x in STATS))
    return unpacked(judged(rows, rules).where("kept"), docs)
