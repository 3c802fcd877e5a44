"""Importance resampling towards a target: documents that read like the target's texts are drawn more often.

Features are runs of one to three words, hashed into BUCKETS buckets. A first job counts the buckets of the corpus and of the target; each task
adds up its own first, so only totals are shuffled, and BUCKETS rows, no more at any size, come to the driver. They become one literal array of gains (a
thousand times the log ratio of the smoothed shares). Scoring does not explode: higher-order functions make each document's array of buckets, once,
in a table of about the size of the texts, and add up the gains that its buckets have in the literal.

The draw takes the highest scores under Gumbel noise, which is a sample without replacement in proportion to the weights. Only rows above a safe lower
quantile are put in order, in ranges of score and doc_id, so that ties part too; the ranges' exact counts tell the rank at which each begins, and rows are
numbered within ranges.

Defined results: a null or empty text has no words, no features and weight 0; it gets a score like any other and is never drawn, having under MIN_WORDS words. A
null doc_id counts as an empty string in the hash. Repeated rows are rows, each with its own rank. Equal scores go by doc_id, then by features and weight. An empty corpus gives no
rows; with an empty target all gains follow from the smoothing alone. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposark.llm.common import needed, stored
from exposark.llm.lines import LOWER, UPPER

BUCKETS = 10000
LONGEST_RUN = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: Rows that may be drawn are sorted in parts of about a twentieth of this; and the accuracy of the quantile that tells which may.
PART_ROWS = 10_000_000
ACCURACY = 10_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Letters, digits and everything beyond ASCII, in runs, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def buckets(words: Column, n_buckets: int = BUCKETS) -> Column:
    """The bucket, from 1, of every run of one to LONGEST_RUN words: an array as long as the document has features."""
    runs = [words]
    for n in range(2, LONGEST_RUN + 1):  # a run is the run before it, one word shorter, and the next word; the last ones have none
        runs.append(F.zip_with(runs[-1], F.slice(words, F.lit(n), F.size(words)), lambda run, word: F.concat(run, F.lit(" "), word)))
    return F.transform(F.array_compact(F.concat(*runs)), lambda run: (F.crc32(run.cast("binary")) % n_buckets + 1).cast("int"))


def bucketed(texts: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """doc_id (null where texts have none), n_words and buckets of every row."""
    ids = ("doc_id",) if any(c.lower() == "doc_id" for c in texts.columns) else ()
    rows = needed(texts, *ids, "text")
    cut = rows.select((F.col("doc_id") if ids else F.lit(None)).cast("long").alias("doc_id"), words(F.col("text")).alias("words"))
    return cut.select("doc_id", F.size("words").cast("long").alias("n_words"), buckets(F.col("words"), n_buckets).alias("buckets"))


def bucket_totals(rows: DataFrame) -> DataFrame:
    """bucket and n, how many features of all rows fall into it; buckets without any are missing."""
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(corpus: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, in order, from bucketed rows: floor(1000 ln) of the ratio of its smoothed shares in the target and in the corpus."""
    s, t = ({r["bucket"]: r["n"] for r in bucket_totals(rows).collect()} for rows in (corpus, target))  # n_buckets rows at any size
    all_s, all_t = float(sum(s.values()) + n_buckets), float(sum(t.values()) + n_buckets)
    ratio = lambda b: float(t.get(b, 0) + 1) * all_s / (float(s.get(b, 0) + 1) * all_t)
    return [math.floor(1000 * math.log(ratio(b))) for b in range(1, n_buckets + 1)]


def gain_literal(values: list[int]) -> Column:
    """The gains as one array; the optimizer folds the text into a literal once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A thousand times a Gumbel deviate, from a hash of seed and doc_id, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(rows: DataFrame, values: list[int], seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every bucketed row, without a shuffle."""
    literal = gain_literal(values)
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(literal, b))
    weighed = rows.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(rows: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """rows (a stored table with doc_id, n_words, n_features, weight and score) and rank: 1, 2, 3 ... for those drawn, null for the others."""
    may = F.col("n_words") >= min_words
    n = rows.where(may).count()
    draw = percent * n // 100
    if draw == 0:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    # the quantile errs by one part in ACCURACY at most: with twice that to spare, all drawn rows are at or above it
    low = rows.where(may).agg(F.percentile_approx("score", F.lit(max(0.0, 1 - draw / n - 2 / ACCURACY)), F.lit(ACCURACY))).first()[0]
    high = may & (F.col("score") >= low)
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("weight")]
    n_parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // PART_ROWS)
    parted = stored(rows.where(high).repartitionByRange(n_parts, *order).withColumn("part", F.spark_partition_id()), "importance-parts")
    before, seen = {}, 0
    for row in parted.groupBy("part").count().orderBy("part").collect():  # n_parts rows at most
        before[row["part"]] = seen
        seen += row["count"]
    starts = F.split(F.lit(",".join(str(before.get(p, 0)) for p in range(n_parts))), ",").cast("array<bigint>")
    place = F.get(starts, F.col("part")) + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    drawn = parted.withColumn("rank", place).drop("part").withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return drawn.unionByName(rows.where(~high).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs; percent of those of min_words words or more have a rank."""
    rows = stored(bucketed(docs), "importance-buckets")
    return ranked(stored(scored(rows, gains(rows, bucketed(target)), seed), "importance-scores"), percent, min_words)
