"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Each source has a target in words. Its documents get the whole copies that the target makes certain; the rest of the target is a
sample of fixed size in words. Every document has an inclusion probability of its own, which falls with the length of its size in bits, so
that a source's extra words come from many documents rather than a few long ones: chance = min(1, c / bits), where c, one number
a source, makes the expected words of the sample the rest of the target. Documents are ranked by the odds of a uniform random number divided by the
odds of their chance (0 for those that are certain), and the lowest ranks are taken up to the words that are left. The random number
comes from a digest of id and text, so reruns agree.

Nothing is sorted in one task but small tables of stated size: sizes are summed by source and bits (some 40 rows a source) for c; words are
summed in about sqrt(documents) bins of the rank, the bin in which the sample ends is found from those sums, and only the documents of
that bin are ordered. What comes out of it is a row a source, the rank at which its sample ends, so each document's copies follow
from its own row, and texts are never shuffled. Places of sources in their order are counted by ranges, and the level up to which targets
rise is found by resharing the excess until no source is above its limit, one aggregate a time.

Defined results: a null or empty text has size 0 and takes 0; null is a source of its own, the last; repeated rows are rows
of their own, and rows equal in id and text are taken together or not at all; rows without an id are told apart by their texts; without
documents, or without words, nothing is taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposark.llm.common import needed, packed, stored, unpacked

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: A source table of up to so many rows is broadcast; a larger one is joined by key.
BROADCAST_SOURCES = 10_000
SALT = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column, salt: str = SALT) -> Column:
    """A number above 0 and below 1 from the first 52 bits of a digest of the id and of the text's digest."""
    own = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{salt}:"), F.md5(F.coalesce(text, F.lit(""))))
    bits = F.conv(F.substring(F.md5(own), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(2**52)


def placed(sources: DataFrame) -> DataFrame:
    """sources with place, from 0 by code point, null last: counted within ranges of sources, and from range to range by a row each."""
    ranged = sources.repartitionByRange(F.col("source").isNull(), "source").withColumn("range", F.spark_partition_id())
    ranged = stored(ranged, "mix-ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    counts = ranged.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("range").orderBy(F.col("source").isNull(), "source")
    return ranged.join(F.broadcast(counts), "range").withColumn("place", F.col("before") + F.row_number().over(inside) - 1).drop("range", "before")


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target. sources: source, source_size, one row a source.

    Targets go up to most times a source's size; what is beyond is shared by weight among the others, until none is above. The level, the
    words a unit of weight gets, only rises from turn to turn, and every turn but the last brings another source to its limit.
    """
    turn = F.col("place") % len(weights)
    weighted = placed(sources).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    weighted = weighted.withColumn("limit", (F.col("source_size") * most).cast("double"))
    weighted = stored(weighted, "mix-weights")
    words = weighted.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        free = F.col("limit") / F.col("weight") >= level
        row = weighted.agg(F.sum(F.when(~free, F.col("limit"))).alias("full"), F.sum(F.when(free, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        following = (words * share - (row["full"] or 0.0)) / row["open"]
        if following <= level:
            break
        level = following
    return weighted.select("source", "source_size", F.least("limit", F.col("weight") * level).alias("target"))


def bits_of(size: Column) -> Column:
    return F.length(F.bin(size))


def chance(c: Column, size: Column) -> Column:
    """The inclusion probability of a document; c over the length of its size in bits, at most 1."""
    return F.least(c / bits_of(size), F.lit(1.0))


def rank(u: Column, p: Column) -> Column:
    """Random odds divided by inclusion odds; null where the chance is 0."""
    return F.when(p > 0, (u / (1 - u)) * ((1 - p) / p))


def with_source(left: DataFrame, right: DataFrame, broadcast: bool) -> DataFrame:
    right = right.withColumnRenamed("source", "__source")
    return left.join(F.broadcast(right) if broadcast else right, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def plan(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> tuple[DataFrame, bool]:
    """A row a source: source, source_size, target, whole (copies of all its documents), rest (words to sample), c, bins, end_bin, end_rank; and whether that table is small enough to be broadcast.

    rows: source, size, u, one row a document.
    """
    counted = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(counted, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = stored(targets, "mix-targets")
    small = targets.agg(F.count("*").alias("n")).first()["n"] <= BROADCAST_SOURCES
    bins = max(1, math.isqrt(rows.agg(F.count("*").alias("n")).first()["n"]))

    # short documents reach chance 1 first: the first class whose chance stays below that tells c
    classes = rows.where("size > 0").groupBy("source", bits_of(F.col("size")).alias("bits")).agg(F.sum("size").alias("words"))
    w = Window.partitionBy("source").orderBy("bits")
    certain = F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum(F.col("words") / F.col("bits")).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = with_source(classes, targets.select("source", "rest"), small).withColumn("c", (F.col("rest") - certain) / others)
    levels = levels.where(F.col("c") / F.col("bits") <= 1).groupBy("source").agg(F.min_by("c", "bits").alias("c"))
    targets = stored(with_source(targets, levels, small), "mix-chances")

    ranked = with_source(rows.where("size > 0"), targets.select("source", "rest", "c"), small).where("rest > 0")
    ranked = ranked.select("source", "size", "rest", rank(F.col("u"), chance(F.col("c"), F.col("size"))).alias("rank")).where("rank IS NOT NULL")
    ranked = ranked.withColumn("bin", bin_of(F.col("rank"), bins))
    sums = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("until", F.sum("words").over(running)).where(F.col("until") > F.col("rest"))
    ends = ends.groupBy("source").agg(F.min(F.struct("bin", (F.col("until") - F.col("words")).alias("before"))).alias("end"))
    ends = stored(ends.select("source", F.col("end.bin").alias("end_bin"), F.col("end.before").alias("before")), "mix-ends")
    last = with_source(ranked, ends, small).where(F.col("bin") == F.col("end_bin"))
    in_order = Window.partitionBy("source").orderBy("rank").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("before") + F.sum("size").over(in_order) - F.col("size") / 2  # a document is in if its middle is
    taken = last.withColumn("in", middle <= F.col("rest")).where("in").groupBy("source").agg(F.max("rank").alias("end_rank"))
    out = with_source(with_source(targets, ends.drop("before"), small), taken, small)
    return stored(out.withColumn("bins", F.lit(bins).cast("long")), "mix-plan"), small


def bin_of(q: Column, bins: int | Column) -> Column:
    """Ranks go from 0 up without end; about half of a sample lies in the lower half of the bins. Certain documents are before all bins."""
    return F.when(q == 0, F.lit(-1)).otherwise(F.floor(q / (1 + q) * bins)).cast("long")


def copies(size: Column, u: Column) -> Column:
    """How often a document is taken, beside the row of its source's plan."""
    q = rank(u, chance(F.col("c"), size))
    at = bin_of(q, F.col("bins"))
    sampled = F.col("end_bin").isNull() | (at < F.col("end_bin")) | ((at == F.col("end_bin")) & F.coalesce(q <= F.col("end_rank"), F.lit(False)))
    extra = F.when((size > 0) & (F.col("rest") > 0) & q.isNotNull() & sampled, 1).otherwise(0)
    return (F.col("whole") + extra).cast("long")


def sized(docs: DataFrame, salt: str = SALT) -> DataFrame:
    """doc_id, source, size and u of each row."""
    text = F.col("text").cast("string")
    return needed(docs, "doc_id", "source", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), uniform(F.col("doc_id").cast("long"), text, salt).alias("u"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, salt: str = SALT) -> DataFrame:
    """doc_id, size, source_size, target of its source, taken (words the mix takes), copies, and chance (of a copy beyond the whole ones), for each row."""
    rows = stored(sized(docs, salt), "mix-sizes")
    table, small = plan(rows, weights, share, most)
    out = with_source(rows, table, small).withColumn("copies", copies(F.col("size"), F.col("u")))
    extra = F.when((F.col("size") > 0) & (F.col("rest") > 0), F.coalesce(chance(F.col("c"), F.col("size")), F.lit(0.0))).otherwise(0.0)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", extra.alias("chance"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, salt: str = SALT) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs, whatever their names. Documents without words are not taken."""
    table, small = plan(stored(sized(docs, salt), "mix-sizes"), weights, share, most)
    text = F.col("text").cast("string")
    own = packed(docs, "doc_id", "source", "text").select("own", F.col("source").cast("string").alias("source"), word_count(text).alias("size"), uniform(F.col("doc_id").cast("long"), text, salt).alias("u"))
    # words are counted once: a filter on size alone would be moved below the join and count them again
    taken = with_source(own, table, small).withColumn("copies", F.when(F.col("size") > 0, copies(F.col("size"), F.col("u"))).otherwise(0).cast("int")).where("copies > 0")
    return unpacked(taken.select("own", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")), docs)
