"""Line dedup over levelled sorted runs of line hashes, with DataFrame operations only.

A run is a table of line hashes, bucketed and sorted by hash, with the document that owns each line. Documents come in batches of
ascending doc_id. A batch reduces its lines to one row a hash (combined before the shuffle), merge-anti-joins the runs
and adds what is new as a run of level 0; FANOUT runs of one level are compacted into one of the next. A line stays where its
document owns it: the last anti-join is on hash and document, so a line that every document has is spread over all tasks.

Hashes have 128 bits: two xxHash64 of the key under different seeds.

Defined results: a null or empty text is one empty line; keys shorter than MIN_CHARS never count; rows with a null doc_id stay as
they are and count for nothing; repeated rows are one document with the same result each; a line that a document repeats stays
repeated in the document that owns it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exposark.llm.common import SPACES, needed, packed, place_of, shared_dir, stored, unpacked

MIN_CHARS = 10
FANOUT = 2
BATCHES = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(SPACES)), UPPER, LOWER)


def hashed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text), n (position), h1, h2 of each line whose key is long enough."""
    lines = needed(docs, "doc_id", "text").where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("row"), F.posexplode(split_lines(F.col("text"))).alias("n", "line"))
    keyed = lines.select("doc_id", "row", "n", line_key(F.col("line")).alias("key")).where(F.length("key") >= MIN_CHARS)
    return keyed.select("doc_id", "row", "n", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(0x9E3779B9), F.col("key")).alias("h2"))


class LineRuns:
    """Levels of sorted runs of (h1, h2, owner) in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.folder = shared_dir(spark, "line-runs")
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[str]] = [[]]

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows = df.select("h1", "h2", "owner").repartition(self.buckets, "h1", "h2")
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def owners(self) -> DataFrame:
        """h1, h2 and owner of every line seen."""
        out = None
        for t in self.tables():
            out = t if out is None else out.unionByName(t)
        return out if out is not None else self.spark.createDataFrame([], "h1 long, h2 long, owner long")

    def add(self, lines: DataFrame) -> None:
        """Take a batch of hashed lines, none of an id below those of earlier batches."""
        fresh = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
        for run in self.tables():
            fresh = fresh.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(fresh))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            merged = None
            for name in self.levels[level]:
                t = self.spark.table(name)
                merged = t if merged is None else merged.unionByName(t)
            self.levels[level + 1].append(self._write(merged))
            for name in self.levels[level]:
                self.spark.sql(f"DROP TABLE {name}")
            self.levels[level] = []
            level += 1

    def close(self) -> None:
        """Forget the runs' names; their files stay until the shared folder is cleared, since lazy results may still read them."""
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def batch_bounds(lines: DataFrame, batches: int) -> list[int]:
    """The ids at which batches of about equal numbers of lines begin, without the first."""
    if batches < 2:
        return []
    row = lines.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("at")).first()
    return sorted(set(row["at"] or []))


def dropped_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, row and the positions of the lines to drop."""
    spark = docs.sparkSession
    lines = stored(hashed_lines(docs), "line-hashes")
    runs = LineRuns(spark)
    try:
        edges = [None, *batch_bounds(lines, batches), None]
        for low, high in zip(edges, edges[1:], strict=False):
            batch = lines if low is None else lines.where(F.col("doc_id") >= low)
            runs.add(batch if high is None else batch.where(F.col("doc_id") < high))
        owners = runs.owners().withColumnRenamed("owner", "doc_id")
        out = lines.join(owners, ["h1", "h2", "doc_id"], "left_anti").groupBy("doc_id", "row").agg(F.collect_set("n").alias("dropped"))
        return stored(out, "dropped-lines")
    finally:
        runs.close()


def dedup_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The rows of docs with the text that is left, and n_lines (before) and n_dropped, which replace columns of these names. Other columns stay."""
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    kept = needed(docs, *names)
    left = _left(kept, batches)
    rows = left.select("own.*", "n_lines", "n_dropped")
    return rows.toDF(*names, "n_lines", "n_dropped")


def without_dropped_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The rows of docs with the text that is left, and no columns but those of docs, whatever their names. A column n_chars of whole numbers follows the text."""
    return unpacked(_left(docs, batches), docs)


def _left(docs: DataFrame, batches: int) -> DataFrame:
    """own (a struct of all columns, with the text that is left), n_lines and n_dropped of each row."""
    drops = dropped_lines(docs, batches)
    rows = packed(docs, "doc_id", "text").select("own", F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    joined = rows.join(drops, (F.col("id") == F.col("doc_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("row")), "left")
    counted = joined.withColumn("lines", split_lines(F.col("text"))).withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dropped", F.greatest(F.coalesce(F.size("dropped"), F.lit(0)), F.lit(0)).cast("long"))
    # array_except is linear in both arrays, unlike a search of one in the other for each line
    left = F.transform(F.array_except(F.sequence(F.lit(0), (F.col("n_lines") - 1).cast("int")), F.col("dropped")), lambda i: F.get("lines", i))
    kept = counted.withColumn("kept", F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.array_join(left, "\n")))
    own = F.col("own").withField(f"c{place_of(docs.columns, 'text')}", F.col("kept"))
    if "n_chars" in docs.columns:
        k = place_of(docs.columns, "n_chars")
        own = own.withField(f"c{k}", F.when(F.col("n_dropped") == 0, F.col(f"own.c{k}")).otherwise(F.length("kept").cast(docs.schema[k].dataType)))
    return kept.select(own.alias("own"), "n_lines", "n_dropped")
