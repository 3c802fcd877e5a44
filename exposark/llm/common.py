"""Shared helpers of the training-data operators.

Every operator takes any DataFrame with ``doc_id`` and ``text``; other columns may be there under any name.
Null texts count as empty texts, repeated rows are kept as rows.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: The characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"

#: Bytes of an Arrow batch at most, or one row where that has more: all operators have the same bound, so none finds another's in the session.
BATCH_BYTES = 4 << 20


ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary()}
SPARK = {"long": LongType(), "string": StringType(), "boolean": BooleanType(), "double": DoubleType(), "int": IntegerType(), "binary": BinaryType()}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the folder that driver and executors share: the session's spark.checkpoint.dir.

    Where that is unset, a session of one machine gets a temporary folder for itself; on a cluster, whose executors would not see such a folder, this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own_dirs.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="exposark-shared-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_own_dirs: dict[str, str] = {}


def place_of(columns: list[str], name: str) -> int:
    """Where the column of a name is: the first in this case, else the first in any."""
    same = [i for i, c in enumerate(columns) if c == name] or [i for i, c in enumerate(columns) if c.lower() == name.lower()]
    if not same:
        raise ValueError(f"no column {name} in {columns}")
    return same[0]


def numbered(docs: DataFrame) -> DataFrame:
    """docs with its columns named by place, so that dots, equal names and names that differ in case alone do no harm."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def needed(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; of several such names the one in this case, else the first."""
    return numbered(docs).select(*(F.col(f"c{place_of(docs.columns, n)}").alias(n) for n in names))


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns beside all columns in one struct, own."""
    rows = numbered(docs)
    return rows.select(F.struct(*rows.columns).alias("own"), *(F.col(f"c{place_of(docs.columns, n)}").alias(n) for n in names))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, from own."""
    return rows.select("own.*").toDF(*docs.columns)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: the lineage ends there, and any executor may be lost afterwards."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def map_texts(docs: DataFrame, start: Callable[[], Callable[[str], tuple]], schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, what a function makes of each whole text, and the carried columns as strings. start() runs once in each task and returns that function."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = start()
        for batch in batches:
            rows = [one(x or "") for x in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            made = [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[2:]], ["doc_id", *names, *carry])

    types = [ARROW[x.strip().split(" ")[1]] for x in schema.split(",")]
    rows = needed(docs, "doc_id", "text", *carry).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).cast("string").alias(c) for c in carry))
    return map_batches(rows, run, ", ".join(["doc_id long", schema, *(f"{c} string" for c in carry)]))


def map_rows(docs: DataFrame, start: Callable[[], Callable[[str], tuple]], schema: str) -> DataFrame:
    """own, all columns of docs in one struct that passes through as it is, and what a function makes of each whole text."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    types = [ARROW[x.strip().split(" ")[1]] for x in schema.split(",")]
    at = place_of(docs.columns, "text")
    rows = packed(docs).select("own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = start()
        for batch in batches:
            own = batch.column(0)
            made = [one(x or "") for x in own.field(at).to_pylist()]
            columns = list(zip(*made, strict=True)) if made else [()] * len(names)
            yield pa.RecordBatch.from_arrays([own, *(pa.array(c, type=t) for c, t in zip(columns, types, strict=True))], ["own", *names])

    result = StructType([*rows.schema.fields, *(StructField(n, SPARK[x.strip().split(" ")[1]]) for n, x in zip(names, schema.split(","), strict=True))])
    return map_batches(rows, run, result)


def sha256(text: str | bytes) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).hexdigest()


def span_text(spans: list[tuple[int, int, int, str]]) -> str:
    """spans of (start, rank of the kind, end, kind) as kind:start:end by start, then rank."""
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans))
