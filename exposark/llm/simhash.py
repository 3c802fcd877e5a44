"""SimHash near-dedup with covering locality-sensitive hashing.

For radius r each of the 64 bits gets a vector of r + 1 bits, and each non-zero vector v makes a table: its key keeps the bits whose
vector has an odd product with v. The vectors of up to r differing bits span less than the whole space, so some v has an even product
with each of them, and in that table the two fingerprints collide: all pairs within the radius meet in some of the 2^(r+1) - 1 tables.

Equal fingerprints are one node. Within a bucket the nodes are compared in blocks, and only a spanning forest of the links
leaves the task, never all pairs. A bucket too large for that is linked through shared neighbours: two fingerprints within 4
bits have a common one within 2 bits of either, so the smallest node at each such neighbour connects all that meet there.
Components come from alternating large-star and small-star steps, each written to the shared folder.

Defined results: a text without words (null, empty) has fingerprint zero and links as any other; rows with a null doc_id have a
fingerprint and the component of their fingerprint, which is null if no row with an id is in it; repeated rows get the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposark.llm.common import map_batches, map_texts, packed, stored, unpacked

SHINGLE = 4
SEED = 42
BITS = 64
RADIUS = 4
#: A bucket of up to so many different fingerprints is compared in one task; a larger one is linked through shared neighbours.
LARGEST_BUCKET = 4096
BLOCK = 512
ROWS = 1 << 16


def hashes(text: str, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The hashes of all shingles of a whole text, in pieces."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z only, and space and U+0009 to U+000D only
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < shingle:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), ROWS):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + ROWS].tolist(), ends[i : i + ROWS].tolist(), strict=True)], np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes, as a signed number."""
    counts = np.zeros(BITS, np.int64)
    n = 0
    for h in hashes(text, shingle):
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        n += len(h)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (signed long) of each row."""
    def start() -> Callable[[str], tuple]:
        return lambda text: (fingerprint(text, shingle),)

    return map_texts(docs, start, "fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The masks of the tables, as signed numbers. The bits' vectors are dealt out evenly over all non-zero ones."""
    size = 1 << (radius + 1)
    vectors = [1 + b % (size - 1) for b in range(bits)]
    masks = [sum(1 << b for b, a in enumerate(vectors) if (a & v).bit_count() % 2) for v in range(1, size)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what all links within the radius connect, at most one less than there are values."""
    n = len(values)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    joined = np.arange(n)
    bits = values.view(np.uint64)  # of signed numbers, bitwise_count would count the bits of the absolute value
    for i in range(0, n, BLOCK):
        rows, columns = np.nonzero(np.bitwise_count(bits[i : i + BLOCK, None] ^ bits[None, :]) <= radius)
        rows += i
        keep = (rows < columns) & (joined[rows] != joined[columns])
        rows, columns = rows[keep], columns[keep]
        # links to what is already joined say nothing new; so that a dense block costs little, each row is tried against one of each set first
        for a, b in zip(rows.tolist(), columns.tolist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(values[a]), int(values[b])))
        joined = np.array([root(k) for k in range(n)])
    return out


def _bucket_links(masks: list[int], radius: int, largest: int) -> Callable:
    """From (i, fp) sorted by table and key: links (a, b, null), and the members (fp, null, table) of buckets that are too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.array(masks, np.int64)
        rest_i, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        passed: tuple[int, int] | None = None  # the bucket that is being handed on as too large

        def emit(found: list[tuple[int, int | None, int | None]]) -> pa.RecordBatch:
            a, b, i = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(i, pa.int32())], ["a", "b", "i"])

        def links(i: np.ndarray, fp: np.ndarray, last: bool) -> tuple[list, np.ndarray, np.ndarray]:
            nonlocal passed
            key = fp & mask[i]
            cuts = np.flatnonzero((i[1:] != i[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate(([0], cuts)) if len(i) else np.zeros(0, np.int64)
            ends = np.concatenate((cuts, [len(i)])) if len(i) else np.zeros(0, np.int64)
            found: list = []
            kept = len(i)
            sizes = ends - starts
            for k in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == len(sizes) - 1) | (np.arange(len(sizes)) == 0)).tolist():
                a, b = int(starts[k]), int(ends[k])
                this = (int(i[a]), int(key[a]))
                if this == passed or b - a > largest:
                    found += [(x, None, this[0]) for x in fp[a:b].tolist()]
                    passed = this
                elif k == len(sizes) - 1 and not last:
                    kept = a  # it may go on in the next batch
                elif b - a > 1:
                    found += [(x, y, None) for x, y in forest(fp[a:b], radius)]
            return found, i[kept:], fp[kept:]

        for batch in batches:
            i = np.concatenate((rest_i, batch.column(0).to_numpy().astype(np.int64)))
            fp = np.concatenate((rest_fp, batch.column(1).to_numpy().astype(np.int64)))
            found, rest_i, rest_fp = links(i, fp, last=False)
            yield emit(found)
        yield emit(links(rest_i, rest_fp, last=True)[0])

    return run


def links(nodes: DataFrame, radius: int = RADIUS, largest: int = LARGEST_BUCKET) -> DataFrame:
    """Links (a, b) between different fingerprints that connect exactly what lies within the radius. nodes: fp, each once."""
    if radius != 4:
        raise ValueError("large buckets are linked through neighbours within 2 bits, which fits a radius of 4")
    masks = covering_masks(radius)
    keyed = nodes.select(F.posexplode(F.array(*map(F.lit, masks))).alias("i", "mask"), "fp")
    key = F.col("fp").bitwiseAND(F.element_at(F.array(*map(F.lit, masks)), F.col("i") + 1))
    dealt = keyed.select("i", "fp").repartition("i", key).sortWithinPartitions("i", key)
    found = stored(map_batches(dealt, _bucket_links(masks, radius, largest), "a long, b long, i int"), "simhash-links")
    direct = found.where("b IS NOT NULL").select("a", "b")
    # neighbours differ from a member in up to 2 of the bits that its table does not keep
    unkept = [[b for b in range(BITS) if not (m >> b) & 1] for m in masks]
    flips = F.array(*(F.array(*(F.lit(1 << b if b < 63 else -(1 << 63)) for b in row)) for row in unkept))
    large = found.where("b IS NULL").select(F.col("a").alias("fp"), F.element_at(flips, F.col("i") + 1).alias("bits"), "i")
    one = large.select("fp", "i", F.explode(F.concat(F.array(F.lit(0).cast("long")), "bits")).alias("x"), "bits")
    two = one.select("fp", "i", F.explode(F.filter(F.concat(F.array(F.lit(0).cast("long")), "bits"), lambda y: (y == 0) | ((F.col("x") != 0) & (y > F.col("x"))))).alias("y"), "x")
    near = two.select("fp", F.col("fp").bitwiseXOR(F.col("x")).bitwiseXOR(F.col("y")).alias("at"))
    hubs = near.groupBy("at").agg(F.min("fp").alias("hub"))
    through = near.join(hubs, "at").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()
    return direct.unionByName(through)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the smallest node it is connected to) of each node that has a link. edges: a, b."""
    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # what a node is linked to below itself, and the node, go to the smallest of those
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        current = stored(small, "stars")
        now = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
    raise RuntimeError(f"links did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, largest: int = LARGEST_BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id that links reach) of each row."""
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprint-nodes")
    found = links(nodes.select("fp"), radius, largest)
    named = nodes.where("node IS NOT NULL")
    named = found.join(named.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(named.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    roots = components(named.select(F.col("x").alias("a"), F.col("y").alias("b")))
    ids = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that are the smallest of their component, one row for each such id. Rows with a null doc_id stay."""
    found = near_duplicates(docs, shingle, radius)
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    rows = packed(docs, "doc_id").select("own", F.col("doc_id").cast("long").alias("id"))
    kept = rows.where("id IS NOT NULL").join(first, "id", "left_semi").dropDuplicates(["id"]).select("own")
    return unpacked(kept.unionByName(rows.where("id IS NULL").select("own")), docs)
