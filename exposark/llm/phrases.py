"""Phrase collocation mining: runs of two or three words that stand together more often than their parts let expect.

Counting all runs of words exactly would shuffle mostly runs that occur once or twice. So a first job only sketches: each task hashes its runs of one to three
words and counts hashes into ROWS rows of cells, sparsely and in pieces of bounded size; cells of all tasks are added up by block, as a stream, and what remains is one bit
a cell: reached MIN_COUNT or not. Cells only overestimate, so a run of MIN_COUNT occurrences has its bit set in every row. Counts stop at MIN_COUNT everywhere, since a sum that
counts more says nothing more. A second job counts exactly those runs whose bits are all set, in each task first, then by shuffle, and drops those that are rarer after all. Parts
of a frequent run are at least as frequent as the run, so all numbers that the scores need are among the survivors: joins of counts with counts finish the work.

The sketch has about one cell for eight characters, and at most MOST_CELLS a row, so that its bits (ROWS * MOST_CELLS / 8 bytes) fit every worker. Beyond
8 * MOST_CELLS characters it lets ever more rare runs pass, which costs a larger exact count and changes no result.

Defined results: a null or empty text has no words; a null lang is `und`, and counts together with texts that say so. Repeated rows count as often as they are there. Phrases
never cross a piece's end. Of equal phrases there is one row a language. Other columns are not read, whatever their names. No rows, no phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposark.llm.common import map_batches, needed, stored

MIN_COUNT = 10
SUBSUMED_PERCENT = 50
TOP = 2000
UNKNOWN = "und"
ENDS = r"[.,;:!?\x0A-\x0D]"
LONGEST = 3

ROWS = 2
FEWEST_CELLS, MOST_CELLS = 1 << 16, 1 << 28
CHARS_A_CELL = 8
#: Each row of the sketch is added up in so many blocks, all equally full.
BLOCKS = 2048
#: Bytes of text that are hashed or counted together, or one text where that has more.
PIECE_BYTES = 2 << 20
#: Cells of a row of the sketch that a task holds before it passes them on, and the shares of its blocks in which it adds them up, so that what is added takes little beside what is held.
PENDING = 8 << 20
SECTIONS = 16
#: The first phrases of a language are found in so many shares of its phrases before they are found among those.
SHARES = 16

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Piece:
    """Words of several texts as numbers: word (place in the vocabulary, -1 at the ends of pieces and texts) and lang (place in langs) of each place."""

    def __init__(self, langs: pa.Array, texts: pa.Array) -> None:
        cut = pc.replace_substring_regex(pc.ascii_lower(texts), ENDS, " \n ")
        # an end of piece is a word "\n" of its own, and each text ends with one; words have no line ends themselves
        words = pc.split_pattern_regex(pc.binary_join_element_wise(cut, pa.scalar("\n"), " "), "[ \t]+")
        flat, parent = words.flatten(), pc.list_parent_indices(words)
        some = pc.not_equal(flat, "")
        coded = flat.filter(some).dictionary_encode()
        self.vocabulary = coded.dictionary
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        end = pc.index(self.vocabulary, "\n").as_py()
        self.word = np.where(word == end, -1, word)
        lang = langs.dictionary_encode()
        self.langs = lang.dictionary.to_pylist()
        self.lang = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[parent.filter(some).to_numpy()]

    def runs(self) -> Iterator[tuple[int, np.ndarray]]:
        """For n = 1, 2, 3 the places at which n words in a row begin."""
        inside = self.word >= 0
        at = inside
        for n in range(1, LONGEST + 1):
            if n > 1:
                at = at[:-1] & inside[n - 1 :] if len(at) else at
            yield n, np.flatnonzero(at)

    def hashes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For n = 1, 2, 3 the places of the runs and a hash of language and words of each."""
        of_word = _mixed(pd.util.hash_array(np.array(self.vocabulary.to_pylist(), dtype=object), categorize=False)) if len(self.vocabulary) else np.zeros(0, np.uint64)
        of_lang = _mixed(pd.util.hash_array(np.array(self.langs, dtype=object), categorize=False)) if self.langs else np.zeros(0, np.uint64)
        at_place = of_word[self.word]  # ends of pieces get some number too: no run includes them
        for n, at in self.runs():
            h = of_lang[self.lang[at]]
            for k in range(n):
                h = _mixed(h * _MIX + at_place[at + k])
            yield n, at, h


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    """The rows (lang, text) of all batches in pieces of about PIECE_BYTES or one text."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
        begin, done = 0, 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(sizes, done + PIECE_BYTES, side="right")))
            yield Piece(batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin))
            begin, done = end, int(sizes[end - 1])


def cells_of(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch."""
    step = np.uint64((row + 1) * int(_MIX) % (1 << 64))
    return (_mixed(h + step) >> np.uint64(20)) & np.uint64(cells - 1)


def _packed(offsets: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending offsets and their counts: gaps between offsets as planes of bytes, of which the higher are mostly zero, and the counts, compressed."""
    gaps = np.diff(offsets, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=1).compress(gaps.T.tobytes() + counts.tobytes())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(5, -1)
    return np.cumsum(np.ascontiguousarray(planes[:4].T).view("<u4").ravel().astype(np.int64)), planes[4]


_CELLS = pa.schema([("key", pa.int32()), ("counts", pa.binary())])


def _added(parts: list[np.ndarray]) -> np.ndarray:
    """Numbers of cells and counts (cell * 16 + count, up to MIN_COUNT), ascending, from several such arrays."""
    every = np.concatenate(parts)
    every.sort()
    cell = every >> np.uint32(4)
    first = np.flatnonzero(np.diff(cell, prepend=np.uint32(0xFFFFFFFF)))
    counts = np.minimum(np.add.reduceat(every & np.uint32(15), first), MIN_COUNT) if len(first) else np.zeros(0, np.uint32)
    return cell[first] << np.uint32(4) | counts.astype(np.uint32)


def sketched(rows: DataFrame, cells: int) -> DataFrame:
    """Partial sketches of rows (lang, text), each of PENDING cells or a task: key (row of the sketch times BLOCKS plus block) and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.uint32(cells // BLOCKS)
        pending: list[list[np.ndarray]] = [[] for _ in range(ROWS)]

        def flush() -> Iterator[pa.RecordBatch]:
            bounds = np.arange(1, SECTIONS, dtype=np.uint64) * np.uint64((cells << 4) // SECTIONS)
            for row in range(ROWS):
                edges_of = [[0, *np.searchsorted(part, bounds.astype(np.uint32)).tolist(), len(part)] for part in pending[row]]
                for k in range(SECTIONS):
                    every = _added([part[e[k] : e[k + 1]] for part, e in zip(pending[row], edges_of, strict=True)])
                    if not len(every):
                        continue
                    found, counts = every >> np.uint32(4), (every & np.uint32(15)).astype(np.uint8)
                    block, offset = found // width, found % width
                    edges = [*np.flatnonzero(np.diff(block, prepend=np.uint32(0xFFFFFFFF))).tolist(), len(block)]
                    made = [_packed(offset[a:b], counts[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
                    keys = pa.array(block[edges[:-1]].astype(np.int32) + np.int32(row * BLOCKS), pa.int32())
                    yield pa.RecordBatch.from_arrays([keys, pa.array(made, pa.binary())], schema=_CELLS)
                pending[row].clear()

        for piece in _pieces(batches):
            for _, _, h in piece.hashes():
                for row in range(ROWS):
                    pending[row].append(_added([cells_of(h, row, cells).astype(np.uint32) << np.uint32(4) | np.uint32(1)]))
            if sum(map(len, pending[0])) > PENDING:
                yield from flush()
        if pending[0]:
            yield from flush()

    return map_batches(rows, run, "key int, counts binary")


def merged(parts: DataFrame, cells: int) -> DataFrame:
    """key and bits: which cells of a block reach MIN_COUNT when all partial sketches are added up. One block at a time is in memory, however many parts it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = cells // BLOCKS
        key, total = None, np.zeros(width, np.uint16)
        done = lambda: pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int32()), "bits": [np.packbits(total >= MIN_COUNT).tobytes()]})
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        yield done()
                    key, total = k, np.zeros(width, np.uint16)
                offsets, counts = _unpacked(data)
                total[offsets] = np.minimum(total[offsets] + counts, MIN_COUNT)
        if key is not None:
            yield done()

    return map_batches(parts.repartition("key").sortWithinPartitions("key"), run, "key int, bits binary")


def survivors(rows: DataFrame, bits: np.ndarray, cells: int) -> DataFrame:
    """lang, phrase, words and n of those runs of rows (lang, text) whose cells all reach MIN_COUNT, added up by piece; and n of all words of a language, with an empty phrase and words 0."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)  # ROWS * MOST_CELLS / 8 bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of_bits = shared.value
        for piece in _pieces(batches):
            langs = pa.array(piece.langs, pa.string())
            size = np.int64(max(1, len(piece.vocabulary)))
            every = np.bincount(piece.lang[piece.word >= 0], minlength=len(piece.langs)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"lang": langs, "phrase": pa.array([""] * len(langs), pa.string()), "words": pa.array(np.zeros(len(langs), np.int32)), "n": pa.array(every)})
            for n, at, h in piece.hashes():
                for row in range(ROWS):
                    cell = cells_of(h, row, cells)
                    hit = (rows_of_bits[row][(cell >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & 1 > 0
                    at, h = at[hit], h[hit]
                code = piece.lang[at] * size + piece.word[at]
                for k in range(1, n):  # numbers stay below places times words
                    code = np.unique(code, return_inverse=True)[1] * size + piece.word[at + k]
                _, first, counts = np.unique(code, return_index=True, return_counts=True)
                starts = at[first]
                parts = [piece.vocabulary.take(pa.array(piece.word[starts + k])) for k in range(n)]
                phrase = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
                yield pa.RecordBatch.from_pydict({"lang": langs.take(pa.array(piece.lang[starts])), "phrase": phrase, "words": pa.array(np.full(len(starts), n, np.int32)), "n": pa.array(counts.astype(np.int64))})

    return map_batches(rows, run, "lang string, phrase string, words int, n long")


def cells_for(chars: int) -> int:
    """Cells of a row of the sketch, a power of two."""
    return min(MOST_CELLS, max(FEWEST_CELLS, 1 << max(0, chars // CHARS_A_CELL).bit_length()))


def frequent_runs(docs: DataFrame, cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all runs of one to three words that occur MIN_COUNT times or more, and (lang, n) of all words, both stored."""
    rows = needed(docs, "lang", "text").select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cells = cells or cells_for(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    bits = np.zeros((ROWS, cells // 8), np.uint8)
    wide = cells // BLOCKS // 8
    for row in stored(merged(sketched(rows, cells), cells), "phrase-bits").toLocalIterator():  # one bit a cell, whatever the corpus
        r, block = divmod(row["key"], BLOCKS)
        bits[r, block * wide : (block + 1) * wide] = np.frombuffer(row["bits"], np.uint8)
    counts = survivors(rows, bits, cells).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f")).where((F.col("f") >= MIN_COUNT) | (F.col("words") == 0))
    counts = stored(counts, "phrase-counts")
    return counts.where("words > 0"), counts.where("words = 0").select("lang", F.col("f").alias("n"))


def part(words: Column, first: int, n: int | Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def unsubsumed(counts: DataFrame) -> DataFrame:
    """lang, phrase, words and a of the candidates that no longer candidate has nearly as often."""
    several = counts.where("words >= 2").withColumnRenamed("f", "a")
    cut = F.split("phrase", " ", -1)
    inner = F.explode(F.array_distinct(F.array(part(cut, 1, 2), part(cut, 2, 2))))
    longer = several.where(F.col("words") == LONGEST).select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return several.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * SUBSUMED_PERCENT)).drop("longer")


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, a, and l, r and score of the lowest-scoring cut."""
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumn("cut", F.split("phrase", " ", -1))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.col("cut"), 1, F.col("k")).alias("left"), F.array_join(F.slice("cut", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    of = lambda side, f: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    both = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    exact = F.expr("1000000 * (CAST(a AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    best = both.withColumn("score", exact).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, top: int = TOP, cells: int | None = None) -> DataFrame:
    """The top phrases of each language by score, a and phrase: lang, rank, phrase, a, l, r, n, score."""
    counts, n_words = frequent_runs(docs, cells)
    found = scored(unsubsumed(counts), counts)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).orderBy(*order)
    few = found.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    first = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return first.join(n_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
