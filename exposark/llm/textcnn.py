"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words, and their first PREFIX letters, are hashed to rows of an embedding table, whose sum is the word's vector, so that inflected and
compound forms of a word that was seen share what was learned; filters of several widths run over the whole text, the largest response of each
filter is kept, and a logistic layer scores those. Training is stochastic gradient descent (Adam) over a bounded sample of labelled
documents, the same for the same rows. Thresholds are calibrated by language on a part of that sample that trained nothing: the language picks a
threshold, it is never an input of the score.

Defined results: a null or empty text scores as a text without words does; without labels of both classes all scores are one half less
a little, so nothing is predicted toxic; repeated rows each get the same score; texts of any length are scored whole, a piece at a time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposark.llm.common import map_texts, needed, stored

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
PREFIX = 4
DIMENSIONS = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 12
#: Rows of the table that fewer training documents use stay zero, so what one document happens to say is not learned.
MIN_DOCUMENTS = 4
#: Training sees so many labelled documents at most, taken by a hash of their id: a documented bound, so that fitting stays on the driver.
MAX_LABELLED = 6000
#: Their words in all, another documented bound: what the driver holds is 8 bytes a word.
MAX_WORDS = 6_000_000
HELD_OUT = 5
#: One in so many labelled rows sets thresholds and trains nothing.
CALIBRATION = 6
#: Words of a text that are scored at once.
PIECE = 1 << 15
REMEMBERED = 300_000


def bucket(word: str) -> tuple[int, int]:
    """The rows of the word and of its first letters."""
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS, zlib.crc32(b"^" + word[:PREFIX].encode("utf-8", "surrogatepass")) % BUCKETS


class Buckets(dict):
    """Buckets of words, remembered up to a bound."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = b = bucket(word)
        return b


def word_buckets(text: str, known: Buckets) -> np.ndarray:
    """The rows of each word of a whole text; words are read one by one, so only the rows are held."""
    pairs = np.fromiter((b for m in WORD.finditer(text.lower()) for b in known[m.group()]), np.int32)
    return pairs.reshape(-1, 2)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0


@dataclass
class TextCnn:
    """Weights: table (buckets, dimensions), filters by width (width, dimensions, filters), biases, and the output layer."""

    table: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 1) -> TextCnn:
        rng = np.random.default_rng(seed)
        scale = 0.3
        kernels = [(rng.standard_normal((w, DIMENSIONS, FILTERS)) * scale / np.sqrt(w)).astype(np.float32) for w in WIDTHS]
        return cls((rng.standard_normal((BUCKETS, DIMENSIONS)) * 0.1).astype(np.float32), kernels, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS), 0.3, np.float32) * np.where(np.arange(FILTERS * len(WIDTHS)) % 4 == 3, -1, 1).astype(np.float32), -1.0)

    def pooled(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For texts laid end to end, each followed by max(WIDTHS) empty places (-1): the largest response of each filter, and all responses by width."""
        vectors = self.table[ids[:, 0]] + self.table[ids[:, 1]]
        vectors[ids[:, 0] < 0] = 0
        pools, all_responses = [], []
        for kernel, bias in zip(self.kernels, self.biases, strict=True):
            responses = vectors @ kernel[0]
            for k in range(1, len(kernel)):
                responses[:-k] += vectors[k:] @ kernel[k]
            responses[ids[:, 0] < 0] = 0  # no filter begins between two texts and goes on into the next
            responses += bias
            np.maximum(responses, 0, out=responses)
            pools.append(np.maximum.reduceat(responses, starts))
            all_responses.append(responses)
        return np.concatenate(pools, axis=1), all_responses

    def largest(self, text: np.ndarray) -> np.ndarray:
        """The largest response of each filter over one text, PIECE words at a time: a maximum of the pieces' maxima. Pieces overlap by the widest filter less one word."""
        out = None
        for i in range(0, max(1, len(text)), PIECE):
            part, last = text[i : i + PIECE + max(WIDTHS) - 1], i + PIECE >= len(text)
            ids = laid_out([part])[0] if last else part
            # what begins beyond the piece belongs to the next one
            pools = self.pooled(ids, np.array([0]))[0] if last else np.concatenate([r[:PIECE].max(axis=0) for r in self.pooled(ids, np.array([0]))[1]])[None]
            out = pools if out is None else np.maximum(out, pools)
        return out

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """A score for each text. Long ones are pooled in pieces, short ones laid end to end."""
        pools = np.zeros((len(texts), FILTERS * len(WIDTHS)), np.float32)
        short = [k for k, t in enumerate(texts) if len(t) <= PIECE]
        if short:
            pools[short] = self.pooled(*laid_out([texts[k] for k in short]))[0]
        for k, t in enumerate(texts):
            if len(t) > PIECE:
                pools[k] = self.largest(t)[0]
        return 1 / (1 + np.exp(-np.clip(pools.astype(np.float64) @ self.out.astype(np.float64) + self.bias, -30, 30)))


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    gap = np.full((max(WIDTHS), 2), -1, np.int32)
    lengths = np.array([len(t) for t in texts]) + len(gap)
    parts: list[np.ndarray] = []
    for t in texts:
        parts += [t, gap]
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(lengths)[:-1]))


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1, batch: int = 32, rate: float = 0.01) -> TextCnn:
    """Adam on the logistic loss, the rarer class weighted up. Gradients reach only the place where each filter was largest."""
    model = TextCnn.fresh(seed)
    if len(set(labels.tolist())) < 2:
        model.out[:] = 0
        model.bias = -0.1
        return model
    rng = np.random.default_rng(seed)
    weight = np.where(labels == 1, 0.5 * len(labels) / labels.sum(), 0.5 * len(labels) / (len(labels) - labels.sum())).astype(np.float32)
    used_by = np.zeros(BUCKETS, np.int64)
    for t in texts:
        used_by[np.unique(t)] += 1
    common = used_by >= MIN_DOCUMENTS
    model.table[~common] = 0
    params = [model.table, *model.kernels, *model.biases, model.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    b1 = b2 = 0.0
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        pace = rate * (1 - epoch / (epochs + 1))
        for i in range(0, len(order), batch):
            chosen = order[i : i + batch]
            ids, starts = laid_out([texts[k] for k in chosen])
            pools, responses = model.pooled(ids, starts)
            p = 1 / (1 + np.exp(-np.clip(pools @ model.out + model.bias, -30, 30)))
            error = (weight[chosen] * (p - labels[chosen]) / len(chosen)).astype(np.float32)
            back = error[:, None] * model.out[None, :]
            ends = np.append(starts[1:], len(ids))
            rows: list[np.ndarray] = []
            grads: list[np.ndarray] = []
            changes: list[np.ndarray] = [np.zeros(0)] * len(params)
            for w, (kernel, response) in enumerate(zip(model.kernels, responses, strict=True)):
                top = pools[:, w * FILTERS : (w + 1) * FILTERS]
                place = np.stack([s + response[s:e].argmax(axis=0) for s, e in zip(starts, ends, strict=True)])
                flow = np.where(top > 0, back[:, w * FILTERS : (w + 1) * FILTERS], 0).astype(np.float32)
                change = np.zeros_like(kernel)
                for k in range(len(kernel)):
                    at = np.minimum(place + k, len(ids) - 1)
                    word = np.where((place + k < len(ids))[:, :, None], ids[at], -1)
                    vector = np.where((word[:, :, :1] >= 0), model.table[word[:, :, 0]] + model.table[word[:, :, 1]], 0)
                    change[k] = np.einsum("tfd,tf->df", vector, flow)
                    rows += [word[:, :, 0].reshape(-1), word[:, :, 1].reshape(-1)]
                    grads += [(flow[:, :, None] * kernel[k].T[None, :, :]).reshape(-1, DIMENSIONS)] * 2
                changes[1 + w], changes[1 + len(WIDTHS) + w] = change, flow.sum(axis=0)
            changes[-1] = pools.T @ error
            step += 1
            b1, b2 = 1 - 0.9**step, 1 - 0.999**step
            row, grad = np.concatenate(rows), np.concatenate(grads)
            learned = (row >= 0) & common[row]
            grad, row = grad[learned], row[learned]
            used, inverse = np.unique(row, return_inverse=True)
            total = np.zeros((len(used), DIMENSIONS), np.float32)
            np.add.at(total, inverse, grad)
            first[0][used] = 0.9 * first[0][used] + 0.1 * total
            second[0][used] = 0.999 * second[0][used] + 0.001 * total**2
            model.table[used] -= pace * (first[0][used] / b1) / (np.sqrt(second[0][used] / b2) + 1e-8)
            for k in range(1, len(params)):
                first[k] = 0.9 * first[k] + 0.1 * changes[k]
                second[k] = 0.999 * second[k] + 0.001 * changes[k] ** 2
                params[k] -= (pace * (first[k] / b1) / (np.sqrt(second[k] / b2) + 1e-8)).astype(np.float32)
            model.bias -= pace * float(error.sum())
    return model


def calibrated(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold with the best F1; the middle of the gap that it lies in, one half if no label is 1."""
    if not labels.any():
        return 0.5
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # no threshold parts equal scores
    k = int(f1.argmax())
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2)


def labelled_rows(docs: DataFrame, labels: DataFrame, max_labelled: int, max_words: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of whole texts, labels, languages and ids of at most max_labelled rows that are not held out, of at most max_words words in all.

    Words become buckets in the executors; the driver sees numbers only. Rows are taken by a hash of id and text, as long as their words fit.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = known.where(~is_held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_labelled)
    rows = with_language(docs).withColumn("key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    marked = rows.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id")  # the limit bounds what is broadcast

    def start() -> Callable[[str], tuple]:
        seen = Buckets()

        def one(text: str) -> tuple:
            pairs = word_buckets(text, seen)
            return len(pairs), pairs.astype("<i4").tobytes()

        return one

    hashed = stored(map_texts(marked, start, "n_words long, buckets binary", ("lang", "key")).join(F.broadcast(chosen), "doc_id"), "toxicity-rows")
    sizes = hashed.select("doc_id", "key", "toxic", "n_words").orderBy("key", "doc_id", "toxic").limit(max_labelled).collect()
    taken, left = [], max_words
    for r in sizes:
        if r["n_words"] <= left:
            left -= r["n_words"]
            taken.append((r["doc_id"], r["key"], r["toxic"]))
    if not taken:
        return [], np.zeros(0, np.float32), np.zeros(0, object), np.zeros(0, np.int64)
    wanted = docs.sparkSession.createDataFrame(sorted(set(taken)), "doc_id long, key string, toxic int")
    table = hashed.join(F.broadcast(wanted), ["doc_id", "key", "toxic"]).dropDuplicates(["doc_id", "key", "toxic"]).select("doc_id", "key", "toxic", "lang", "buckets").toPandas()
    table = table.sort_values(["doc_id", "toxic", "key"], kind="stable")
    return [np.frombuffer(b, "<i4").reshape(-1, 2) for b in table["buckets"]], table["toxic"].to_numpy(np.float32), table["lang"].fillna("").to_numpy(), table["doc_id"].to_numpy(np.int64)


def is_calibration(doc_id: int) -> bool:
    """Whether a labelled row is kept from training, to set thresholds on."""
    return zlib.crc32(b"threshold " + str(doc_id).encode()) % CALIBRATION == 0


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, epochs: int = EPOCHS, max_words: int = MAX_WORDS) -> TextCnn:
    """The model of at most max_labelled rows that have a label and are not held out; its thresholds are set on those of them that it was not trained on."""
    texts, y, langs, ids = labelled_rows(docs, labels, max_labelled, max_words)
    apart = np.array([is_calibration(i) for i in ids.tolist()], bool)
    model = train([t for t, a in zip(texts, apart, strict=True) if not a], y[~apart], epochs)
    if apart.any():
        rest = [t for t, a in zip(texts, apart, strict=True) if a]
        scores = np.concatenate([model.scores(rest[i : i + 200]) for i in range(0, len(rest), 200)])
        known, own = y[apart], langs[apart]
        every = calibrated(scores, known)
        # a language without an example of either class takes the threshold of all
        model.thresholds = {k: calibrated(scores[own == k], known[own == k]) for k in sorted(set(own.tolist())) if 0 < known[own == k].sum() < (own == k).sum()} | {"*": every}
    return model


def with_language(docs: DataFrame) -> DataFrame:
    """doc_id, text and lang, null where docs has no such column."""
    if any(c.lower() == "lang" for c in docs.columns):
        rows = needed(docs, "doc_id", "text", "lang")
    else:
        rows = needed(docs, "doc_id", "text").withColumn("lang", F.lit(None))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def score(docs: DataFrame, model: TextCnn) -> DataFrame:
    """doc_id, held_out, score, predicted (score of at least one half), and, by the threshold of each document's language (that of all languages for others), flagged.

    The model has a fixed size (about 3 MB) and travels as a broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable[[str], tuple]:
        known, m = Buckets(), shared.value
        return lambda text: (float(m.scores([word_buckets(text, known)])[0]),)

    out = map_texts(with_language(docs), start, "score double", ("lang",))
    pairs = [x for k, t in model.thresholds.items() for x in (F.lit(k), F.lit(t))]
    table = F.create_map(*pairs) if pairs else F.create_map(F.lit("*"), F.lit(0.5))
    threshold = F.coalesce(F.try_element_at(table, F.coalesce(F.col("lang"), F.lit(""))), F.lit(model.thresholds.get("*", 0.5)))
    return out.select(
        "doc_id",
        F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        threshold.alias("threshold"),
        (F.col("score") >= threshold).alias("flagged"),
    )
