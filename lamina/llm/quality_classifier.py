"""A quality classifier: random-indexing word vectors, pooled per document, in a two-layer network with temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import byte_classes, chunked, hash_tokens, joined, label_sample, slices, sum_vectors

BITS, DIMS, NONZERO, WINDOW = 15, 32, 4, 2
VOCABULARY = 1 << BITS
POOLED = 3 * DIMS
CHUNK = 8192
#: Labelled documents that the network is fitted on, at most; a fifth of them only sets the temperature.
LABELLED = 20_000
HIDDEN, EPOCHS, STEP, BATCH, DECAY = 64, 60, 3e-3, 256, 1e-4
SMOOTH = 0.1
THRESHOLD = 0.5
SEED = 1
#: Words, and runs of symbols as words of their own; case counts.
CLASSES = byte_classes("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(columns, signs) of each word bucket's sparse index vector: NONZERO entries, half of them -1."""
    rng = np.random.default_rng(SEED)
    columns = np.argsort(rng.random((VOCABULARY, DIMS)), axis=1)[:, :NONZERO]
    return columns, np.tile(np.repeat([1, -1], NONZERO // 2), (VOCABULARY, 1))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, word bucket) of each token in order."""
    rows, hashes = hash_tokens(texts, CLASSES)
    return rows, (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def contexts(rows: np.ndarray, words: np.ndarray, columns: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The sum, for each word bucket, of the index vectors of all words up to WINDOW away in the same text."""
    total = np.zeros(VOCABULARY * DIMS)
    for step in range(1, WINDOW + 1):
        same = rows[step:] == rows[:-step]
        a, b = words[:-step][same], words[step:][same]
        for word, other in ((a, b), (b, a)):
            at = (word[:, None] * DIMS + columns[other]).ravel()
            total += np.bincount(at, weights=signs[other].ravel(), minlength=len(total))
    return total


@dataclass(frozen=True)
class Vectors:
    """Unit vectors by word bucket, and the weight of each: rare words weigh more."""

    unit: np.ndarray
    weight: np.ndarray

    def pool(self, texts: pa.Array) -> np.ndarray:
        """For each text the weighted mean of its words' vectors, their deviation from it and the deviation of each
        from the word before it; zeros without words."""
        out = np.zeros((len(texts), POOLED), np.float32)
        rows, words = words_of(texts)
        if len(rows):
            starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            w, v = self.weight[words].astype(np.float64), self.unit[words]
            mass = np.add.reduceat(w, starts)[:, None]
            mean = np.add.reduceat(w[:, None] * v, starts) / mass
            square = np.add.reduceat(w[:, None] * v * v, starts) / mass
            out[rows[starts], :DIMS] = mean
            out[rows[starts], DIMS : 2 * DIMS] = np.sqrt(np.maximum(square - mean * mean, 0))
            step = np.zeros_like(v)
            step[1:] = v[1:] - v[:-1]
            step[starts] = 0
            out[rows[starts], 2 * DIMS :] = np.sqrt(np.add.reduceat(w[:, None] * step * step, starts) / mass)
        return out


def word_vectors(docs: DataFrame) -> Vectors:
    """Random indexing over all documents. The sums that reach the driver have VOCABULARY rows whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, signs = index_vectors()
        total, counts = np.zeros(VOCABULARY * DIMS), np.zeros(VOCABULARY, np.int64)
        for batch in slices(batches, "text"):
            rows, words = words_of(batch.column(0))
            if len(rows):
                total += contexts(rows, words, columns, signs)
                counts += np.bincount(words, minlength=VOCABULARY)
        yield chunked(np.concatenate([total, counts]).astype("<i4"), CHUNK)

    sums = sum_vectors(docs.select("text").mapInArrow(run, "chunk int, data binary"), "<i8", "<i4")
    flat = joined(sums, VOCABULARY * (DIMS + 1) // CHUNK, CHUNK, "<i8")
    return vectors_from(flat[: VOCABULARY * DIMS].reshape(VOCABULARY, DIMS), flat[VOCABULARY * DIMS :])


def vectors_from(sums: np.ndarray, counts: np.ndarray) -> Vectors:
    """Sums by word, without the part that all words have in common, to unit length; weights SMOOTH / (SMOOTH + rate)."""
    rate = counts / max(1, counts.sum())
    mean = sums / np.maximum(counts, 1)[:, None]
    mean = mean - rate @ mean
    unit = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
    return Vectors(unit.astype(np.float32), (SMOOTH / (SMOOTH + rate)).astype(np.float32))


@dataclass(frozen=True)
class Network:
    """Standardised features, HIDDEN tanh units, one logit, divided by the temperature."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the logistic loss. x is empty: everything has probability 1/2."""
    rng = np.random.default_rng(SEED)
    d = x.shape[1]
    shift = x.mean(axis=0) if len(x) else np.zeros(d)
    scale = np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(d)
    p = [rng.normal(size=(d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    z, step = (x - shift) / scale, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for at in range(0, len(z), BATCH):
            i = order[at : at + BATCH]
            h = np.tanh(z[i] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - y[i]) / len(i)
            back = np.outer(g, p[2]) * (1 - h * h)
            grads = [z[i].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ g + DECAY * p[2], np.array([g.sum()])]
            step += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] = p[k] - STEP * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Network(shift, scale, p[0], p[1], p[2], float(p[3][0]))


def calibrated(network: Network, x: np.ndarray, y: np.ndarray) -> Network:
    """The network with the temperature, 0.05 to 20, of the least logistic loss on (x, y), by golden-section search."""
    if not len(x):
        return network
    logits = network.logits(x)

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    low, high, golden = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return Network(network.shift, network.scale, network.w1, network.b1, network.w2, network.b2, float(np.exp((low + high) / 2)))


def fit(docs: DataFrame, labels: DataFrame, vectors: Vectors, bound: int = LABELLED) -> Network:
    """The network fitted on at most `bound` labelled documents, whose pooled vectors are all that the driver gets."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            pooled = shared.value.pool(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in pooled], pa.binary())], ["doc_id", "label", "x"])

    known = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = known.join(F.broadcast(label_sample(labels, "quality", bound)), "doc_id").select("doc_id", "label", "text")
    found = marked.mapInArrow(run, "doc_id long, label int, x binary")
    rows = found.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("x").alias("x"), F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("part")).toPandas()
    rows = rows.sort_values("doc_id")
    x = np.stack([np.frombuffer(b, np.float32) for b in rows["x"]]).astype(np.float64) if len(rows) else np.zeros((0, POOLED))
    y, held = (rows["label"].to_numpy() >= 1).astype(np.float64), rows["part"].to_numpy() == 0
    if len(y) and len(set(y)) == 1:  # nothing to tell apart
        d, odds = x.shape[1], np.log(len(y) + 1)
        return Network(np.zeros(d), np.ones(d), np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(odds if y[0] else -odds))
    return calibrated(train(x[~held], y[~held]), x[held], y[held])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bound: int = LABELLED) -> DataFrame:
    """Each row of docs(doc_id, text): doc_id, quality, its calibrated probability, and keep, from `threshold` on.

    Word vectors come from all documents: each of VOCABULARY hash buckets sums the sparse random index vectors of the
    words around it. A document is pooled from its words' vectors (see Vectors.pool). The network is fitted on the
    bounded sample of labelled documents, one text for each id; of several labels for one the least holds.

    Null texts and those without a token have quality 0 and are not kept. Null ids are classified but not trained on;
    repeated rows are each classified. Whole texts are read. Further columns are ignored. An empty table gives no
    rows; without labels every text with tokens has quality 1/2, with n labels of one class alone (n + 1) / (n + 2)
    for that class.
    """
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, fit(docs, labels, vectors, bound)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for b in slices(batches, "text"):
            x = vectors.pool(b.column(1))
            p = np.where(x.any(axis=1), network.probability(x), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(p >= threshold)], ["doc_id", "quality", "keep"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, quality double, keep boolean")
