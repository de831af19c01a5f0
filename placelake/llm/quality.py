"""A quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has two symbols, its hash bucket and its shape (case, signs, digits, length, whether it
repeats the word before). Each symbol has a fixed sparse random index vector; a symbol's word
vector is the sum of the index vectors of its neighbours and of its own shape over the sample. A
document is the mean of its words' vectors, by bucket and by shape. A network of one hidden layer
reads it, and one temperature, fitted on rows that the network hasn't seen, calibrates it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelake.llm import bytehash as bh
from placelake.llm.shared import byte_arrays, chunks, write_table

BUCKETS = 1 << 14
SHAPES = 2 * 2 * 4 * 3 * 3 * 2 * 4 * 2
DIM = 64
REACH = 2
HIDDEN = 32
SAMPLE_ROWS = 6000
"""Labelled rows that the classifier is fitted on: those of the smallest hashes of doc_id."""
MODEL_PARTS = 4

_KIND = np.zeros(256, np.uint8)
for _k, _signs in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#*$%&|<>", "!?", ".,;:", "0123456789"), 1):
    _KIND[[ord(c) for c in _signs]] = _k


def _index_vectors() -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(23))
    out = np.zeros((BUCKETS + SHAPES, DIM), np.float32)
    rows = np.arange(len(out))
    for sign in (1, 1, 1, -1, -1, -1):
        out[rows, rng.integers(0, DIM, len(out))] += sign
    return out


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket and the shape of each word of a batch, and the bounds of each text's words."""
    start, end, of = bh.words(data, offsets)
    low = bh.LOWER[data]
    h = bh.range_hash(bh.prefix_sums(low), start, end)
    kind = _KIND[data]

    def count(k: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind == k)])
        return total[end] - total[start]

    size, upper = end - start, count(1)
    first = np.zeros(len(start), bool)
    first[of[:-1][of[:-1] < of[1:]]] = True
    same = np.zeros(len(start), bool)
    same[1:] = (h[1:] == h[:-1]) & ~first[1:]
    shape = (upper > 0).astype(np.int64)
    for value, most in ((2 * upper > size, 1), (count(2), 3), (count(3), 2), (count(4), 2), (count(5), 1), (np.searchsorted([3, 6, 12], size), 3), (same, 1)):
        shape = shape * (most + 1) + np.minimum(value.astype(np.int64), most)
    return (h % np.uint64(BUCKETS)).astype(np.int64), shape, of


def context_sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """Word vectors, not yet of unit length, of the texts in ``batches``."""
    index, out = _index_vectors(), np.zeros((BUCKETS + SHAPES, DIM))
    for batch in batches:
        for part in chunks(batch, "text", 1 << 19):
            bucket, shape, of = symbols(*byte_arrays(part.column("text")))
            row = np.repeat(np.arange(len(of) - 1), np.diff(of))
            n = len(bucket)
            own = index[bucket] + index[BUCKETS + shape]
            seen = index[BUCKETS + shape]
            for step in range(1, REACH + 1):
                near = np.flatnonzero(row[step:] == row[: n - step])
                seen[near] += own[near + step]
                seen[near + step] += own[near]
            for d in range(DIM):
                out[:BUCKETS, d] += np.bincount(bucket, seen[:, d], BUCKETS)
                out[BUCKETS:, d] += np.bincount(shape, seen[:, d], SHAPES)
    return out


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row per text: the mean vectors of its words by bucket and by shape; zeros without words."""
    bucket, shape, of = symbols(*byte_arrays(column))
    out = np.zeros((len(of) - 1, 2 * DIM), np.float32)
    for i, (a, b) in enumerate(zip(of[:-1].tolist(), of[1:].tolist(), strict=True)):
        if b > a:
            out[i, :DIM] = vectors[bucket[a:b]].mean(axis=0)
            out[i, DIM:] = vectors[BUCKETS + shape[a:b]].mean(axis=0)
    return out


class Network:
    """Two layers with tanh between them, fitted by Adam; deterministic."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4):
        rng = np.random.Generator(np.random.PCG64(29))
        held = np.arange(len(y)) % 5 == 4
        if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
            held[:] = False
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z, t = (x - self.mean) / self.scale, y.astype(np.float64)
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        fit = np.flatnonzero(~held)
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                hidden = np.tanh(z[rows] @ p[0] + p[1])
                error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -60, 60))) - t[rows]) / len(rows)
                back = np.outer(error, p[2]) * (1 - hidden**2)
                step += 1
                for k, g in enumerate((z[rows].T @ back + decay * p[0], back.sum(axis=0), hidden.T @ error + decay * p[2], error.sum(keepdims=True))):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.parameters, self.temperature = p, 1.0
        if held.any():
            logit = self.logits(x[held])
            loss = lambda k: np.mean(np.logaddexp(0, -np.where(y[held] == 1, logit, -logit) / k))
            self.temperature = float(min(np.geomspace(0.25, 8, 71), key=loss))

    def logits(self, x: np.ndarray) -> np.ndarray:
        z, p = (x - self.mean) / self.scale, self.parameters
        return np.tanh(z @ p[0] + p[1]) @ p[2] + p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


class Model:
    """Word vectors and network; ``network`` is None where the sample had fewer than two labels, and ``constant`` is the score."""

    def __init__(self, vectors: np.ndarray, network: Network | None, constant: float):
        self.vectors, self.network, self.constant = vectors, network, constant

    def score(self, column: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(column), self.constant)
        return self.network.score(pooled(column, self.vectors))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array([context_sums(batches).astype(np.float32).tobytes()], pa.binary())], ["sums"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` rows of ``labels(doc_id, quality)``, joined to ``docs(doc_id, text)``.

    Rows without doc_id or label are left out, and of several labels of a document the least counts.
    Without any labelled text, or with one label only, the model scores every text 0.5, or that label.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # a bounded side
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "quality")
    sample = write_table(sample, "sample").repartition(MODEL_PARTS, "doc_id")
    total = np.zeros((BUCKETS + SHAPES, DIM), np.float64)
    for row in sample.select("text").mapInArrow(_sums, "sums binary").toLocalIterator():
        total += np.frombuffer(row.sums, np.float32).reshape(total.shape)
    vectors = (total / (np.linalg.norm(total, axis=1, keepdims=True) + 1e-9)).astype(np.float32)
    shared = spark.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                x = pooled(part.column("text"), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality").cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    rows = sorted((r.doc_id, r.quality, bytes(r.x)) for r in sample.mapInArrow(pool, "doc_id long, quality int, x binary").collect())
    y = np.array([r[1] for r in rows], np.int64)
    if len(np.unique(y)) < 2:
        return Model(vectors, None, float(y[0]) if len(y) else 0.5)
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(len(rows), -1).astype(np.float64)
    return Model(vectors, Network(x, y), 0.5)


def classify(docs: DataFrame, model: Model, threshold: float = 0.7, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Score every whole text: ``row`` (struct of the columns ``carry``), score (0 to 1) and predicted (1 from ``threshold`` on).

    Only ``text`` is an input of the score. Null and empty texts get the score of a text without words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(shared.value.score(part.column("text")), pa.float64())], ["row", "score"])

    row = F.struct(*carry).alias("row")
    kind = docs.select(row).schema["row"].dataType.simpleString()
    return docs.select(row, "text").mapInArrow(run, f"row {kind}, score double").withColumn("predicted", F.expr(f"if(score >= {threshold}D, 1, 0)"))


def held_out(column: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))
