"""Quality classifier on random-indexing word vectors (operator 8).

Random indexing: every word has a fixed sparse ternary index vector; a word's context
vector is the sum of the index vectors of its neighbours (two on each side) over the whole
table.  Words are hashed to a fixed number of rows, and each word also counts as its shape
(runs of letter classes and punctuation), so that words never seen in training still have
a vector.  Tasks add up their own matrix, the matrices are summed in two steps by row
blocks, and the result has a fixed size whatever the input.

A document is the mean and spread of its words' and shapes' vectors and its length.  A
two-layer network is trained in numpy on a bounded sample of labelled rows; its logits are
divided by a temperature fitted on a fifth of the sample that training never saw, and
shifted to the label share of all training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.llm import array_sums
from calibra.llm.learning import Adam, labelled_sample, sigmoid
from calibra.llm.textblocks import byte_blocks, hash_spans, word_bounds

WORD_BITS, SHAPE_BITS, DIMENSIONS, NONZERO, REACH = 13, 10, 32, 4, 2
ROWS = (1 << WORD_BITS) + (1 << SHAPE_BITS)
PER_CLASS = 4000
HIDDEN, STEPS = 24, 400

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")


def index_vectors() -> np.ndarray:
    """Fixed ternary index vectors, NONZERO entries of +1 or -1 each."""
    rng = np.random.default_rng(8)
    out = np.zeros((ROWS, DIMENSIONS), np.int8)
    for _ in range(NONZERO):
        out[np.arange(ROWS), rng.integers(0, DIMENSIONS, ROWS)] = rng.choice([-1, 1], ROWS)
    return out


def rows_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, row of its shape, word offsets of the texts)."""
    w = word_bounds(buf, offs)
    if not w.starts.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), w.offsets
    word = (hash_spans(buf, w.starts, w.ends) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    kinds = _SHAPE[buf]
    fresh = np.ones(buf.size, bool)                 # first byte of a run of one kind
    fresh[1:] = kinds[1:] != kinds[:-1]
    fresh[w.starts] = True
    place = np.concatenate([[0], np.cumsum(fresh)])
    shape = hash_spans(kinds[fresh], place[w.starts], place[w.ends])
    return word, (shape >> np.uint64(64 - SHAPE_BITS)).astype(np.int64) + (1 << WORD_BITS), w.offsets


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = index_vectors()
    total = np.zeros((ROWS, DIMENSIONS), np.int64)
    for batch in batches:
        for _, _, buf, offs in byte_blocks(batch.column("text")):
            word, shape, cuts = rows_of(buf, offs)
            if not word.size:
                continue
            own = index[word].astype(np.int16) + index[shape]
            doc = np.repeat(np.arange(offs.size - 1), np.diff(cuts))
            near = np.zeros_like(own)
            for d in range(1, REACH + 1):
                together = (doc[d:] == doc[:-d])[:, None]
                near[d:] += own[:-d] * together
                near[:-d] += own[d:] * together
            for rows in (word, shape):
                order = np.argsort(rows, kind="stable")
                ranked = rows[order]
                first = np.flatnonzero(np.diff(ranked, prepend=-1))
                total[ranked[first]] += np.add.reduceat(near[order], first, axis=0, dtype=np.int64)
    yield from array_sums.shards(total)


def context_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit context vectors (ROWS x DIMENSIONS) from every text of the table; rows of words
    that never had a neighbour are 0."""
    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(_context_sums, array_sums.SCHEMA)
    total = array_sums.total(parts, (ROWS, DIMENSIONS), np.int64).astype(np.float64)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return (total / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(vectors: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Mean and spread of the word and shape vectors of each text, and its log length."""
    word, shape, cuts = rows_of(buf, offs)
    n = np.diff(cuts)
    out = np.zeros((n.size, 4 * DIMENSIONS + 1), np.float32)
    full = np.flatnonzero(n)
    if full.size:
        at, size = cuts[:-1][full], n[full, None]
        for k, rows in enumerate((word, shape)):
            v = vectors[rows]
            mean = np.add.reduceat(v, at, axis=0) / size
            square = np.add.reduceat(v * v, at, axis=0) / size
            out[full, 2 * k * DIMENSIONS:(2 * k + 1) * DIMENSIONS] = mean
            out[full, (2 * k + 1) * DIMENSIONS:(2 * k + 2) * DIMENSIONS] = np.sqrt(np.maximum(square - mean * mean, 0))
    out[:, -1] = np.log1p(n)
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]        # W1, b1, w2, b2
    temperature: float
    shift: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2[0]

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        z = self.logits(pooled(self.vectors, buf, offs).astype(np.float64))
        return sigmoid(z / self.temperature + self.shift)


def fit(vectors: np.ndarray, sample: DataFrame, share: float) -> QualityModel:
    width = 4 * DIMENSIONS + 1

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buf, offs in byte_blocks(batch.column("text")):
                x = pooled(vectors, buf, offs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), batch.column("label").slice(row, end - row),
                     pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    rows = sample.select("doc_id", "label", "text").mapInArrow(features, "doc_id long, label int, x binary").toPandas()
    rows = rows.sort_values(["doc_id", "x"], kind="stable")
    y = rows["label"].to_numpy(np.float64)
    x = np.array([np.frombuffer(r, np.float32) for r in rows["x"]], np.float64).reshape(-1, width)
    return fit_arrays(vectors, x, y, share)


def fit_arrays(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, share: float) -> QualityModel:
    """Network, temperature and shift from pooled rows x and labels y."""
    width = x.shape[1]
    rng = np.random.default_rng(80)
    layers = [rng.normal(0, width ** -0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
    share = min(max(share, 1e-3), 1 - 1e-3)
    prior = np.log(share / (1 - share))
    if not y.size or y.min() == y.max():            # nothing to tell apart: the share alone
        layers[2][:] = 0
        return QualityModel(vectors, np.zeros(width), np.ones(width), layers, 1.0, prior)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    order = rng.permutation(y.size)
    held, used = order[:y.size // 5], order[y.size // 5:]
    model = QualityModel(vectors, centre, scale, layers, 1.0, 0.0)
    inputs, target = (x[used] - centre) / scale, y[used]
    adam = Adam(layers, 0.01)
    w1, b1, w2, b2 = layers
    for _ in range(STEPS):
        hidden = np.tanh(inputs @ w1 + b1)
        error = (sigmoid(hidden @ w2 + b2[0]) - target) / target.size
        back = error[:, None] * w2 * (1 - hidden * hidden)
        adam.step([inputs.T @ back + 1e-4 * w1, back.sum(0), hidden.T @ error + 1e-4 * w2, error.sum(keepdims=True)])
    if held.size:
        z, t = model.logits(x[held]), y[held]
        grid = np.geomspace(0.25, 8, 41)
        loss = [np.mean(np.logaddexp(0, z / g) - t * z / g) for g in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    model.shift = float(prior - np.log(y.mean() / (1 - y.mean())))
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", per_class: int = PER_CLASS,
          id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Context vectors from every text, network from at most `per_class` labelled rows of
    each class for which `usable` (a condition on doc_id) holds."""
    vectors = context_vectors(docs, text_col)
    return fit(vectors, *labelled_sample(docs, labels, label, usable, per_class, id_col, text_col))


def quality(docs: DataFrame, model: QualityModel, threshold: float = 0.7,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1, label 1 likelier), predicted
    (score >= threshold).

    Null, empty and wordless texts are scored as documents of no words.  Repeated rows and
    null ids give one row each; an empty table gives none; other columns are never read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buf, offs in byte_blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), pa.array(model.score(buf, offs), pa.float64())],
                    ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").withColumn(
        "predicted", (F.col("score") >= F.lit(threshold)).cast("int"))
