"""Toxicity by multiple-instance learning (operator 9).

A document is a bag of sentences.  Each sentence gets a probability from a linear model of
its words; the document's probability is the noisy-or of its sentences', one minus the
product of their complements.  Only documents carry labels: the loss is taken on the
noisy-or, and its gradient falls mostly on the sentences that explain a toxic label, so
the same model afterwards tells which sentences offend.

Training reads a bounded sample (`per_class` rows of each class); scoring reads every
whole text once, without a shuffle.  The model is one array of 2**18 weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.llm.learning import Adam, labelled_sample, sigmoid
from calibra.llm.textblocks import byte_blocks, hash_spans, mix, word_bounds

BITS = 18
PER_CLASS = 3000
MIN_DOCS = 3
STEPS = 200
DECAY = 2e-5
RATE = 0.3
FLOOR = 1e-2
STEMS = (4, 5, 6)
EMPTY = 1 << BITS
_ENDS = np.isin(np.arange(256), list(b".!?"))
_OUTER = np.isin(np.arange(256), list(b".,;:!?\"'()[]{}|*#$%&-_"))


def sentences(buf: np.ndarray, offs: np.ndarray):
    """(feature buckets of each word, first word of each sentence, sentences of each text as offsets,
    byte span of each sentence within the block).

    A sentence ends after a word whose last byte is one of . ! ? and at a line break.
    Words are trimmed of outer punctuation and hashed with A-Z as a-z; a word's features
    are itself and its first bytes (`STEMS`), so that inflected forms share weight.  A word
    too short for a stem gets the empty bucket, whose weight stays 0.
    """
    w = word_bounds(buf, offs)
    n = w.starts.size
    if n == 0:
        return np.zeros((0, 1 + len(STEMS)), np.int64), np.zeros(0, np.int64), np.zeros(offs.size, np.int64), np.zeros((0, 2), np.int64)
    a, b = w.starts.copy(), w.ends.copy()
    for _ in range(3):
        b -= (b - a > 1) & _OUTER[buf[b - 1]]
    for _ in range(2):
        a += (b - a > 1) & _OUTER[buf[a]]
    buckets = np.full((n, 1 + len(STEMS)), EMPTY, np.int64)
    buckets[:, 0] = hash_spans(buf, a, b, fold=True) >> np.uint64(64 - BITS)
    for k, size in enumerate(STEMS, 1):
        long = np.flatnonzero(b - a > size)
        stem = mix(hash_spans(buf, a[long], a[long] + size, fold=True) + np.uint64(size))
        buckets[long, k] = stem >> np.uint64(64 - BITS)
    breaks = np.concatenate([[0], np.cumsum((buf == 10) | (buf == 13))])
    opens = np.ones(n, bool)
    opens[1:] = _ENDS[buf[w.ends[:-1] - 1]] | (breaks[w.starts[1:]] > breaks[w.ends[:-1]])
    opens[w.offsets[:-1][w.offsets[:-1] < n]] = True
    first = np.flatnonzero(opens)
    last = np.append(first[1:], n) - 1
    return buckets, first, np.searchsorted(first, w.offsets), np.stack([w.starts[first], w.ends[last]], 1)


@dataclass
class MilModel:
    weights: np.ndarray      # one per bucket, and 0 for the empty one
    bias: float
    shift: float             # log odds of the table's label share minus the sample's

    def score(self, buf: np.ndarray, offs: np.ndarray):
        """(document scores, sentence probabilities, sentence offsets, sentence spans)."""
        buckets, first, upto, spans = sentences(buf, offs)
        total = np.concatenate([[0.0], np.cumsum(self.weights[buckets].sum(1))])
        z = self.bias + total[np.append(first[1:], len(buckets))[:first.size]] - total[first]
        hidden = np.concatenate([[0.0], np.cumsum(np.logaddexp(0, z))])
        q = np.clip(hidden[upto[1:]] - hidden[upto[:-1]], 1e-12, 700)     # -log of the complement
        odds = np.log(np.expm1(q)) + self.shift
        return sigmoid(odds), sigmoid(z), upto, spans


def fit(sample: DataFrame, share: float) -> MilModel:
    """Train on the rows (text, label) of a bounded sample."""
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buf, offs in byte_blocks(batch.column("text")):
                buckets, first, upto, _ = sentences(buf, offs)
                cut = np.append(first, len(buckets))[upto]
                sizes = np.diff(np.append(first, len(buckets)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), batch.column("label").slice(row, end - row),
                     pa.array([buckets[cut[i]:cut[i + 1]].astype(np.int32).tobytes() for i in range(end - row)], pa.binary()),
                     pa.array([sizes[upto[i]:upto[i + 1]].astype(np.int32).tobytes() for i in range(end - row)], pa.binary())],
                    ["doc_id", "label", "words", "sizes"])

    rows = sample.select("doc_id", "label", "text").mapInArrow(
        features, "doc_id long, label int, words binary, sizes binary").toPandas()
    rows = rows.sort_values(["doc_id", "words"], kind="stable")
    weights = np.zeros(EMPTY + 1)
    y = rows["label"].to_numpy(np.float64)
    if not len(rows) or y.min() == y.max():
        return MilModel(weights, -50.0 if not len(rows) or y[0] == 0 else 5.0, 0.0)
    words = [np.frombuffer(x, np.int32) for x in rows["words"]]
    sizes = [np.frombuffer(x, np.int32) for x in rows["sizes"]]
    del rows
    return fit_arrays(words, sizes, y, share)


def fit_arrays(words: list[np.ndarray], sizes: list[np.ndarray], y: np.ndarray, share: float) -> MilModel:
    """Gradient descent on the noisy-or; words: feature buckets of each document in order
    (the list is emptied on the way), sizes: words of each of its sentences, y: its label
    (both values occur)."""
    weights = np.zeros(EMPTY + 1)
    docs_with = np.zeros(EMPTY + 1, np.int32)
    for x in words:
        docs_with[np.unique(x)] += 1
    docs_with[EMPTY] = 0
    used = np.flatnonzero(docs_with >= MIN_DOCS)
    local = np.full(EMPTY + 1, used.size, np.int32)         # the last place is for all others
    local[used] = np.arange(used.size)
    flat = np.empty((1 + len(STEMS), sum(x.size for x in words) // (1 + len(STEMS))), np.int32)
    at = flat.shape[1]
    while words:
        x = local[words.pop()].reshape(-1, flat.shape[0])
        at -= len(x)
        flat[:, at:at + len(x)] = x.T
    sentence = np.repeat(np.arange(sum(s.size for s in sizes), dtype=np.int32), np.concatenate(sizes))
    doc = np.repeat(np.arange(len(sizes)), [s.size for s in sizes])
    w, b = np.zeros(used.size + 1), np.full(1, -6.0)
    adam = Adam([w, b], RATE, FLOOR)
    for _ in range(STEPS):
        z = b[0] + sum(np.bincount(sentence, w[column], minlength=doc.size) for column in flat)
        p = sigmoid(z)
        q = np.clip(np.bincount(doc, np.logaddexp(0, z), minlength=y.size), 1e-9, 500)
        pull = (1 - y) - y / np.expm1(q)
        dz = p * pull[doc] / y.size
        each = dz[sentence]
        step = sum(np.bincount(column, each, minlength=w.size) for column in flat) + DECAY * w
        step[-1] = 0.0
        adam.step([step, np.array([dz.sum()])])
    w = w[:-1]
    weights[used] = w
    share = min(max(share, 1e-4), 1 - 1e-4)
    shift = np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return MilModel(weights, float(b[0]), float(shift))


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", per_class: int = PER_CLASS,
          id_col: str = "doc_id", text_col: str = "text") -> MilModel:
    """Model from at most `per_class` labelled rows of each class for which `usable` (a
    condition on doc_id) holds.  Without labels of both classes all scores are alike."""
    return fit(*labelled_sample(docs, labels, label, usable, per_class, id_col, text_col))


def toxicity(docs: DataFrame, model: MilModel, threshold: float = 0.5,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), predicted (score >= threshold),
    offending array<struct<start, end, score>>: byte spans, in the UTF-8 text, of the
    sentences whose own probability reaches the threshold, in order.

    A null, empty or wordless text scores close to 0 and has no offending sentence.
    Repeated rows and null ids give one row each; an empty table gives none; other columns
    are never read.
    """
    schema = "doc_id long, score double, offending array<struct<start: int, end: int, score: double>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buf, offs in byte_blocks(batch.column("text")):
                score, p, upto, spans = model.score(buf, offs)
                found: list[list] = [[] for _ in range(end - row)]
                for s in np.flatnonzero(p >= threshold):
                    i = int(np.searchsorted(upto, s, side="right")) - 1
                    found[i].append({"start": int(spans[s, 0] - offs[i]), "end": int(spans[s, 1] - offs[i]),
                                     "score": float(p[s])})
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), pa.array(score, pa.float64()), pa.array(found, kind)],
                    ["doc_id", "score", "offending"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema).select(
        "doc_id", "score", (F.col("score") >= F.lit(threshold)).cast("int").alias("predicted"), "offending")


def drop_toxic(docs: DataFrame, model: MilModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of `docs`, with all their columns, whose score is below the threshold.  One
    pass without a shuffle; null and empty texts stay, repeated rows share their fate."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.score(buf, offs)[0] < threshold for _, _, buf, offs in byte_blocks(batch.column(text_col))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
