"""Shared pieces of the trained operators: split, bounded training sample, optimiser."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column | str, per_class: int,
                    id_col: str, text_col: str) -> tuple[DataFrame, float]:
    """(doc_id, text, label) of at most `per_class` training rows of each class, and the
    share of label 1 among all training rows.

    The rows are those with the smallest hash of their id, so the choice is the same in
    every run and its size does not depend on the table (2 * per_class ids are broadcast).
    An id with several labels counts with its smallest; null labels and ids are left out.
    """
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).where(usable)
             .groupBy("doc_id").agg(F.min("label").alias("label")))
    known = known.join(docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    share = known.agg(F.avg("label")).head()[0]
    order = F.xxhash64("doc_id", F.lit(5))
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(order, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id"), 0.5 if share is None else float(share)


class Adam:
    """Adam steps for a list of arrays changed in place.  A larger `floor` keeps values whose
    gradients are tiny (rare features) from moving as fast as the others."""

    def __init__(self, values: list[np.ndarray], rate: float, floor: float = 1e-8):
        self.values, self.rate, self.floor, self.t = values, rate, floor, 0
        self.first = [np.zeros_like(v) for v in values]
        self.second = [np.zeros_like(v) for v in values]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        for v, g, a, b in zip(self.values, gradients, self.first, self.second):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            v -= self.rate * (a / (1 - 0.9 ** self.t)) / (np.sqrt(b / (1 - 0.999 ** self.t)) + self.floor)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))
