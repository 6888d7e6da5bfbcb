"""Exact deduplication by sorting the content itself (operator 10).

1. Normalise: every run of whitespace bytes becomes one space; null counts as empty.
2. `repartitionByRange` on (first bytes, hash, id): Spark samples splitters and deals the
   rows into ranges.  The sampled keys are short (no whole text reaches the driver), and
   because the id is part of the key a text shared by a third of all rows is spread over
   as many ranges as it fills.
3. Each range is sorted externally by (first bytes, hash, text, id), so equal texts are
   neighbours and the smallest id leads.  One streaming pass compares neighbours byte by
   byte (the hash only skips comparisons that must fail) and closes runs of equal texts.
   It holds one Arrow batch, one text and the ids of the open run.
4. A run at either end of a range may go on in the next one: the texts of those runs (two
   per range, more only when hashes collide) are grouped by full text, which gives them
   the overall smallest id and size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.llm.scratch import saved

HEAD_BYTES = 48
_RUN_SCHEMA = ("doc_id long, keep_id long, group_size long, lead boolean, text_sha256 string, "
               "part int, run long, edge_text binary")


def normalised(text: Column) -> Column:
    """Whitespace runs as one space.  A lone space is already right, so it isn't rewritten."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbouring texts of one sorted range."""
    part = TaskContext.get().partitionId()
    names = ["doc_id", "keep_id", "group_size", "lead", "text_sha256", "part", "run", "edge_text"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    run = {"no": -1, "text": None, "hash": None, "ids": [], "sha": ""}
    first_hash = None
    pending: list[tuple] = []       # closed runs whose hash is that of the open one

    def emit(closed: list[tuple], last: bool) -> pa.RecordBatch | None:
        cols: list[list] = [[] for _ in names]
        for no, text, h, ids, sha in closed:
            edge = h == first_hash or last
            known = [i for i in ids if i is not None]
            keep = known[0] if known else None
            cols[0] += ids
            cols[1] += [keep] * len(ids)
            cols[2] += [len(ids)] * len(ids)
            cols[3] += [True] + [False] * (len(ids) - 1)
            cols[4] += [sha] * len(ids)
            cols[5] += [part] * len(ids)
            cols[6] += [no if edge else None] * len(ids)
            cols[7] += [text if edge else None] + [None] * (len(ids) - 1)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names) if cols[0] else None

    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        hashes = batch.column("hash").to_numpy(zero_copy_only=False)
        texts = batch.column("norm")
        done: list[tuple] = []
        new_hash = np.ones(len(ids), bool)
        new_hash[1:] = hashes[1:] != hashes[:-1]
        for i in range(len(ids)):
            h = hashes[i]
            text = None
            if run["text"] is not None and h == run["hash"]:
                text = texts[i].as_py()
                if text == run["text"]:
                    run["ids"].append(ids[i])
                    continue
            text = texts[i].as_py() if text is None else text
            if first_hash is None:
                first_hash = h
            if run["text"] is not None:
                pending.append((run["no"], run["text"], run["hash"], run["ids"], run["sha"]))
                if new_hash[i] and h != run["hash"]:
                    done += pending
                    pending.clear()
            run.update(no=run["no"] + 1, text=text, hash=h, ids=[ids[i]], sha=hashlib.sha256(text).hexdigest())
        if (out := emit(done, False)) is not None:
            yield out
    if run["text"] is not None:
        pending.append((run["no"], run["text"], run["hash"], run["ids"], run["sha"]))
        if (out := emit(pending, True)) is not None:
            yield out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are after each `[\\x20\\x09-\\x0D]+` became one space
    (no trimming); a null text equals the empty one.  The smallest id of a group is its
    keep_id; a null id is never the smallest.  Of rows that tie on the smallest id
    (repeated rows) exactly one has kept = true, so each group keeps one row.  An empty
    table gives an empty result; other columns of `docs` are never read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       normalised(F.col(text_col)).cast("binary").alias("norm"))
    rows = rows.select("doc_id", "norm", F.substring("norm", 1, HEAD_BYTES).alias("head"),
                       F.xxhash64("norm").alias("hash"))
    order = [F.col("head"), F.col("hash"), F.col("norm"), F.col("doc_id").asc_nulls_last()]
    ranged = (rows.repartitionByRange("head", "hash", F.col("doc_id").asc_nulls_last())
              .sortWithinPartitions(*order).select("doc_id", "hash", "norm"))
    runs = saved(ranged.mapInArrow(_runs, _RUN_SCHEMA), "content-sort")
    edges = runs.where(F.col("edge_text").isNotNull()).select(
        "part", "run", "edge_text", "keep_id", "group_size")
    whole = edges.groupBy("edge_text").agg(
        F.min("keep_id").alias("all_keep"), F.sum("group_size").alias("all_size"),
        F.min(F.struct(F.col("keep_id").isNull().alias("n"), "keep_id", "part")).alias("m"))
    fixed = edges.join(whole, "edge_text").select(
        F.col("part").alias("p"), F.col("run").alias("r"), "all_keep", "all_size", F.col("m.part").alias("lead_part"))
    inner = runs.where(F.col("run").isNull()).select(
        "doc_id", "keep_id", "group_size", F.col("lead").alias("kept"), "text_sha256")
    outer = (runs.where(F.col("run").isNotNull())
             .join(fixed, (F.col("part") == F.col("p")) & (F.col("run") == F.col("r")))
             .select("doc_id", F.col("all_keep").alias("keep_id"), F.col("all_size").alias("group_size"),
                     (F.col("lead") & (F.col("part") == F.col("lead_part"))).alias("kept"), "text_sha256"))
    return inner.unionByName(outer)


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `docs` that `exact_dedup` keeps, with all their columns.

    Rows are found again by (id, digest of the normalised text); where the table repeats
    such a pair, one of the repeated rows stays.
    """
    marked = saved(exact_dedup(docs, id_col, text_col), "exact-dedup")
    keep = marked.where("kept").select(F.col("doc_id").alias("__keep_id"), F.col("text_sha256").alias("__keep_sha"))
    sha = F.sha2(normalised(F.col(text_col)).cast("binary"), 256)
    pair = [F.col(id_col).cast("long").eqNullSafe(F.col("__keep_id")), sha == F.col("__keep_sha")]
    out = docs.join(keep, pair[0] & pair[1], "left_semi")
    repeated = marked.groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).count()
    if repeated:
        out = out.withColumn("__sha", sha).dropDuplicates([id_col, "__sha"]).drop("__sha")
    return out
