"""Line deduplication by range-partitioned hashes (operator 12).

1. Every line's key (stripped, A-Z folded) becomes a 128-bit hash; a row of a line is
   (hash, document, position): no text is shuffled.
2. `repartitionByRange` on (hash, document, position) deals the rows into sampled ranges and
   each range is sorted by (hash, document falling, position).  Because document and
   position are part of the range key, a line that a third of all documents hold fills as
   many ranges as it needs.
3. One streaming pass per range keeps the first occurrence (the largest document) of each
   hash and drops the rest once a third document is seen.  It holds one Arrow batch and
   the positions of one document.
4. A hash that may begin in an earlier range, or go on in a later one, is decided by an
   aggregate over those border rows (partial per task, then per hash and document).
5. The dropped positions of a document become one compressed bitmap, which is all that is
   joined back to the documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.llm.scratch import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\f\r"
LEAST_DOCS = 3
_MARK_SCHEMA = "h1 long, h2 long, doc_id long, text_hash long, pos int, dropped boolean"
_MARK_ARROW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()),
                         ("pos", pa.int32()), ("dropped", pa.bool_())])
_BITMAP_SCHEMA = "doc_id long, text_hash long, n_dropped long, keep binary"


def text_hash(text: Column) -> Column:
    """Tells apart rows that share an id; rows equal in both are decided alike."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_rows(docs: DataFrame, least_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, doc_id, text_hash, pos) of every line whose key has `least_chars` code points."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"),
                        F.posexplode(F.split(F.translate(text, UPPER, LOWER), "\n")).alias("pos", "line"))
    keys = lines.select("doc_id", "text_hash", "pos", F.btrim("line", F.lit(SPACES)).alias("key"))
    return keys.where(F.char_length("key") >= least_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "doc_id", "text_hash", "pos")


class _Range:
    """Streaming pass over one sorted range.  `rank` counts the documents of a hash seen
    before a row's own: 0 is the document that keeps its lines."""

    def __init__(self, least: int):
        self.least = least                     # documents from which a hash loses lines
        self.last: tuple | None = None         # (h1, h2, doc) of the last row
        self.run, self.rank = -1, 0
        self.waiting: list[pa.RecordBatch] = []    # rows of ranks 1 to least - 2 of the open hash
        self.seen: list[tuple] = []            # first `least` documents of the open hash

    @staticmethod
    def _batch(rows: pa.RecordBatch, take: np.ndarray, dropped: bool) -> pa.RecordBatch:
        part = rows.take(pa.array(take))
        return pa.RecordBatch.from_arrays(
            [part.column(n) for n in _MARK_ARROW.names[:-1]] + [pa.array(np.full(take.size, dropped))], schema=_MARK_ARROW)

    def step(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        h1, h2 = (rows.column(c).to_numpy() for c in ("h1", "h2"))
        null = rows.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        doc = rows.column("doc_id").fill_null(0).to_numpy()
        key_edge, doc_edge = np.ones(h1.size, bool), np.ones(h1.size, bool)
        key_edge[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        doc_edge[1:] = key_edge[1:] | (doc[1:] != doc[:-1]) | (null[1:] != null[:-1])
        first = (h1[0], h2[0], None if null[0] else doc[0])
        if self.last is not None and first[:2] == self.last[:2]:
            key_edge[0] = False
            doc_edge[0] = first[2] != self.last[2]
        run = self.run + np.cumsum(key_edge)
        steps = np.cumsum(doc_edge & ~key_edge)
        starts = np.flatnonzero(key_edge)
        group = np.cumsum(key_edge)                                    # 0: the hash of the batch before goes on
        base = np.concatenate([[-self.rank], steps[starts]])
        rank = steps - base[group]
        most = np.zeros(starts.size + 1, np.int64)
        most[0] = self.rank                                            # (no rows of group 0: unchanged)
        np.maximum.at(most, group, rank)
        if starts.size and self.waiting and self.run > 0 and most[0] < self.least - 1:
            self.waiting.clear()                                       # the open hash ended with too few documents
        if self.waiting and most[0] >= self.least - 1:
            yield from self.waiting
            self.waiting.clear()
        inner = run > 0
        loses = inner & (rank > 0) & (most[group] >= self.least - 1)
        if loses.any():
            yield self._batch(rows, np.flatnonzero(loses), True)
        if not inner.all():                                            # the first hash may have begun earlier
            yield self._batch(rows, np.flatnonzero(~inner), False)
        tail = np.flatnonzero(inner & (group == group[-1]))
        if starts.size:
            self.seen = []
        if tail.size:
            held = tail[rank[tail] > 0]
            if most[group[-1]] < self.least - 1 and held.size:
                self.waiting.append(self._batch(rows, held, True))
            for i in tail[doc_edge[tail]][:self.least].tolist():
                if len(self.seen) < self.least:
                    self.seen.append((int(h1[i]), int(h2[i]), None if null[i] else int(doc[i])))
        self.run, self.rank = int(run[-1]), int(rank[-1])
        self.last = (h1[-1], h2[-1], None if null[-1] else doc[-1])

    def end(self) -> Iterator[pa.RecordBatch]:
        """The open hash may go on in the next range: its documents, and rows not decided."""
        for rows in self.waiting:
            yield rows.set_column(5, "dropped", pa.array(np.zeros(rows.num_rows, bool)))
        if self.seen:
            cols = [[s[k] for s in self.seen] for k in range(3)] + [[0] * len(self.seen), [-1] * len(self.seen),
                                                                    [False] * len(self.seen)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _MARK_ARROW)], schema=_MARK_ARROW)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, maps = [], []
        for places in batch.column("places"):
            places = places.values.to_numpy()
            keep = np.ones((int(places.max()) | 7) + 1, np.uint8)          # whole bytes
            keep[places] = 0
            counts.append(places.size)
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())],
            ["doc_id", "text_hash", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, least_chars: int = 20, least_docs: int = LEAST_DOCS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_dropped, keep of every document that loses lines.

    Texts are split at line feeds (null or empty: one empty line).  A line's key is the
    line without `[\\x20\\x09-\\x0D]` at both ends, A-Z folded.  A key of at least
    `least_chars` code points that at least `least_docs` (two or more) documents hold loses all its lines
    but those of the largest doc_id that holds it.  `keep` is a zlib-compressed bitmap, one
    bit per line, least significant first; lines past its end are kept, and so is every
    line of a document without a row.  Rows are told apart by (id, hash of the text):
    rows that share an id count as one document, rows equal in both have one bitmap, null
    ids are one document below all others.  Keys are compared by two 64-bit hashes.  An
    empty table gives an empty result; other columns are never read.
    """
    if least_docs < 2:
        raise ValueError("least_docs: two or more")
    rows = line_rows(docs, least_chars, id_col, text_col)
    order = ["h1", "h2", F.col("doc_id").desc(), "pos"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Range(least_docs)
        for batch in batches:
            if batch.num_rows:
                yield from state.step(batch)
        yield from state.end()

    marks = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(stream, _MARK_SCHEMA), "line-marks")
    border = marks.where("NOT dropped")
    # at most two hashes per range; as a table of known size Spark ships it to the border rows
    # where it is below the broadcast threshold, and a hot hash's rows stay spread
    holders = saved(border.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2")
                    .agg(F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("held_by")).where(F.col("held_by") >= least_docs),
                    "line-holders")
    late = (border.where("pos >= 0").join(holders, ["h1", "h2"])
            .where(~F.col("doc_id").eqNullSafe(F.col("last"))))
    gone = marks.where("dropped").select("doc_id", "text_hash", "pos").unionByName(late.select("doc_id", "text_hash", "pos"))
    places = gone.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("places"))
    return saved(places.mapInArrow(_bitmaps, _BITMAP_SCHEMA), "line-bitmaps")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, kept = [], []
        for text, keep in zip(batch.column("text"), batch.column("keep").to_pylist()):
            lines = (text.as_py() or "").split("\n")
            n_lines.append(len(lines))
            if keep is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
                lines = [x for i, x in enumerate(lines) if i >= bits.size or bits[i]]
            kept.append("\n".join(lines))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_lines, pa.int64()), batch.column("n_dropped"), pa.array(kept, pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text that stays) of every row of `docs`.

    Spark ships the bitmaps to the documents when their table is below its broadcast
    threshold, and joins by id and text hash beyond."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       text_hash(F.col(text_col)).alias("text_hash"))
    maps = bitmaps.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "n_dropped", "keep")
    joined = rows.join(maps, (F.col("text_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return joined.select("doc_id", "text", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep") \
        .mapInArrow(_applied, "doc_id long, n_lines long, n_dropped long, kept string")
