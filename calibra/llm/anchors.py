"""Substring deduplication with fixed-block anchors (operator 2).

A window of W words that occurs twice holds, in each of its occurrences, one whole block
of B = (W + 1) // 2 words that starts at a multiple of B in its document.  So:

1. Index the non-overlapping blocks of every document and probe them with every rolling
   window of B words.  A gram that is somewhere a block and occurs twice is a hit.
2. Extend the hits: the windows of W words around them are compared over the whole table
   by two independent 64-bit hashes of their words.  Overlapping repeated windows join to
   maximal exact repeats, and the words they cover go.

Documents are dealt to chunks by a hash of id and text.  A chunk sends each bucket (a
range of gram hashes) its distinct grams once, as one sorted and byte-sliced array with
two flags per gram (is a block here; occurs more than once here), and gets back those that
hit.  A passage that a third of all documents share therefore costs one entry per chunk,
never one per occurrence, and no pair of occurrences is ever formed.

Scale: three shuffles of packed arrays (about 2, 0.5 and 8 bytes per word that matters)
and one shuffle of the texts, reused by all three passes.  Chunks and buckets have a fixed
mean size, so their number follows the input.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.textblocks import byte_blocks, rolling, window_starts, words_of

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 32 << 20
LEAST_CHUNKS = 64

#: Items (hash of each word or byte) of a column of texts, and the row offsets.
Items = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def word_items(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a column of texts and the offsets of its rows."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, _, buf, offs in byte_blocks(col):
        w, h = words_of(buf, offs)
        hashes.append(h)
        counts.append(np.diff(w.offsets))
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


def _slice_bytes(values: np.ndarray) -> bytes:
    """Sorted integers as differences, byte plane by byte plane (shuffle compression then
    removes the empty planes)."""
    steps = np.diff(values, prepend=values[:1] * 0)
    return steps.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _joined(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel(), dtype=kind)


def _by_bucket(bucket: np.ndarray, n_buckets: int):
    """(bucket, slice) of each run of an ascending bucket array."""
    edges = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=bucket.dtype))
    return ((b, slice(edges[b], edges[b + 1])) for b in np.flatnonzero(np.diff(edges)).tolist())


def _table(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


class Repeats:
    """The passes over chunks and buckets, for windows of `window` items.

    `bits`: the leading bits of a gram's hash that name its bucket.
    """

    gram_schema = "bucket int, chunk long, grams binary, flags binary"
    hit_schema = "chunk long, bucket int, grams binary"

    def __init__(self, items: Items, window: int, bits: int):
        self.items, self.window, self.bits = items, window, bits
        self.block = (window + 1) // 2

    # pass 1: a chunk's distinct grams, with flags
    def grams(self, docs: pa.Table) -> pa.Table:
        items, offs = self.items(docs["text"])
        at, rows = window_starts(offs, self.block)
        hashes = rolling(items, self.block)[at]
        anchor = ((at - offs[rows]) % self.block == 0).astype(np.uint64)
        keys = np.sort((hashes & ~np.uint64(1)) | anchor)
        hashes = keys >> np.uint64(1)
        new = np.ones(keys.size, bool)
        new[1:] = hashes[1:] != hashes[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], keys.size)[:first.size] - 1
        flags = (keys[last] & np.uint64(1)).astype(np.uint8) | ((last > first).astype(np.uint8) << 1)
        short = keys[first] >> np.uint64(32 - self.bits)
        bucket, rest = (short >> np.uint64(32)).astype(np.int64), short.astype(np.uint32)
        chunk = docs["chunk"][0].as_py()
        out: tuple[list, ...] = ([], [], [], [])
        for b, part in _by_bucket(bucket, 1 << self.bits):
            out[0].append(b)
            out[1].append(chunk)
            out[2].append(_slice_bytes(rest[part]))
            out[3].append(flags[part].tobytes())
        return _table({"bucket": (out[0], pa.int32()), "chunk": (out[1], pa.int64()),
                       "grams": (out[2], pa.binary()), "flags": (out[3], pa.binary())})

    # a bucket: grams that are a block somewhere and occur twice
    def hits(self, sent: pa.Table) -> pa.Table:
        chunks, bucket = sent["chunk"].to_pylist(), sent["bucket"][0].as_py()
        grams = [_joined(g, np.uint32) for g in sent["grams"].to_pylist()]
        flags = np.concatenate([np.frombuffer(f, np.uint8) for f in sent["flags"].to_pylist()])
        sender = np.repeat(np.arange(len(grams)), [g.size for g in grams])
        keys = np.sort(np.concatenate(grams).astype(np.uint64) << np.uint64(32)
                       | sender.astype(np.uint64) << np.uint64(2) | flags)
        gram = keys >> np.uint64(32)
        new = np.ones(keys.size, bool)
        new[1:] = gram[1:] != gram[:-1]
        first = np.flatnonzero(new)
        flag = (keys & np.uint64(3)).astype(np.uint8)
        seen = np.bitwise_or.reduceat(flag, first)
        size = np.diff(np.append(first, keys.size))
        hit = np.repeat((seen & 1 > 0) & ((size > 1) | (seen & 2 > 0)), size)
        keys = keys[hit]
        return self._replies(chunks, bucket, ((keys >> np.uint64(2)) & np.uint64(0x3FFFFFFF)).astype(np.int64),
                             (keys >> np.uint64(32)).astype(np.uint32))

    @staticmethod
    def _replies(chunks: list, bucket: int, sender: np.ndarray, values: np.ndarray) -> pa.Table:
        """One row per chunk that sent something that hit; values ascend within a sender."""
        order = np.argsort(sender, kind="stable")
        sender, values = sender[order], values[order]
        out: tuple[list, list] = ([], [])
        for s, part in _by_bucket(sender, len(chunks)):
            out[0].append(chunks[s])
            out[1].append(_slice_bytes(values[part]))
        return _table({"chunk": (out[0], pa.int64()), "bucket": ([bucket] * len(out[0]), pa.int32()),
                       "grams": (out[1], pa.binary())})

    # pass 2: whole windows around the hits
    def candidates(self, items: np.ndarray, offs: np.ndarray, hits: pa.Table) -> np.ndarray:
        """Starts of windows that hold a hit."""
        known = [_joined(g, np.uint32).astype(np.uint64) | np.uint64(b << 32)
                 for b, g in sorted(zip(hits["bucket"].to_pylist(), hits["grams"].to_pylist()))]
        starts, _ = window_starts(offs, self.window)
        if not known or not starts.size:
            return starts[:0]
        known = np.concatenate(known)
        at, _ = window_starts(offs, self.block)
        short = rolling(items, self.block)[at] >> np.uint64(32 - self.bits)
        place = np.minimum(np.searchsorted(known, short), known.size - 1)
        found = np.zeros(items.size + 1, np.int32)
        found[at[known[place] == short] + 1] = 1
        found = np.cumsum(found)
        return starts[found[starts + self.window - self.block + 1] > found[starts]]

    def windows(self, docs: pa.Table, hits: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        if docs.num_rows and hits.num_rows:
            items, offs = self.items(docs["text"])
            at = self.candidates(items, offs, hits)
            value = rolling(items, self.window)[at]
            bucket = (rolling(items, self.window, 1)[at] >> np.uint64(64 - self.bits)).astype(np.int64)
            order = np.lexsort((value, bucket))
            value, bucket = value[order], bucket[order]
            new = np.ones(at.size, bool)
            new[1:] = (value[1:] != value[:-1]) | (bucket[1:] != bucket[:-1])
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, at.size)) > 1
            value, bucket = value[first], bucket[first]
            chunk = docs["chunk"][0].as_py()
            for b, part in _by_bucket(bucket, 1 << self.bits):
                out[0].append(b)
                out[1].append(chunk)
                out[2].append(value[part].tobytes())
                out[3].append(np.packbits(many[part]).tobytes())
        return _table({"bucket": (out[0], pa.int32()), "chunk": (out[1], pa.int64()),
                       "grams": (out[2], pa.binary()), "flags": (out[3], pa.binary())})

    # a bucket: windows that occur twice
    def repeated(self, sent: pa.Table) -> pa.Table:
        chunks, bucket = sent["chunk"].to_pylist(), sent["bucket"][0].as_py()
        values = [np.frombuffer(g, np.uint64) for g in sent["grams"].to_pylist()]
        many = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=v.size)
                               for f, v in zip(sent["flags"].to_pylist(), values)])
        sender = np.repeat(np.arange(len(values)), [v.size for v in values])
        value = np.concatenate(values)
        order = np.argsort(value, kind="stable")
        value, sender, many = value[order], sender[order], many[order]
        new = np.ones(value.size, bool)
        new[1:] = value[1:] != value[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, value.size))
        hit = np.repeat((size > 1) | (np.bitwise_or.reduceat(many, first) > 0), size)
        return self._replies(chunks, bucket, sender[hit], value[hit])

    # pass 3: items covered by repeated windows
    def covered(self, items: np.ndarray, offs: np.ndarray, found: pa.Table) -> np.ndarray:
        gone = np.zeros(items.size + 1, np.int32)
        values = [_joined(g, np.uint64) for g in found["grams"].to_pylist()]
        starts, _ = window_starts(offs, self.window)
        if values and starts.size:
            known = np.sort(np.concatenate(values))
            value = rolling(items, self.window)[starts]
            place = np.minimum(np.searchsorted(known, value), known.size - 1)
            starts = starts[known[place] == value]
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + self.window, -1)
        return np.cumsum(gone[:-1]) > 0


def chunked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(doc_id, text, chunk), and the bucket bits for the size of the table."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    chunks = max(LEAST_CHUNKS, math.ceil(size / CHUNK_BYTES))
    bits = max(1, math.ceil(math.log2(max(1.0, size / BUCKET_BYTES))))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks).cast("long")))
    return dealt, bits


def repeated_windows(dealt: DataFrame, plan: Repeats) -> DataFrame:
    """Windows of each chunk that occur twice in the table (rows of `Repeats.hit_schema`).

    (Spark counts a bound method's `self` as an argument, hence the lambdas.)
    """
    grams = dealt.groupBy("chunk").applyInArrow(lambda t: plan.grams(t), plan.gram_schema)
    hits = grams.groupBy("bucket").applyInArrow(lambda t: plan.hits(t), plan.hit_schema)
    windows = (dealt.groupBy("chunk").cogroup(hits.groupBy("chunk"))
               .applyInArrow(lambda d, h: plan.windows(d, h), plan.gram_schema))
    return windows.groupBy("bucket").applyInArrow(lambda t: plan.repeated(t), plan.hit_schema)


def _kept(plan: Repeats, docs: pa.Table, found: pa.Table) -> pa.Table:
    out: tuple[list, ...] = ([], [], [], [])
    if docs.num_rows:
        items, offs = plan.items(docs["text"])
        gone = plan.covered(items, offs, found)
        for i, text in enumerate(docs["text"].combine_chunks().cast(pa.large_binary()).to_pylist()):
            lost = gone[offs[i]:offs[i + 1]]
            words = (text or b"").split()
            n = int(lost.sum())
            out[0].append(len(words))
            out[1].append(n)
            out[2].append(b" ".join(compress(words, (~lost).tolist()) if n else words))
            edge = np.flatnonzero(np.diff(lost.astype(np.int8), prepend=0, append=0)) if n else []
            out[3].append([{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
    ids = docs["doc_id"] if docs.num_rows else pa.array([], pa.int64())
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    return pa.table({"doc_id": ids, "n_words": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()),
                     "kept": pa.array(out[2], pa.binary()).cast(pa.string()), "removed": pa.array(out[3], span)})


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the words left, joined by
    one space), removed (word spans [first, end) that went).

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged.  A word goes when it is covered by a
    window of `window` consecutive words of its document whose word sequence also starts
    anywhere else, the same document and overlapping places included; every occurrence
    goes, the first too.  Null and empty texts and texts of fewer words keep all they have
    and remove nothing.  Repeated rows are documents of their own, so their windows repeat
    each other.  An empty table gives an empty result; other columns are never read.
    """
    dealt, bits = chunked(docs, id_col, text_col)
    plan = Repeats(word_items, window, bits)
    found = repeated_windows(dealt, plan)

    def kept(docs: pa.Table, found: pa.Table) -> pa.Table:
        return _kept(plan, docs, found)

    return (dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(
        kept, "doc_id long, n_words long, n_removed long, kept string, "
              "removed array<struct<first: int, end: int>>"))
