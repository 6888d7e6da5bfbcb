"""Vectorised text helpers for Arrow batches: byte blocks, words and rolling hashes.

Texts are handled as the UTF-8 bytes Arrow already holds.  `byte_blocks` cuts a batch
into blocks of whole rows (about `limit` bytes, one row at least, so a very long text is
a block of its own); `find_words` locates words and hashes them with a polynomial hash
modulo 2**64 whose powers are shared by all blocks; `rolling` hashes every k consecutive
items of each document from one cumulative sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: An array of a 64-bit number per byte of a block takes 4 MB, and a worker has some ten of
#: them at once; larger blocks are no faster.
BLOCK_BYTES = 1 << 19

#: Whitespace of the word rule `[^\x20\x09-\x0D]+`.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_rng = np.random.default_rng(20_240_229)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_CODE_FOLDED = _BYTE_CODE.copy()
_BYTE_CODE_FOLDED[65:91] = _BYTE_CODE[97:123]
#: Odd, 3 modulo 8: differences of powers keep all but a few low bits.
_BASES = (0x9E3779B97F4A7C13, 0xD1342543DE82EF9B)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, at least n of them."""
    have = _POWERS.get(which)
    if have is None or have[0].size < n:
        size = max(n, 1 << 16)
        base = _BASES[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        have = (out[0], out[1])
        if n > BLOCK_BYTES * 2:
            return have            # a huge text: not kept for later blocks
        _POWERS[which] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the row offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    col = col.cast(pa.large_binary())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1] if len(col) \
        else np.zeros(1, np.int64)
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def byte_blocks(col: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive blocks of whole rows."""
    data, offs = column_bytes(col)
    n, row = offs.size - 1, 0
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offs[row]:offs[end]], offs[row:end + 1] - offs[row]
        row = end


class Words(NamedTuple):
    starts: np.ndarray      # first byte of each word
    ends: np.ndarray        # one past the last byte
    offsets: np.ndarray     # words of row i: offsets[i]:offsets[i + 1]


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> Words:
    """Maximal runs of non-whitespace bytes within each row."""
    n = buf.size
    if n == 0:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(offs.size, np.int64))
    space = IS_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    solid = ~space
    opens, closes = edge[:n].copy(), edge[1:].copy()
    opens[1:] |= space[:-1]
    closes[:-1] |= space[1:]
    starts = np.flatnonzero(opens & solid)
    ends = np.flatnonzero(closes & solid) + 1
    return Words(starts, ends, np.searchsorted(starts, offs))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hash of each byte span; `fold` hashes A-Z as a-z."""
    power, inverse = _powers(buf.size + 1)
    total = np.zeros(buf.size + 1, np.uint64)
    np.cumsum((_BYTE_CODE_FOLDED if fold else _BYTE_CODE)[buf] * power[:buf.size], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def rolling(items: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of items[i:i+k] for every i with k items left (rows are cut by `window_starts`)."""
    n = items.size
    if n < k:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(n + 1, which)
    if which:
        items = mix(items + np.uint64(0x632BE59BD9B4E019))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(items * power[:n], out=total[1:])
    return mix((total[k:] - total[:n - k + 1]) * inverse[:n - k + 1])


def window_starts(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window of k items fits in its row, and each position's row."""
    lengths = np.diff(offsets)
    counts = np.maximum(lengths - k + 1, 0)
    rows = np.repeat(np.arange(lengths.size), counts)
    first = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - first[rows] + offsets[:-1][rows], rows


def words_of(buf: np.ndarray, offs: np.ndarray, fold: bool = False) -> tuple[Words, np.ndarray]:
    w = word_bounds(buf, offs)
    return w, hash_spans(buf, w.starts, w.ends, fold)
