"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation (operator 3).

No regular expression runs over the texts.  Each block of texts becomes an array of
symbols, one per code point: its class (letter, number, other, whitespace) refined by
one or two code points of lookahead (an apostrophe that starts a contraction, the last
blank before a word).  A deterministic automaton over those symbols says where pre-tokens
start.  Its transition functions form a small monoid whose composition table is closed
once; because composition is associative the automaton's state at every position comes
from a blocked prefix scan over function numbers: columns of a (rows x width) array are
composed in lockstep, row totals are scanned by doubling, and each column takes one step
from its known state.  The slices between starts feed a merge cache.

The rule it reproduces is the one of `public_tokenizers.PATTERN`; the class table is
made by asking the regex module for the class of every code point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.pair_merge import from_ranks, read_ranks
from calibra.llm.textblocks import byte_blocks

CACHE_ENTRIES = 200_000
WIDTH = 64

# Symbols: letter, number, other, contraction of one letter, of two letters, blank that
# joins the next word, lone last whitespace, whitespace inside or at the end.
LETTER, NUMBER, OTHER, SHORT, LONG, JOIN, LAST, INNER = range(8)
# States after a code point.
IN_LETTER, IN_NUMBER, IN_OTHER, ONE_LEFT, TWO_LEFT, CLOSED, OPEN, IN_SPACE = range(8)
N_SYMBOLS, N_STATES = 8, 8


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, a pre-token starts here)."""
    if symbol == LETTER:
        if state == TWO_LEFT:
            return ONE_LEFT, False
        if state == ONE_LEFT:
            return CLOSED, False
        return IN_LETTER, state not in (IN_LETTER, OPEN)
    if symbol == NUMBER:
        return IN_NUMBER, state not in (IN_NUMBER, OPEN)
    if symbol in (OTHER, SHORT, LONG):
        if state in (IN_OTHER, OPEN):
            return IN_OTHER, False
        return {OTHER: IN_OTHER, SHORT: ONE_LEFT, LONG: TWO_LEFT}[symbol], True
    if symbol == JOIN:
        return OPEN, True
    if symbol == LAST:
        return CLOSED, True
    return IN_SPACE, state != IN_SPACE


@lru_cache(maxsize=1)
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol -> function number, composition table, function -> state from CLOSED,
    starts[state, symbol]).

    Symbols 8-15 are the same at the first code point of a text: constant functions, so
    texts never see each other's state.
    """
    functions: list[tuple[int, ...]] = []
    for s in range(N_SYMBOLS):
        functions.append(tuple(_step(q, s)[0] for q in range(N_STATES)))
    for s in range(N_SYMBOLS):
        functions.append((_step(CLOSED, s)[0],) * N_STATES)
    number = {}
    closed: list[tuple[int, ...]] = []
    for f in functions:
        if f not in number:
            number[f] = len(closed)
            closed.append(f)
    generators = list(closed)
    i = 0
    while i < len(closed):
        for g in generators:
            h = tuple(g[q] for q in closed[i])
            if h not in number:
                number[h] = len(closed)
                closed.append(h)
        i += 1
    identity = tuple(range(N_STATES))
    if identity not in number:
        number[identity] = len(closed)
        closed.append(identity)
    m = len(closed)
    table = np.array(closed, np.int64)
    compose = np.empty((m, m), np.uint16)
    for a in range(m):
        for b in range(m):
            compose[a, b] = number.get(tuple(table[b][table[a]]), 0)
    starts = np.array([[_step(q, s)[1] for s in range(N_SYMBOLS)] for q in range(N_STATES)], bool)
    symbol_function = np.array([number[f] for f in functions], np.uint16)
    return symbol_function, compose, table.astype(np.uint8), starts


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    """Class of every code point: 0 letter, 1 number, 2 other, 3 whitespace."""
    kinds = np.full(0x110000, 2, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, rule in ((0, r"\p{L}+"), (1, r"\p{N}+"), (3, r"\s+")):
        for run in regex.finditer(rule, every):
            first, last = ord(run.group()[0]), ord(run.group()[-1])
            kinds[first:last + 1] = kind
            if first < 0xD800 <= last:
                kinds[0xD800:0xE000] = 2
    return kinds


def _symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbol of every code point; `first` marks the first code point of each text."""
    kind = code_point_classes()[points]
    n = points.size
    ends = np.empty(n, bool)                       # the last code point of its text
    ends[:-1], ends[-1] = first[1:], True
    symbol = kind.copy()                           # 0, 1, 2 are LETTER, NUMBER, OTHER
    blank = kind == 3
    solid_next = np.zeros(n, bool)
    solid_next[:-1] = ~blank[1:]
    solid_next &= ~ends
    symbol[blank] = INNER
    symbol[blank & solid_next] = LAST
    symbol[(points == 32) & solid_next] = JOIN
    quotes = np.flatnonzero((points == 39) & ~ends)
    if quotes.size:
        one = points[quotes + 1]
        symbol[quotes[np.isin(one, [115, 116, 109, 100])]] = SHORT          # s t m d
        room = quotes + 2 < n
        two = points[np.minimum(quotes + 2, n - 1)]
        room &= ~ends[quotes + 1]
        pairs = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        symbol[quotes[room & pairs]] = LONG                                  # re ve ll
    return symbol


def pre_token_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a pre-token starts, for code points of several texts in a row."""
    n = points.size
    if n == 0:
        return np.zeros(0, bool)
    symbol_function, compose, table, starts = _automaton()
    symbol = _symbols(points, first)
    rows = -(-n // WIDTH)
    padded = np.zeros(rows * WIDTH, np.uint8)
    padded[:n] = symbol
    padded[:n][first] += N_SYMBOLS
    grid = np.ascontiguousarray(symbol_function[padded].reshape(rows, WIDTH).T)
    flat, m = compose.ravel(), compose.shape[0]
    total = grid[0]
    for c in range(1, WIDTH):                      # function of each whole row
        total = flat[total.astype(np.int64) * m + grid[c]]
    reach = 1
    while reach < rows:                            # prefix scan of the rows by doubling
        joined = flat[total[:-reach].astype(np.int64) * m + total[reach:]]
        total = np.concatenate([total[:reach], joined])
        reach *= 2
    state = np.empty(rows, np.uint8)               # state before each row
    state[0] = CLOSED
    state[1:] = table[total[:-1], CLOSED]
    step = table.ravel()
    symbols = np.ascontiguousarray((padded % N_SYMBOLS).reshape(rows, WIDTH).T)
    opened = np.empty((WIDTH, rows), bool)
    allow = starts.ravel()
    for c in range(WIDTH):
        opened[c] = allow[state.astype(np.int64) * N_SYMBOLS + symbols[c]]
        state = step[grid[c].astype(np.int64) * N_STATES + state]
    out = np.ascontiguousarray(opened.T).reshape(-1)[:n]
    out[first] = True
    return out


def split_block(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where pre-tokens start in a block of texts, and how many start
    before each text (offsets into the first array)."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.zeros(points.size, bool)
    at = np.searchsorted(lead, offs[:-1])
    first[at[at < points.size]] = True
    starts = lead[pre_token_starts(points, first)]
    return starts, np.searchsorted(starts, offs)


def encode_block(buf: np.ndarray, offs: np.ndarray,
                 packed: Callable[[list[bytes]], list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, byte offset of each pre-token) of every text of a block; `packed` gives the
    ids of pre-tokens as little-endian 32-bit integers."""
    starts, upto = split_block(buf, offs)
    data = buf.tobytes()
    edges = starts.tolist() + [len(data)]
    pieces = packed([data[a:b] for a, b in zip(edges, edges[1:])])
    for row in range(offs.size - 1):
        a, b = upto[row], upto[row + 1]
        yield np.frombuffer(b"".join(pieces[a:b]), "<i4"), starts[a:b] - offs[row]


class Ranks:
    """Merge ranks of a rank file: encodes pre-tokens, decodes id arrays."""

    def __init__(self, path: str):
        rank = read_ranks(path)
        self.merger = from_ranks(rank)
        by_id = [b""] * (max(rank.values()) + 1)
        for token, i in rank.items():
            by_id[i] = token
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.cache: dict[bytes, bytes] = {}

    def packed(self, words: list[bytes]) -> list[bytes]:
        """Packed ids (little-endian 32-bit) of every word; words that are new to this
        worker are merged together and cached."""
        cache = self.cache
        out = list(map(cache.get, words))
        if None in out:
            new = list({w for w, ids in zip(words, out) if ids is None})
            if len(cache) + len(new) > CACHE_ENTRIES:
                cache.clear()
            fresh = dict(zip(new, self.merger.packed(new)))
            cache.update((w, ids) for w, ids in fresh.items() if len(w) <= 64)
            out = [fresh[w] if ids is None else ids for w, ids in zip(words, out)]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of an id array: one gather from the concatenated token bytes."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not ends.size:
            return np.zeros(0, np.uint8)
        shift = np.repeat(self.first[ids] - (ends - lengths), lengths)
        return self.bytes[shift + np.arange(ends[-1])]


@lru_cache(maxsize=4)
def ranks(path: str) -> Ranks:
    """One instance per worker process and file."""
    return Ranks(path)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum([v.size for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.astype(np.int32)))


def encode(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids array<int>, offsets array<int> (byte offset of
    each pre-token in the UTF-8 text).

    No special tokens.  A null or empty text has no ids.  Repeated rows and null ids give
    one row each; an empty table gives none; other columns are never read.  `rank_file`
    must be readable at the same path on every executor.  One pass, no shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ranks(rank_file)
        for batch in batches:
            for row, end, buf, offs in byte_blocks(batch.column("text")):
                ids, cuts = [], []
                for i, c in encode_block(buf, offs, model.packed):
                    ids.append(i)
                    cuts.append(c)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), _lists(ids), _lists(cuts)],
                    ["doc_id", "ids", "offsets"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, offsets array<int>")


def _decoded(model: Ranks, lists: pa.Array) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """(first row, id lists, their bytes) of consecutive blocks of about a million ids."""
    ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0))) if len(lists) else np.zeros(0)
    row = 0
    while row < len(lists):
        done = ends[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(ends, done + (1 << 20), side="right")))
        part = lists.slice(row, end - row)
        lengths = np.asarray(part.value_lengths().fill_null(0))
        flat = part.flatten().to_numpy()
        cum = np.concatenate([[0], np.cumsum(model.lengths[flat])])
        offs = cum[np.concatenate([[0], np.cumsum(lengths)])]
        data = pa.py_buffer(model.decode(flat).tobytes())
        yield row, part, pa.Array.from_buffers(pa.large_binary(), end - row, [
            None, pa.py_buffer(offs.astype(np.int64).tobytes()), data]).cast(pa.binary())
        row = end


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """`encode`'s rows without offsets, plus decoded binary: the bytes the ids stand for.
    A null id array counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ranks(rank_file)
        for batch in batches:
            for row, part, decoded in _decoded(model, batch.column("ids")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, len(part)), part, decoded], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded: `decode` of `encode` in one pass, so that a task keeps one
    Python worker with one merge table.  Rows as in `encode`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ranks(rank_file)
        for batch in batches:
            for row, end, buf, offs in byte_blocks(batch.column("text")):
                ids = _lists([i for i, _ in encode_block(buf, offs, model.packed)])
                for at, part, decoded in _decoded(model, ids):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(row + at, len(part)), part, decoded], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
