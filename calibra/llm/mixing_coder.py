"""Token-id files with an adaptive context-mixing range coder (operator 4).

Ids are cut into blocks that are coded on their own: every block starts with empty
statistics and carries its length, a checksum of its ids and the sorted list of its
distinct ids; an id is coded as its index in that list.  An index is coded as a decision and
two or three digits: first whether it is the one predicted from the last two ids or the last
one, whichever was right more often; if not, its digits of 32 values, highest first.  For
every decision and digit the orders 0, 1 and 2 each give a distribution from adaptive counts
kept under no id, the last id and the last two ids.  The three are mixed with weights that
are learned, for each place of the code and for how often the contexts were seen, from the
part each order had in the probability of what came; the mixed distribution drives a
carry-free range coder.  Decoding repeats the same single-precision sums, products and
quotients on the same tables, element by element, so both sides round alike.

Blocks are independent, so a task codes and decodes up to LANES of them in lockstep, one
numpy operation over all lanes at a time.

Layout of a coded table (a folder of Parquet files, one row per group of documents):
part int, seq int (order of the groups), doc_ids array<long>, lengths array<int>, blocks
array<binary>; a block is "CMR3", its id count, the crc32 of its ids and the number of its
distinct ids as little-endian 32-bit integers, the steps between these (seven bits a byte,
lowest first, the eighth says that more follow) as a raw deflate stream, and the range
coder's bytes.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack, unpack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from calibra.llm.bpe_scan import split_block
from calibra.llm.scratch import saved
from calibra.llm.textblocks import byte_blocks

BLOCK, LANES = 4096, 1792    # at most 4096 distinct ids: a digit of 4 and two of 32
IDS = 1 << 21                 # ids are below this
NONE = (1 << 16) - 1          # no prediction
GUESS_BITS = 11               # predicted ids of an order: 2048 hashed places
WIDE = 32                     # values of a digit
FLAG_ROWS = (50, 256, 256)    # decisions on the prediction: rows of counts of the orders
HIGH_ROWS = (5, 256, 128)     # digits but the last; the rows of orders 1 and 2 are hashed
LAST_ROWS = (128, 512, 128)   # the last digit
COUNTED = 2                   # what an occurrence adds to a count; those of order 0 start with 1
SHARED = 65_000               # sum of the weights: with WIDE codes for sure and rounding below 65536
FLAG_PULL = (0, 0.5, 0.8, 0.8), (0, 0.6, 0.8, 1)          # first weights of orders 1 and 2 where order 0
DIGIT_PULL = (0, 0.07, 0.1, 0.2), (0, 0.07, 0.1, 0.2)     # has 1, by how well their row is known
LEARN = np.float32(1 / 16)    # share of a weight that is learned from a digit
WORDS_KEPT = 150_000          # pre-tokens a worker remembers
TEXT_BYTES = 1 << 20          # texts that are encoded at a time
MAGIC = b"CMR3"
_ONE, _TWO, _NODE = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
_LOW32, _TOP = np.uint64(0xFFFFFFFF), np.uint64(1 << 48)
_16 = np.uint64(16)


@lru_cache(maxsize=1)
def _first_weights() -> tuple[np.ndarray, np.ndarray]:
    """How well a row with a count is known (0 to 3), and the orders' first weights by place
    (flag, then three digits) and knowledge of orders 1 and 2."""
    known = np.searchsorted([1, 2, 4], np.arange(COUNTED * BLOCK + 1) // COUNTED, "right")
    one, two = (known.ravel() for known in np.indices((4, 4)))
    pulls = [np.array([[1.0] * 16, np.array(a)[one], np.array(b)[two]]) for a, b in (FLAG_PULL, *[DIGIT_PULL] * 3)]
    first = np.stack([SHARED * pull / pull.sum(0) for pull in pulls])
    return known, first.transpose(0, 2, 1).astype(np.float32).copy()           # place, knowledge, order


class _Coder:
    """A range coder per lane, of 64 bits, that puts out 16 at a time.  With `data` it
    decodes, otherwise it encodes."""

    def __init__(self, lanes: int, data: list[bytes] | None):
        self.decoding = data is not None
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
        self.at = np.zeros(lanes, np.int64)
        if data is None:
            self.words = np.zeros((lanes, BLOCK), ">u2")
        else:
            width = max(map(len, data)) + 9 & ~1
            self.words = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in data), ">u2").reshape(lanes, -1)
            self.code = np.zeros(lanes, np.uint64)
            for i in range(4):
                self.code = self.code << _16 | self.words[:, i]
            self.at += 4

    def target(self, lanes: np.ndarray) -> np.ndarray:
        """The places of the next symbols, in 65536ths."""
        found = (self.code[lanes] - self.low[lanes]) // (self.range[lanes] >> _16)
        return np.minimum(found, 65535).astype(np.int32)

    def narrow(self, lanes: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """Code symbols that have `size` 65536ths from `first`, or pass them."""
        width = self.range[lanes] >> _16
        low = self.low[lanes] + width * first.astype(np.uint64)
        width *= size.astype(np.uint64)
        settled = (low ^ (low + width)) < _TOP
        todo = (settled | (width <= _LOW32)).nonzero()[0]
        while todo.size:
            own, a, w, at = lanes[todo], low[todo], width[todo], self.at[lanes[todo]]
            w = np.where(settled[todo], w, (~a + np.uint64(1)) & _LOW32)
            if self.decoding:
                self.code[own] = self.code[own] << _16 | self.words[own, np.minimum(at, self.words.shape[1] - 1)]
            else:
                self.words[own, at] = a >> np.uint64(48)
            self.at[own] += 1
            low[todo] = a = a << _16
            width[todo] = w = w << _16
            settled[todo] = same = (a ^ (a + w)) < _TOP
            todo = todo[same | (w <= _LOW32)]
        self.low[lanes], self.range[lanes] = low, width

    def widen(self) -> None:
        """Room for 16 more ids of four symbols, two words each at most."""
        if not self.decoding and self.at.max() + 160 > self.words.shape[1]:
            self.words = np.pad(self.words, ((0, 0), (0, BLOCK)))

    def finish(self) -> list[bytes]:
        last = (self.low + _LOW32) >> np.uint64(32)          # range is at least 2**32
        lanes = np.arange(self.at.size)
        self.words[lanes, self.at] = last >> _16
        self.words[lanes, self.at + 1] = last & np.uint64(0xFFFF)
        return [self.words[i, :n].tobytes() for i, n in enumerate(self.at + 2)]


class _Rows:
    """Rows of running counts of `width` values, of every lane and order."""

    def __init__(self, lanes: int, rows: tuple[int, int, int], width: int):
        own = np.zeros((sum(rows), width), np.uint16)
        own[:rows[0]] = np.arange(1, width + 1)               # order 0: once each
        self.width, self.kind = width, np.dtype((np.void, 2 * width))
        self.counts = np.tile(own, (lanes, 1)).view(self.kind).ravel()
        self.base = np.cumsum([0, *rows[:2]])[:, None] + np.arange(lanes) * sum(rows)
        self.hashed = np.array(rows[1:], np.uint32)[:, None]
        self.steps = (COUNTED * np.triu(np.ones((width, width), np.uint16))).astype(np.uint16).view(self.kind).ravel()
        self.bools = np.uint64 if width % 8 == 0 else np.uint16            # that many at once
        self.codes = np.arange(1, width + 1, dtype=np.int32)

    def cells(self, lanes: np.ndarray, context: np.ndarray, prefix: np.ndarray | int) -> np.ndarray:
        """Rows of a prefix: order 0 has one for each, the others hash it with their context."""
        cells = self.base[:, lanes]
        cells[0] += prefix
        mixed = (context + np.asarray(prefix, np.uint32) * _NODE) * _ONE
        mixed = (mixed ^ (mixed >> np.uint32(16))) * _TWO >> np.uint32(16)
        cells[1:] += mixed * self.hashed >> np.uint32(16)
        return cells


class _Model:
    """Statistics of every lane, and the coding of one id per lane.

    The running shares of the orders' rows, weighted, add up to the code's; a weight moves
    to the part that its order had in the probability of the digit that came."""

    def __init__(self, lanes: int, coder: _Coder, distinct: np.ndarray):
        self.coder, self.steps = coder, 0
        self.long = distinct > WIDE * WIDE
        self.flags = _Rows(lanes, FLAG_ROWS, 2)
        self.high, self.low = _Rows(lanes, HIGH_ROWS, WIDE), _Rows(lanes, LAST_ROWS, WIDE)
        self.known, first = _first_weights()
        self.weights = np.tile(first.ravel(), lanes)
        self.sets = np.arange(lanes) * first.size
        # index * 4 + how sure it is: one more each time it is right, one less when it isn't
        self.guess = np.full((2, lanes << GUESS_BITS), NONE, np.uint16)
        self.last = np.zeros((2, lanes), np.uint32)

    def _digit(self, place: int, lanes: np.ndarray, table: _Rows, cells: np.ndarray,
               digit: np.ndarray | None) -> np.ndarray:
        """Code or read a digit whose rows of orders 0 to 2 are `cells`; learn from it."""
        k, width = lanes.size, table.width
        held = table.counts.take(cells, mode="clip")
        rows = held.view(np.uint16).reshape(3, k, width)
        flat = rows.ravel()
        end = np.arange(0, 3 * k * width, width).reshape(3, k)
        total = flat.take(end + (width - 1), mode="clip")
        own = self.known.take(total[1]) * 4 + self.known.take(total[2])
        own = self.sets[lanes] + (own + 16 * place) * 3 + np.arange(3)[:, None]
        weights = self.weights.take(own, mode="clip")
        share = weights / np.maximum(total, 1).astype(np.float32)
        if digit is None:
            mixed = rows[0] * share[0][:, None]
            mixed += rows[1] * share[1][:, None]
            mixed += rows[2] * share[2][:, None]
            above = mixed.astype(np.int32) + table.codes <= self.coder.target(lanes)[:, None]
            digit = np.minimum(np.bitwise_count(above.view(table.bools)).sum(1, dtype=np.int64), width - 1)
        at = end + digit
        upper = flat.take(at, mode="clip") * share
        lower = flat.take(at - 1, mode="clip") * (share * (digit > 0))
        first = (lower[0] + lower[1] + lower[2]).astype(np.int32) + digit
        last = (upper[0] + upper[1] + upper[2]).astype(np.int32) + digit + 1
        self.coder.narrow(lanes, first, last - first)
        part = upper - lower
        part *= SHARED / (part[0] + part[1] + part[2])
        part -= weights
        part *= LEARN
        weights += part
        self.weights[own] = np.maximum(weights, np.float32(4))
        rows += table.steps.take(digit, mode="clip").view(np.uint16).reshape(k, width)
        table.counts[cells] = held
        return digit

    def step(self, k: int, ids: np.ndarray | None) -> np.ndarray:
        """Code the indexes of lanes 0..k-1, or read and return them."""
        if self.steps % 16 == 0:
            self.coder.widen()
        self.steps += 1
        lanes = np.arange(k)
        one, two = self.last[0, :k], self.last[1, :k]
        context = np.empty((2, k), np.uint32)
        context[0] = (one + np.uint32(1)) * _ONE
        context[1] = (context[0] ^ (context[0] >> np.uint32(15))) * _TWO + (two + np.uint32(1)) * _NODE
        place = ((context ^ (context >> np.uint32(13))) * _TWO) >> np.uint32(32 - GUESS_BITS)
        place = place + (lanes << GUESS_BITS)
        low, high = self.guess[0].take(place[0], mode="clip"), self.guess[1].take(place[1], mode="clip")
        sure_low, sure_high = (low != NONE) * (1 + (low & 3)), (high != NONE) * (1 + (high & 3))
        likely = np.where(sure_high < sure_low, low, high) >> 2
        agree = low >> 2 == high >> 2
        cells = self.flags.cells(lanes, context, 0)
        cells[0] += 25 * agree + 5 * sure_high + sure_low
        hit = self._digit(0, lanes, self.flags, cells, None if ids is None else (ids == likely).astype(np.int64)) == 1
        out = likely.astype(np.uint32)
        rest = np.flatnonzero(~hit)
        if rest.size:
            out[rest] = self._spell(rest, context[:, rest], None if ids is None else ids[rest].astype(np.int64))
        for guess, at, was in zip(self.guess, place, (low, high)):
            sure, right = was & 3, was >> 2 == out
            kept = np.where(right, was + (sure < 3), was - 1)
            guess[at] = np.where(right | ((sure > 0) & (was != NONE)), kept, out << 2)
        self.last[1, :k] = one
        self.last[0, :k] = out
        return out

    def _spell(self, lanes: np.ndarray, context: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
        """The digits of an index, highest first; the first one (0 to 3) only in lanes whose
        list needs it.  Its row of order 0 is 4, those of the next digit are 0 to 3."""
        value = np.zeros(lanes.size, np.int64)
        long = np.flatnonzero(self.long[lanes])
        if long.size:
            cells = self.high.cells(lanes[long], context[:, long], 4)
            value[long] = self._digit(1, lanes[long], self.high, cells, None if ids is None else ids[long] >> 10)
        for place, table, shift in ((2, self.high, 5), (3, self.low, 0)):
            cells = table.cells(lanes, context, value)
            digit = None if ids is None else ids >> shift & (WIDE - 1)
            value = value * WIDE + self._digit(place, lanes, table, cells, digit)
        return value


def _packed_steps(values: np.ndarray) -> bytes:
    """Sorted distinct ids as steps of seven bits a byte, deflated."""
    steps = np.diff(values, prepend=0).astype(np.int64)
    digits = np.stack([steps & 127, steps >> 7 & 127, steps >> 14], 1)
    used = np.arange(3) < 1 + (steps > 127)[:, None] + (steps > 16383)[:, None]
    more = np.roll(used, -1, 1)
    more[:, -1] = False
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    return deflate.compress((digits | more * 128).astype(np.uint8)[used].tobytes()) + deflate.flush()


def _unpacked_steps(data: bytes, count: int) -> tuple[np.ndarray, bytes]:
    """The ids of `_packed_steps` and the bytes after them."""
    inflate = zlib.decompressobj(-15)
    try:
        head = np.frombuffer(inflate.decompress(data, 3 * count + 1), np.uint8).astype(np.int64)
    except zlib.error as error:
        raise ValueError("damaged block") from error
    last = np.flatnonzero(head < 128)
    if not inflate.eof or last.size != count or last[-1] + 1 != head.size:
        raise ValueError("damaged block")
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(head.size) - np.repeat(first, last - first + 1)
    if place.max() > 2:
        raise ValueError("damaged block")
    return np.cumsum(np.add.reduceat((head & 127) << 7 * place, first)), inflate.unused_data


def _parts(blocks: int) -> list[tuple[int, int]]:
    """Even parts of a number of blocks, LANES each at most: few lanes take as many steps."""
    count = -(-blocks // LANES)
    cuts = [blocks * i // max(count, 1) for i in range(count + 1)]
    return list(zip(cuts, cuts[1:]))


def encode_ids(ids: np.ndarray) -> list[bytes]:
    """Coded blocks of an id array (0 <= id < IDS)."""
    if ids.size and (ids.min() < 0 or ids.max() >= IDS):
        raise ValueError("id out of range")
    blocks: list[bytes] = []
    for at, end in _parts(-(-ids.size // BLOCK)):
        part, lanes = ids[at * BLOCK:end * BLOCK], end - at
        sizes = np.minimum(BLOCK, part.size - np.arange(lanes) * BLOCK)
        grid, heads = np.zeros((lanes, BLOCK), np.uint16), []
        distinct = np.zeros(lanes, np.int64)
        for i, size in enumerate(sizes.tolist()):
            own = part[i * BLOCK:i * BLOCK + size]
            values, grid[i, :size] = np.unique(own, return_inverse=True)
            distinct[i] = values.size
            heads.append(MAGIC + pack("<III", size, zlib.crc32(own.astype("<u4").tobytes()), values.size)
                         + _packed_steps(values))
        grid = np.ascontiguousarray(grid.T)
        coder = _Coder(lanes, None)
        model = _Model(lanes, coder, distinct)
        for t in range(sizes[0]):
            k = lanes if t < sizes[-1] else lanes - 1
            model.step(k, grid[t, :k])
        blocks += [head + payload for head, payload in zip(heads, coder.finish())]
    return blocks


def decode_ids(blocks: list[bytes]) -> np.ndarray:
    """Ids of coded blocks, in order; raises on a damaged block."""
    out = [np.zeros(0, np.int32)]
    for at, end in _parts(len(blocks)):
        group = []
        for block in blocks[at:end]:
            if block[:4] != MAGIC or len(block) < 16:
                raise ValueError("not a coded block")
            size, crc, distinct = unpack("<III", block[4:16])
            if not 0 < distinct <= size <= BLOCK:
                raise ValueError("damaged block")
            values, payload = _unpacked_steps(block[16:], distinct)
            group.append((size, crc, values, payload))
        order = sorted(range(len(group)), key=lambda i: -group[i][0])
        sizes = np.array([group[i][0] for i in order])
        model = _Model(len(group), _Coder(len(group), [group[i][3] for i in order]),
                       np.array([group[i][2].size for i in order]))
        grid = np.zeros((int(sizes.max()), len(group)), np.uint16)
        for t in range(grid.shape[0]):
            k = int((sizes > t).sum())
            grid[t, :k] = model.step(k, None)
        read: dict[int, np.ndarray] = {}
        for lane, i in enumerate(order):
            size, crc, values, _ = group[i]
            index = grid[:size, lane]
            if index.max() >= values.size:
                raise ValueError("damaged block")
            read[i] = values[index].astype(np.int32)
            if zlib.crc32(read[i].astype("<u4").tobytes()) != crc:
                raise ValueError("block checksum differs")
        out += [read[i] for i in range(len(group))]
    return np.concatenate(out)


class LibraryIds:
    """Ids as the tokenizers library gives them, without added special tokens.

    The library encodes every distinct pre-token once per worker (byte-level pre-tokens
    are encoded independently of each other); a text that holds a special string goes
    through it as a whole, as it cuts texts there first.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")      # a task has one core
        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.cache: dict[bytes, bytes] = {}

    def packed(self, words: list[bytes]) -> list[bytes]:
        out = list(map(self.cache.get, words))
        if None in out:
            new = list({w for w, ids in zip(words, out) if ids is None})
            coded = self.library.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
            fresh = {w: pack(f"<{len(c)}i", *c.ids) for w, c in zip(new, coded)}
            if len(self.cache) + len(new) > WORDS_KEPT:
                self.cache.clear()
            self.cache.update((w, ids) for w, ids in fresh.items() if len(w) <= 64)
            out = [fresh[w] if ids is None else ids for w, ids in zip(words, out)]
        return out

    def words(self, buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens of a block, which start at `starts`, and how many are
        before each of them.  Those of up to seven bytes are looked up once a block."""
        sizes = np.diff(starts, append=buf.size)
        eight = np.ndarray(buf.size, "<u8", np.append(buf, np.zeros(8, np.uint8)), 0, (1,))     # eight bytes from each
        short = np.flatnonzero(sizes < 8)
        used = sizes[short].astype(np.uint64)
        keys = eight[starts[short]] & ((np.uint64(1) << (np.uint64(8) * used)) - np.uint64(1))
        keys, which = np.unique(keys | used << np.uint64(56), return_inverse=True)
        raw, ends = keys.astype("<u8").tobytes(), (keys >> np.uint64(56)).tolist()
        distinct = [raw[8 * i:8 * i + n] for i, n in enumerate(ends)]
        long = np.flatnonzero(sizes >= 8)
        distinct += [buf[a:a + n].tobytes() for a, n in zip(starts[long].tolist(), sizes[long].tolist())]
        pieces = self.packed(distinct)
        own = np.empty(starts.size, np.int64)
        own[short], own[long] = which, keys.size + np.arange(long.size)
        count = np.array([len(p) >> 2 for p in pieces], np.int64)
        first = np.cumsum(count) - count
        counts = count[own]
        before = np.concatenate([[0], np.cumsum(counts)])
        flat = np.frombuffer(b"".join(pieces), "<i4")
        return flat.take(np.repeat(first[own] - before[:-1], counts) + np.arange(before[-1])), before

    def texts(self, buf: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
        starts, upto = split_block(buf, offs)
        data = buf.tobytes()
        whole = any(s in data for s in self.special)
        ids, before = self.words(buf, starts) if starts.size else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        for a, b, first, last in zip(offs[:-1].tolist(), offs[1:].tolist(), before[upto[:-1]], before[upto[1:]]):
            if whole and any(s in data[a:b] for s in self.special):
                yield np.array(self.library.encode(data[a:b].decode(), add_special_tokens=False).ids, np.int32)
            else:
                yield ids[first:last]


@lru_cache(maxsize=4)
def library_ids(path: str) -> LibraryIds:
    return LibraryIds(path)


def write_coded(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0,
                id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text (null: empty), append `end_id`, and write the ids of all
    documents in ascending id order to a new folder `path` in the layout above.

    Documents are range-partitioned by id and the first 64 characters of the text and
    sorted by id and text, so rows that share an id (null ids come first) may fill many
    partitions; repeated rows are all kept.
    A group holds whole documents of BLOCK * LANES ids at most, or one longer one, so a task holds one group and
    one Arrow batch.  An empty table makes an empty folder.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = library_ids(tokenizer)
        part, seq = TaskContext.get().partitionId(), 0
        names: list = []
        held: list[np.ndarray] = []
        end = np.array([end_id], np.int32)

        def group() -> pa.RecordBatch:
            blocks = encode_ids(np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([names], pa.list_(pa.int64())),
                 pa.array([[h.size for h in held]], pa.list_(pa.int32())), pa.array([blocks], pa.list_(pa.binary()))],
                ["part", "seq", "doc_ids", "lengths", "blocks"])

        total = 0
        for batch in batches:
            for row, stop, buf, offs in byte_blocks(batch.column("text"), TEXT_BYTES):
                ids = batch.column("doc_id").slice(row, stop - row).to_pylist()
                for doc_id, text in zip(ids, model.texts(buf, offs)):
                    if held and total + text.size >= BLOCK * LANES:
                        yield group()
                        names, held, total, seq = [], [], 0, seq + 1
                    names.append(doc_id)
                    held.append(np.concatenate([text, end]))
                    total += held[-1].size
        if held:
            yield group()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    ordered = ordered.select("doc_id", "text")
    ordered.mapInArrow(run, "part int, seq int, doc_ids array<long>, lengths array<int>, blocks array<binary>") \
        .write.parquet(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The coded groups of a folder, with the number of ids before each.  These starts are a
    saved table, so Spark knows its size when it picks the join with the groups."""
    groups = spark.read.schema("part int, seq int, doc_ids array<long>, lengths array<int>, blocks array<binary>") \
        .parquet(path)
    sizes = groups.select("part", "seq", F.aggregate("lengths", F.lit(0).cast("long"),
                                                     lambda a, n: a + n).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))            # one row per written partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", "seq", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("group_start"))
    starts = sizes.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("group_start")).alias("base"))
    return groups.join(saved(starts, "group-starts"), ["part", "seq"]).select("base", "doc_ids", "lengths", "blocks")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each group, decoded."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            ids = decode_ids(row["blocks"].as_py())
            lengths = row["lengths"].values.to_numpy().astype(np.int64)
            ends = np.cumsum(lengths)
            cuts = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [row["doc_ids"].values, pa.array(row["base"].as_py() + ends - lengths), pa.array(lengths),
                 pa.ListArray.from_arrays(cuts, pa.array(ids))], ["doc_id", "start", "n_tokens", "ids"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the crc32 of their ids instead of these."""
    for batch in batches:
        ids = batch.column("ids")
        flat = ids.flatten().to_numpy().astype("<u4", copy=False)
        ends = np.cumsum(np.asarray(ids.value_lengths().fill_null(0)))
        first = np.concatenate([[0], ends])
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(first, ends)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_coded(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a coded folder: doc_id, start (ids of all documents before
    it), n_tokens, ids array<int>.  Damaged blocks raise."""
    return _placed(spark, path).mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids array<int>")


def ids_crc32(coded: DataFrame) -> DataFrame:
    """`read_coded`'s rows without ids, plus ids_crc32: unsigned crc32 of the ids as
    little-endian unsigned 32-bit integers."""
    return coded.mapInArrow(_summed, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    """`ids_crc32` of `read_coded` in one pass, so that a task keeps one Python worker and
    no ids go back and forth between it and Spark."""
    return _placed(spark, path).mapInArrow(lambda batches: _summed(_documents(batches)),
                                           "doc_id long, start long, n_tokens long, ids_crc32 long")
