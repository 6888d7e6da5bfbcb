"""Suffix-array deduplication with the difference-cover algorithm (operator 6).

Which 100-byte strings occur twice is read off sorted arrays of suffixes:

0. Sieve.  Of the grams of GRAM bytes in a window, the one with the smallest hash (the first
   of equal ones) is the window's gram; equal windows have equal grams.  Neighbouring windows
   that share one place of it are a piece.  Only pieces whose gram occurs twice in the table
   go on, dealt by gram, so that equal windows meet, whatever text is around them.
1. Sort the sampled triples: a position has a symbol, the SYMBOL bytes that start there;
   the symbol after it is SYMBOL bytes further on.  Triples of symbols that start at
   positions whose number of symbols before isn't divisible by three are sorted and named.
2. Recurse on the names, whose steps reach three times as far, until a name covers a window
   (what follows may be in any order) or no two are equal.
3. Merge the remaining suffixes: any two suffixes have a shift below three at which both
   are sampled, so the ranks at that shift order those whose first symbols agree.
4. Compare adjacent prefixes: neighbours in suffix order whose first W bytes agree are one
   group.  Its earliest start stays; the windows at all its other starts are removed.

A chunk of documents sends a piece once, however often it holds it, so a passage of a third
of all documents is one row per chunk.  Pieces are sorted in packed arrays, some GROUP bytes
at a time, grams kept whole.  A gram with more than HOT different pieces is cut: its pieces
go as single windows, dealt to slices by their hash.

Scale: one shuffle of the texts, used by all passes; 8 bytes for a gram (about one in 25
bytes of text), the pieces that may repeat (about a byte for a byte of text where a sixth of
it is repeated), and the starts that go, as ranges.  All tables are parts of one plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.anchors import LEAST_CHUNKS, _by_bucket, _joined, _slice_bytes, _table, chunked
from calibra.llm.textblocks import byte_blocks, column_bytes, mix, rolling, window_starts

SYMBOL = 8
#: Different pieces of one gram from which it is cut, and windows of a slice.
HOT, SLICE = 8_000, 8_000
#: Bytes of pieces that are sorted at a time (more if the pieces of one gram need it).
GROUP = 1 << 19
#: Bins of pieces for a bucket of grams (32 MB of text).
BINS = 32
#: Hashes of different pieces of a gram that a chunk sends; the number of all is estimated
#: from the smallest ones (it decides on cuts only).
SKETCH = 256
_CODE, _GRAM = mix(np.arange(1, 257, dtype=np.uint64)), np.uint64(0xA24BAED4963EE407)

_GRAM_SCHEMA = "bucket int, chunk long, grams binary, pieces binary"
_HIT_SCHEMA = "chunk long, bucket int, grams binary, parts binary"
_PIECE = pa.schema([("gram", pa.int64()), ("parts", pa.int32()), ("data", pa.binary()), ("doc_id", pa.int64()),
                    ("text_hash", pa.int64()), ("start", pa.int64()), ("chunk", pa.int64()), ("at", pa.int64()),
                    ("copies", pa.binary())])
_PIECE_SCHEMA = ("gram long, parts int, data binary, doc_id long, text_hash long, start long, chunk long, "
                 "at long, copies binary")
_LATER_SCHEMA = "chunk long, firsts binary, counts binary"
_SPAN = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def _once(docs: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Documents in order of id (null first) and hash, rows that repeat both only once; and
    each row's place among them."""
    order = pc.sort_indices(docs.select(["doc_id", "text_hash"]),
                            sort_keys=[("doc_id", "ascending"), ("text_hash", "ascending")],
                            null_placement="at_start").to_numpy()
    ids = docs["doc_id"].take(pa.array(order))
    null, ids = ids.is_null().to_numpy(), ids.fill_null(0).to_numpy()
    texts = docs["text_hash"].to_numpy()[order]
    new = np.ones(order.size, bool)
    new[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1]) | (texts[1:] != texts[:-1])
    place = np.empty(order.size, np.int64)
    place[order] = np.cumsum(new) - 1
    return docs.take(pa.array(order[new])), place


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each count n."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _runs(buf: np.ndarray, offs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, last start, hash of the gram) of the pieces of a block of rows."""
    block = (window + 1) // 2
    starts, rows = window_starts(offs, window)
    if not starts.size:
        return rows, starts, starts, np.zeros(0, np.uint64)
    hashes = rolling(_CODE[buf], block)
    least = hashes & ~np.uint64(0xFFFFFFFF) | np.arange(hashes.size, dtype=np.uint64)
    width, all_ = 1, window - block + 1
    while width < all_:                        # least of `width` hashes from each place on
        step = min(width, all_ - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    place = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(starts.size, bool)
    new[1:] = (place[1:] != place[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], starts.size) - 1
    return rows[first], starts[first], starts[last], mix(hashes[place[first]] ^ _GRAM)


def _grams(docs: pa.Table, window: int, bits: int) -> pa.Table:
    """A chunk's distinct (gram, hash of the piece), twice where they occur twice; of a gram
    with more than SKETCH pieces at least those of the SKETCH smallest hashes."""
    out: tuple[list, ...] = ([], [], [], [])
    short, pieces = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for _, _, buf, offs in byte_blocks(_once(docs)[0]["text"]):
        _, first, last, gram = _runs(buf, offs, window)
        short.append(gram >> np.uint64(32 - bits))
        ends = rolling(_CODE[buf], window)     # a piece is its first and its last window
        pieces.append(mix(ends[first] + mix(ends[last] + np.uint64(1))) >> np.uint64(32))
    short, pieces = np.concatenate(short), np.concatenate(pieces)
    order = np.lexsort((pieces, short))
    short, pieces = short[order], pieces[order]
    third = np.zeros(short.size, bool)
    third[2:] = (short[2:] == short[:-2]) & (pieces[2:] == pieces[:-2])
    short, pieces = short[~third], pieces[~third].astype(np.uint32)
    most = np.zeros(short.size, bool)          # two rows a piece at most: SKETCH different ones are left
    most[2 * SKETCH:] = short[2 * SKETCH:] == short[:-2 * SKETCH]
    short, pieces = short[~most], pieces[~most]
    bucket, rest = (short >> np.uint64(32)).astype(np.int64), short.astype(np.uint32)
    chunk = docs["chunk"][0].as_py()
    for b, part in _by_bucket(bucket, 1 << bits):
        out[0].append(b)
        out[1].append(chunk)
        out[2].append(_slice_bytes(rest[part]))
        out[3].append(pieces[part].tobytes())
    return _table({"bucket": (out[0], pa.int32()), "chunk": (out[1], pa.int64()),
                   "grams": (out[2], pa.binary()), "pieces": (out[3], pa.binary())})


def _hits(sent: pa.Table, window: int, hot: int, size: int) -> pa.Table:
    """A bucket's grams that occur twice, for each chunk that sent them, with the number of
    slices for their windows (1: the gram isn't cut)."""
    chunks, bucket = sent["chunk"].to_pylist(), sent["bucket"][0].as_py()
    grams = [_joined(g, np.uint32) for g in sent["grams"].to_pylist()]
    sender = np.repeat(np.arange(len(grams)), [g.size for g in grams])
    gram = np.concatenate(grams)
    piece = np.concatenate([np.frombuffer(p, np.uint32) for p in sent["pieces"].to_pylist()])
    order = np.argsort(gram.astype(np.uint64) << np.uint64(32) | piece, kind="stable")
    gram, piece, sender = gram[order], piece[order], sender[order]
    new = np.ones(gram.size, bool)
    new[1:] = gram[1:] != gram[:-1]
    other = new.copy()
    other[1:] |= piece[1:] != piece[:-1]
    first = np.flatnonzero(new)
    count, different = np.diff(np.append(first, gram.size)), np.add.reduceat(other, first, dtype=np.int64)
    full = np.flatnonzero(different >= SKETCH)                 # their number from the SKETCH-th smallest hash
    at = np.flatnonzero(other)[(np.cumsum(different) - different)[full] + SKETCH - 1]
    different[full] = np.maximum(SKETCH, (SKETCH - 1) * 2.0 ** 32 / (piece[at] + 1.0))
    windows = different * (window - (window + 1) // 2 + 1)
    parts = np.repeat(np.where(different > hot, -(-windows // size), 1), count)
    hit = np.repeat(count > 1, count)
    gram, sender, parts = gram[hit], sender[hit], parts[hit]
    order = np.lexsort((gram, sender))
    gram, sender, parts = gram[order], sender[order], parts[order]
    new = np.ones(gram.size, bool)
    new[1:] = (gram[1:] != gram[:-1]) | (sender[1:] != sender[:-1])
    gram, sender, parts = gram[new], sender[new], parts[new].astype(np.int32)
    out: tuple[list, ...] = ([], [], [], [])
    for s, part in _by_bucket(sender, len(chunks)):
        out[0].append(chunks[s])
        out[1].append(bucket)
        out[2].append(_slice_bytes(gram[part]))
        out[3].append(parts[part].tobytes())
    return _table({"chunk": (out[0], pa.int64()), "bucket": (out[1], pa.int32()),
                   "grams": (out[2], pa.binary()), "parts": (out[3], pa.binary())})


def _pieces(docs: pa.Table, hits: pa.Table, window: int, bits: int) -> pa.Table:
    """A chunk's different pieces whose gram occurs twice: the earliest place of each, and
    where else the chunk holds it (`at`, `copies`: bytes from the start of the chunk)."""
    if not docs.num_rows or not hits.num_rows:
        return _PIECE.empty_table()
    chunk = docs["chunk"][0].as_py()
    docs, _ = _once(docs)
    sent = sorted(zip(hits["bucket"].to_pylist(), hits["grams"].to_pylist(), hits["parts"].to_pylist()))
    known = np.concatenate([_joined(g, np.uint32).astype(np.uint64) | np.uint64(b << 32) for b, g, _ in sent])
    known_parts = np.concatenate([np.frombuffer(p, np.int32) for _, _, p in sent])
    found: list[tuple] = []
    base = 0
    for top, _, buf, offs in byte_blocks(docs["text"]):
        row, first, last, gram = _runs(buf, offs, window)
        gram >>= np.uint64(32 - bits)
        place = np.minimum(np.searchsorted(known, gram), known.size - 1)
        hit = known[place] == gram
        found.append((row[hit] + top, first[hit] + base, last[hit] + base, gram[hit].astype(np.int64),
                      known_parts[place[hit]]))
        base += buf.size
    row, first, last, gram, parts = (np.concatenate(c) for c in zip(*found))
    n = np.where(parts > 1, last - first + 1, 1)               # a cut gram: every window alone
    first = np.repeat(first, n) + _ranges(n)
    last = np.where(np.repeat(parts, n) > 1, first, np.repeat(last, n))
    row, gram, parts = (np.repeat(c, n) for c in (row, gram, parts))
    buf, offs = column_bytes(docs["text"])
    buf, offs = buf[offs[0]:offs[-1]].tobytes(), offs - offs[0]
    start = first - offs[row]
    ids, texts = docs["doc_id"], docs["text_hash"].to_numpy()
    null, ids = ids.is_null().to_numpy(), ids.fill_null(0).to_numpy()
    order = np.lexsort((row, start, ids[row], ~null[row]))
    places: dict[bytes, list[int]] = {}
    for i, a, b in zip(order.tolist(), first[order].tolist(), (last[order] + window).tolist()):
        places.setdefault(buf[a:b], []).append(i)
    own = np.array([p[0] for p in places.values()], np.int64)
    copies = [first[p[1:]].tobytes() if len(p) > 1 else None for p in places.values()]
    columns = [gram[own], parts[own], list(places), pa.array(ids[row[own]], mask=null[row[own]]), texts[row[own]],
               start[own], np.full(own.size, chunk), first[own], copies]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE)], schema=_PIECE)


def _slices(distinct: DataFrame, parts: str, keys: list[str]) -> DataFrame:
    """`distinct` with `slice`: for a key that is cut into more than one of `parts`, the
    part of the row, by its bytes; 0 for other keys."""
    return distinct.withColumn("slice", F.when(F.col(parts) > 1, F.pmod(F.xxhash64(*keys, "data"), F.col(parts).cast("long")))
                               .otherwise(F.lit(0).cast("long")))


def _packed(columns: list[np.ndarray]) -> np.ndarray:
    """One number per row that orders rows as their columns (of numbers from 0) do."""
    bits = [max(1, int(c.max(initial=0)).bit_length()) for c in columns]
    key = columns[0].astype(np.uint64)
    used = bits[0]
    for column, more in zip(columns[1:], bits[1:]):
        if used + more > 64:
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
            used = max(1, int(key.max(initial=0)).bit_length())
        key = key << np.uint64(more) | column.astype(np.uint64)
        used += more
    return key


def _named(keys: np.ndarray) -> np.ndarray:
    """Names of keys: their rank among the different ones, from 1."""
    order = np.argsort(keys)
    ascending = keys[order]
    new = np.ones(keys.size, np.int64)
    new[1:] = ascending[1:] != ascending[:-1]
    out = np.empty(keys.size, np.int64)
    out[order] = np.cumsum(new)
    return out


def _suffix_ranks(at: np.ndarray, names: np.ndarray, step: int, window: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Ranks (from 1, 0 elsewhere) of the suffixes that start at `at`, those `wanted` if given.

    names: for each position of the text and one past it, the name of `step` bytes, 0 past
    the text.  Suffixes that agree in `window` bytes may be in any order."""
    end = names.size - 1

    def after(values: np.ndarray, at: np.ndarray, shift: int) -> np.ndarray:
        return values[np.minimum(at + shift * step, end)]
    remainder = at // step % 3
    sampled, rest = at[remainder > 0], at[remainder == 0]
    ranks = np.zeros(end + 1, np.int64)
    ranks[sampled] = _named(_packed([names[sampled], after(names, sampled, 1), after(names, sampled, 2)]))
    if 3 * step < window and ranks.max() < sampled.size:
        ranks = _suffix_ranks(sampled, ranks, 3 * step, window)
    if wanted is not None:
        sampled, rest = sampled[wanted[sampled]], rest[wanted[rest]]
    sampled = sampled[np.argsort(ranks[sampled])]
    rest = rest[np.argsort(_packed([names[rest], after(ranks, rest, 1)]))]
    before = np.zeros(sampled.size, np.int64)                  # how many of the rest are smaller
    for shift in (1, 2):                                       # at which both are sampled
        own = sampled // step % 3 == shift
        both = np.concatenate([rest, sampled[own]])
        key = _packed([*(after(names, both, i) for i in range(shift)), after(ranks, both, shift)])
        before[own] = np.searchsorted(key[:rest.size], key[rest.size:])
    out = np.zeros(end + 1, np.int64)
    place = np.arange(sampled.size) + np.maximum.accumulate(before)
    out[sampled] = place + 1
    free = np.ones(sampled.size + rest.size, bool)
    free[place] = False
    out[rest] = np.flatnonzero(free) + 1
    return out


def _window_groups(data: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """For each start of a window in `data`: the number of its group of equal windows."""
    symbols = np.zeros(data.size + 1, np.uint64)
    padded = np.concatenate([data, np.zeros(SYMBOL, np.uint8)])
    for i in range(SYMBOL):
        symbols[:-1] = symbols[:-1] << np.uint64(8) | padded[i:i + data.size]
    names = np.zeros(data.size + 1, np.int64)
    names[:-1] = _named(symbols[:-1])
    wanted = np.zeros(data.size + 1, bool)
    wanted[starts] = True
    ranks = _suffix_ranks(np.arange(data.size), names, SYMBOL, window, wanted)[starts]
    order = np.empty(starts.size, np.int64)
    order[ranks - 1] = np.arange(starts.size)
    ordered = starts[order]
    symbols >>= np.uint64(8 * max(0, SYMBOL - window))
    same = np.flatnonzero(symbols[ordered[1:]] == symbols[ordered[:-1]]) + 1
    for shift in (*range(SYMBOL, window - SYMBOL, SYMBOL), max(0, window - SYMBOL)):
        same = same[symbols[ordered[same] + shift] == symbols[ordered[same - 1] + shift]]
    new = np.ones(starts.size, np.int64)
    new[same] = 0
    out = np.empty(starts.size, np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _later(sent: pa.Table, window: int) -> pa.Table:
    """Ranges of starts of windows that also start earlier, by chunk; sent: all pieces of
    some grams (or slices of them)."""
    sent = sent.take(pc.sort_indices(sent["gram"]))
    gram, chunk, at, start, texts = (sent[c].to_numpy() for c in ("gram", "chunk", "at", "start", "text_hash"))
    null = sent["doc_id"].is_null().to_numpy()
    ids = np.unique(sent["doc_id"].fill_null(0).to_numpy(), return_inverse=True)[1] + 1
    ids[null] = 0
    data, copies = sent["data"].to_pylist(), sent["copies"].to_pylist()
    n = np.array([len(d) for d in data], np.int64) - window + 1
    edges = np.append(np.flatnonzero(np.diff(gram, prepend=gram[0] - 1)), gram.size)
    total = np.concatenate([[0], np.cumsum(n + window - 1)])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low = 0
    while low < gram.size:
        cut = edges[np.searchsorted(total[edges], total[low] + GROUP, side="right") - 1]
        high = int(cut) if cut > low else int(edges[np.searchsorted(edges, low, side="right")])
        texts_of: dict[bytes, int] = {}
        which = np.array([texts_of.setdefault(d, len(texts_of)) for d in data[low:high]], np.int64)
        sizes = np.array([len(d) for d in texts_of], np.int64)
        first = np.cumsum(sizes) - sizes
        windows = sizes - window + 1
        starts = np.repeat(first, windows) + _ranges(windows)
        group = _window_groups(np.frombuffer(b"".join(texts_of), np.uint8), starts, window)
        row = np.repeat(np.arange(low, high), n[low:high])     # one entry per window of each piece
        inside = _ranges(n[low:high])
        own = group[(np.cumsum(windows) - windows)[which[row - low]] + inside]
        earliest = np.ones(row.size, bool)
        for place in (ids[row], start[row] + inside, texts[row]):
            entry = np.flatnonzero(earliest)
            least = np.full(group.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, own[entry], place[entry])
            earliest[entry] = place[entry] == least[own[entry]]
        row, inside = row[~earliest], inside[~earliest]
        new = np.ones(row.size, bool)
        new[1:] = (row[1:] != row[:-1]) | (inside[1:] != inside[:-1] + 1)
        a = np.flatnonzero(new)
        b = np.append(a[1:], row.size)[:a.size] - 1
        found.append((chunk[row[a]], at[row[a]] + inside[a], at[row[a]] + inside[b] + 1))
        low = high
    held = [i for i, c in enumerate(copies) if c is not None]
    for i in held:                                             # the chunk's own later copies
        more = np.frombuffer(copies[i], np.int64)
        found.append((np.full(more.size, chunk[i]), more, more + n[i]))
    chunks, first, end = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((first, chunks))
    chunks, first, end = chunks[order], first[order], end[order]
    out: tuple[list, ...] = ([], [], [])
    edges = np.flatnonzero(np.diff(chunks, prepend=-1, append=-1)) if chunks.size else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        out[0].append(int(chunks[a]))
        out[1].append(_slice_bytes(first[a:b]))
        out[2].append((end[a:b] - first[a:b]).astype(np.int32).tobytes())
    return _table({"chunk": (out[0], pa.int64()), "firsts": (out[1], pa.binary()), "counts": (out[2], pa.binary())})


def _cut(docs: pa.Table, later: pa.Table, window: int) -> pa.Table:
    """A chunk's rows without the bytes of windows that start earlier."""
    out: tuple[list, ...] = ([], [], [], [], [])
    if docs.num_rows:
        once, place = _once(docs)
        buf, offs = column_bytes(once["text"])
        buf, offs = buf[offs[0]:offs[-1]].tobytes(), offs - offs[0]
        cover = np.zeros(len(buf) + 1, np.int32)
        for firsts, counts in zip(later["firsts"].to_pylist(), later["counts"].to_pylist()):
            first = _joined(firsts, np.int64)
            np.add.at(cover, first, 1)
            np.add.at(cover, first + np.frombuffer(counts, np.int32) + window - 1, -1)
        gone = np.cumsum(cover[:-1]) > 0
        results = []
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
            own = gone[a:b]
            edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist() if own.any() else []
            bounds = [0, *edge, b - a]
            kept = b"".join(buf[a + x:a + y] for x, y in zip(bounds[::2], bounds[1::2]))
            results.append((b - a, b - a - len(kept), len(edge) // 2, kept,
                            [{"first": x, "end": y} for x, y in zip(edge[::2], edge[1::2])]))
        out = tuple(list(c) for c in zip(*(results[p] for p in place.tolist())))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), _SPAN]
    ids = docs["doc_id"].combine_chunks() if docs.num_rows else pa.array([], pa.int64())
    return pa.Table.from_arrays([ids, *(pa.array(c, k) for c, k in zip(out, kinds))],
                                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed"])


def remove_later_copies(docs: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept binary (the bytes left), removed array<struct<first, end>> (byte spans that went).

    A byte of the UTF-8 text goes when it is covered by a `window`-byte string that also
    starts earlier: in a smaller id (null is smallest), or before in the same document;
    overlapping places count.  Null counts as empty; texts shorter than the window keep
    everything.  Rows that repeat both id and text are one document and get the same
    result; rows that share only the id are told apart by their text's hash.  An empty
    table gives an empty result; other columns are never read.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt, bits = chunked(texts, "doc_id", "text")
    dealt = dealt.withColumn("text_hash", F.xxhash64("text"))
    hot, size = HOT, SLICE
    grams = dealt.groupBy("chunk").applyInArrow(lambda t: _grams(t, window, bits), _GRAM_SCHEMA)
    hits = grams.groupBy("bucket").applyInArrow(lambda t: _hits(t, window, hot, size), _HIT_SCHEMA)
    pieces = dealt.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(
        lambda d, h: _pieces(d, h, window, bits), _PIECE_SCHEMA)
    bins = max(LEAST_CHUNKS, BINS << bits)
    dealt_pieces = _slices(pieces, "parts", ["gram"]).withColumn(
        "bin", F.pmod(F.xxhash64("gram", "slice"), F.lit(bins).cast("long"))).drop("parts", "slice")
    later = dealt_pieces.groupBy("bin").applyInArrow(lambda t: _later(t, window), _LATER_SCHEMA)
    return dealt.groupBy("chunk").cogroup(later.groupBy("chunk")).applyInArrow(
        lambda d, l: _cut(d, l, window),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<first: int, end: int>>")
