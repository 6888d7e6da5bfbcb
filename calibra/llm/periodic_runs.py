"""Periodic runs of words within documents (operator 13).

A run of period p with at least four periods makes words p apart equal along 3p or more
consecutive places, so it covers a point of the grid 0, 3p, 6p, ...  The harmonic sum of
the grids of all periods is n log n points; at each point with equal words i and i + p the
longest common extension (LCE) to both sides gives the whole run at once.

LCE by a difference cover: the places with (place mod V) in COVER meet for any two places
after the same few steps (fewer than V).  Those words are compared directly; from there on
both places are sampled suffixes.  Only the sampled suffixes are sorted (ranks of V words,
then prefix doubling of the ties), their neighbours' common prefixes fill a sparse table,
and a range minimum gives the rest of the extension.  Extensions to the left are the same
on the reversed words.

Documents are worked on in blocks of whole texts, every step as an array operation over
the block; suffixes are sorted only for documents where an extension gets past the direct
comparison.  No document meets another, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.textblocks import byte_blocks, words_of

#: A difference cover: every residue modulo V is a difference of two members.
V, COVER = 13, (0, 1, 3, 9)
LEAST_WORDS, LEAST_PERIODS = 6, 4
GRID_POINTS = 1 << 20
SCHEMA = ("doc_id long, n_words long, n_runs long, start long, length long, period long, "
          "runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _meeting_steps() -> np.ndarray:
    """[a, b]: least step that takes residues a and b both into the cover."""
    member = np.isin(np.arange(V), COVER)
    a, b, step = np.ogrid[:V, :V, :V]
    return (member[(a + step) % V] & member[(b + step) % V]).argmax(axis=2)


_STEPS = _meeting_steps()


class SampledSuffixes:
    """LCE of sampled places of a word sequence that consists of documents.

    `doc` numbers each word's document, `end` is one past its last word.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray, end: np.ndarray):
        self.end, n = end, words.size
        self.at = np.full(n + V, -1, np.int64)
        member = np.isin(np.arange(n) % V, COVER)
        self.place = np.flatnonzero(member)
        self.at[self.place] = np.arange(self.place.size)
        self._sort(words, doc)
        self._neighbours(words, doc)

    def _sort(self, words: np.ndarray, doc: np.ndarray) -> None:
        place, m = self.place, self.place.size
        stop = self.end[place]
        rank = np.zeros(m, np.int64)
        order, tied = np.arange(m), np.arange(m)

        def refine(keys: tuple[np.ndarray, ...]) -> None:
            """Split the tied groups by keys of order[tied]; a rank is its group's first position."""
            nonlocal tied
            held = order[tied]
            by = np.lexsort((*keys, rank[held]))
            held, keys = held[by], tuple(k[by] for k in keys)
            new = np.ones(held.size, bool)
            new[1:] = rank[held[1:]] != rank[held[:-1]]
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, held.size))
            order[tied] = held
            rank[held] = np.repeat(tied[first], size)
            tied = tied[np.repeat(size > 1, size)]

        refine((words[place], doc[place]))
        for k in range(1, V):
            if not tied.size:
                break
            held = order[tied]
            far = place[held] + k
            inside = far < stop[held]
            refine((np.where(inside, words[np.where(inside, far, 0)], 0), inside))
        self.levels, step = [rank.astype(np.int32)], V
        while tied.size:
            held = order[tied]
            far = place[held] + step
            inside = far < stop[held]
            refine((np.where(inside, rank[self.at[np.where(inside, far, place[0])]], -1),))
            self.levels.append(rank.astype(np.int32))
            step *= 2
        self.rank, self.order = rank, order

    def _neighbours(self, words: np.ndarray, doc: np.ndarray) -> None:
        """Common prefix of each suffix with the next in order, and its sparse table."""
        a, b = self.place[self.order[:-1]], self.place[self.order[1:]]
        same = np.flatnonzero(doc[a] == doc[b])
        a, b = a[same], b[same]
        stop = self.end[a]
        got = np.zeros(a.size, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            x, y = a + got, b + got
            inside = np.maximum(x, y) < stop
            eq = inside & (level[self.at[np.where(inside, x, self.place[0])]] == level[self.at[np.where(inside, y, self.place[0])]])
            got[eq] += V << k
        got += compared(words, a + got, b + got, stop - np.maximum(a, b) - got, np.full(a.size, V))[0]
        self.levels = []
        low = np.zeros(max(self.order.size - 1, 0), np.int32)
        low[same] = got
        self.table, longest = [low], int(np.bincount(doc[self.place]).max()) if self.place.size else 0
        while 2 << (len(self.table) - 1) < longest:
            t, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:-half], t[half:]))

    def lce(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at sampled places x and y (x != y, one document)."""
        a, b = self.rank[self.at[x]], self.rank[self.at[y]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.zeros(x.size, np.int64)
        for k in np.unique(level).tolist():
            q = level == k
            out[q] = np.minimum(self.table[k][lo[q]], self.table[k][hi[q] - (1 << k)])
        return out


def compared(words: np.ndarray, x: np.ndarray, y: np.ndarray, limit: np.ndarray,
             steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal words from x and y on, comparing `steps` (at most V) of them and never more
    than `limit`; and whether all `steps` were equal (the extension may go on)."""
    got = np.zeros(x.size, np.int64)
    live = np.flatnonzero((limit > 0) & (steps > 0))
    for k in range(V):
        live = live[(steps[live] > k) & (limit[live] > k)]
        live = live[words[x[live] + k] == words[y[live] + k]]
        if not live.size:
            break
        got[live] = k + 1
    return got, (got == steps) & (limit > got)


def _extensions(words: np.ndarray, doc: np.ndarray, end: np.ndarray, x: np.ndarray, y: np.ndarray,
                limit: np.ndarray) -> np.ndarray:
    """LCE of x and y (one document, x < y), at most `limit`."""
    steps = _STEPS[x % V, y % V]
    got, on = compared(words, x, y, limit, steps)
    on = np.flatnonzero(on)
    if on.size:
        met_x, met_y = x[on] + steps[on], y[on] + steps[on]
        # sort only the documents in which an extension reached the samples
        need = np.zeros(int(doc[-1]) + 1, bool)
        need[doc[x[on]]] = True
        part = np.flatnonzero(need[doc])
        moved = np.cumsum(need[doc]) - 1
        # documents keep their place modulo V: each is padded to start where it did
        first = np.flatnonzero(np.diff(doc[part], prepend=-1))
        shift = (part[first] - moved[part[first]]) % V
        pad = np.diff(shift, prepend=0) % V
        extra = np.cumsum(pad)[np.cumsum(np.diff(doc[part], prepend=-1) != 0) - 1]
        home = np.zeros(doc.size, np.int64)
        home[part] = moved[part] + extra
        size = int(home[part[-1]]) + 1
        w, d, e = np.zeros(size, words.dtype), np.full(size, -1, np.int64), np.zeros(size, np.int64)
        at = home[part]
        w[at], d[at], e[at] = words[part], doc[part], home[end[part] - 1] + 1
        gap = np.flatnonzero(d < 0)                      # padding: documents of their own
        d[gap], e[gap] = int(doc[-1]) + 1 + np.arange(gap.size), gap + 1
        got[on] += SampledSuffixes(w, d, e).lce(home[met_x - steps[on]] + steps[on], home[met_y - steps[on]] + steps[on])
    return np.minimum(got, limit)


def _grid(words: np.ndarray, offs: np.ndarray, periods: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grid points whose words one period apart are equal."""
    n = np.diff(offs)
    most = np.where(n >= LEAST_WORDS, n // periods, 0)
    doc = np.repeat(np.arange(n.size), most)
    period = np.arange(doc.size) - np.repeat(np.cumsum(most) - most, most) + 1
    step = (periods - 1) * period
    count = (n[doc] - period + step - 1) // step
    upto = np.cumsum(count)
    at = 0
    while at < doc.size:
        done = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + GRID_POINTS, side="right")))
        c, p = count[at:to], period[at:to]
        rep = np.repeat(np.arange(c.size), c)
        i = (np.arange(rep.size) - np.repeat(np.cumsum(c) - c, c)) * step[at:to][rep] + offs[doc[at:to]][rep]
        p = p[rep]
        equal = words[i] == words[i + p]
        yield i[equal], p[equal]
        at = to


def find_runs(words: np.ndarray, offs: np.ndarray, least: int = LEAST_WORDS,
              periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of a block, by start, then period; starts are
    places in the block."""
    size = np.diff(offs)
    doc = np.repeat(np.arange(size.size), size)
    points = list(_grid(words, offs, periods))
    i = np.concatenate([p[0] for p in points]) if points else np.zeros(0, np.int64)
    p = np.concatenate([p[1] for p in points]) if points else np.zeros(0, np.int64)
    if not i.size:
        return i, i, i
    begin, end = offs[:-1][doc], offs[1:][doc]
    right = _extensions(words, doc, end, i, i + p, end[i] - i - p)
    n = words.size
    back = (words[::-1], doc[-1] - doc[::-1], n - begin[::-1])
    inner = np.flatnonzero(i > begin[i])
    left = np.zeros(i.size, np.int64)
    if inner.size:                                       # place n - i: the word before i, reversed
        x, y = n - i[inner] - p[inner], n - i[inner]
        left[inner] = _extensions(*back, x, y, (i - begin[i])[inner])
    start, length = i - left, left + right + p
    run = length >= np.maximum(least, periods * p)
    start, length, p = start[run], length[run], p[run]
    order = np.lexsort((p, length, start))               # multiples of a period give the same stretch
    start, length, p = start[order], length[order], p[order]
    new = np.ones(start.size, bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, p = start[new], length[new], p[new]
    order = np.lexsort((p, start))
    return start[order], length[order], p[order]


def _block(ids: pa.Array, buf: np.ndarray, byte_offs: np.ndarray, least: int, periods: int) -> pa.RecordBatch:
    bounds, words = words_of(buf, byte_offs)
    offs = bounds.offsets
    start, length, period = find_runs(words, offs, least, periods)
    rows = offs.size - 1
    of = np.searchsorted(offs, start, side="right") - 1
    local = start - offs[of]
    n_runs = np.bincount(of, minlength=rows)
    best = np.lexsort((period, local, -length, of))
    best = best[np.flatnonzero(np.diff(of[best], prepend=-1))]
    top = np.full((3, rows), -1, np.int64)
    top[:, of[best]] = local[best], length[best], period[best]
    gone = np.zeros(words.size + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    keep = np.cumsum(gone[:-1]) == 0
    data, collapsed = buf.tobytes(), []
    has = n_runs > 0
    for r in range(rows):
        own = data[byte_offs[r]:byte_offs[r + 1]].split()
        if has[r]:
            own = [own[k] for k in np.flatnonzero(keep[offs[r]:offs[r + 1]]).tolist()]
        collapsed.append(b" ".join(own))
    listed = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(n_runs)]), pa.int32()),
        pa.StructArray.from_arrays([pa.array(local, pa.int64()), pa.array(length, pa.int64()), pa.array(period, pa.int64())],
                                   ["start", "length", "period"]))
    longest = [pa.array(t, pa.int64(), mask=~has) for t in top]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(offs), pa.int64()), pa.array(n_runs, pa.int64()), *longest, listed,
         pa.array(collapsed, pa.binary()).cast(pa.string())],
        ["doc_id", "n_words", "n_runs", "start", "length", "period", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_runs, start, length, period (of the longest
    run; ties: smallest start, then period; null without runs), runs (all, by start, then
    period), collapsed.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0, compared by a 64-bit hash.  A run is a stretch
    of consecutive words with smallest period q, at least `least` words and `periods`
    periods long (three or more), that no neighbouring word extends.  `collapsed` joins by
    one space the words that no run holds after its first period.  Null, empty and short
    texts have no runs and lose nothing; rows are judged one by one, so null ids and
    repeated rows need no rule.  An empty table gives an empty result; other columns are
    never read.  A task holds a block of texts (2 MB, or one longer text) and about forty
    times its words in arrays.
    """
    if periods < 3 or least < 2:
        raise ValueError("periods: three or more, least: two or more")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for row, end, buf, offs in byte_blocks(batch.column("text")):
                yield _block(ids.slice(row, end - row), buf, offs, least, periods)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, SCHEMA)
