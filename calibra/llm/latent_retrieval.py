"""Benchmark decontamination by latent semantic retrieval (operator 1).

1. Terms: the words of the benchmark (A-Z as a-z, outer punctuation removed).  One pass
   over all texts counts in how many passages of 32 words each term occurs (idf).
2. Distributed randomised SVD: with A the TF-IDF matrix of all passages and W a random
   test matrix, tasks add up A'(A W); the sums have a fixed size.  The leading right
   singular vectors of A follow from them (Nystrom's formula).  The benchmark's own
   directions are put before them, so that a passage that occurs once in the corpus is
   seen as well as one that occurs everywhere.  Queries are dealt into groups, each with a
   latent space over its own terms that has a direction for every query: however large
   the benchmark is, all of a query's weight is in its space.
3. Candidate search: every text is read in windows (24 words at steps of 8 for short
   items, 48 at steps of 16 for longer ones), each window is folded into the latent space
   and compared with the items by cosine; it must also hold a least share (COVER) of the
   item's own length there, which a window with two or three of its terms doesn't.  An item
   longer than a window is searched in segments, each a query of its own; a hit of any
   segment makes the item a candidate.  Items of one word have groups of their own, where
   the word alone makes a candidate: a cosine says nothing of one word among others.  A text
   is taken in runs of windows, so latent rows need the same memory however long it is.
4. Checks: a candidate counts if the longest common subsequence of the item's words and
   the window (for an item in segments, a region as long as the item around the aligned
   place; with a margin) covers enough of the item; a weak match also needs enough of
   the item's answer, its last quarter, while a larger share counts without it, whichever
   part of the item is cut.

Every window of every text is compared with every group; nothing is sampled or capped.
The benchmark is taken in blocks of a few groups, searched in one pass, whose matches are
saved before the next block, so what the driver holds and tasks receive is bounded.  The
only shuffles are the fixed-size sums; matches are made where the text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm import array_sums
from calibra.llm.scratch import saved
from calibra.llm.textblocks import byte_blocks, hash_spans, word_bounds

PASSAGE, STEP = 32, 8
#: (words in a window, step between windows, longest item) of each window kind.
WINDOWS = ((24, 8, 28), (48, 16, None))
SEGMENT = 32            # words; at any place one of the 48-word windows holds all of it
CORPUS_DIRECTIONS, OVERSAMPLE = 64, 16
COMMON = 0.005          # terms in more passages than this share, and EVIDENCE more, carry no weight ...
EVIDENCE = 50           # (so few passages don't show that a term is common)
RAREST = 5              # ... but each query keeps its rarest ones
GROUP = 192             # queries (and their directions) of one latent space
QUERIES_PER_BLOCK = 10 * GROUP
RUN = 4096              # rows of STEP words that are in latent form at a time
COSINE, COVER, LCS, ANSWER, STRONG = 0.45, 0.3, 0.6, 0.5, 0.7
_OUTER = np.isin(np.arange(256), list(b".,;:!?\"'()[]{}|*#$%&-_"))


def term_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word without outer punctuation, word offsets of the texts)."""
    w = word_bounds(buf, offs)
    if not w.starts.size:
        return np.zeros(0, np.uint64), w.offsets
    a, b = w.starts.copy(), w.ends.copy()
    for _ in range(3):
        b -= (b - a > 1) & _OUTER[buf[b - 1]]
    for _ in range(2):
        a += (b - a > 1) & _OUTER[buf[a]]
    return hash_spans(buf, a, b, fold=True), w.offsets


def lcs_length(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Longest common subsequence of a text of n words, given as word -> positions mask,
    and `words` (bit-parallel)."""
    full = (1 << n) - 1
    row = full
    for w in words:
        both = row & masks.get(w, 0)
        row = ((row + both) | (row - both)) & full
    return n - row.bit_count()


def position_masks(words: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


class Item:
    def __init__(self, item_id: int, words: list[int]):
        self.item_id, self.words = item_id, words
        self.answer = words[-max(1, len(words) // 4):]
        self.masks, self.answer_masks = position_masks(words), position_masks(self.answer)
        n = len(words)
        parts = 1 if n <= WINDOWS[-1][0] else -(-n // SEGMENT)
        self.cuts = [n * i // parts for i in range(parts + 1)]

    def regions(self, places: list[tuple[int, float]], size: int) -> Iterator[tuple[int, int, float]]:
        """(first word, end word, cosine) to check for hits (word at which the item would
        begin, cosine).  Hits of an item in segments that are near each other see the same
        copy and are checked together."""
        n = len(self.words)
        margin = max(4, n // 4)
        whole = len(self.cuts) == 2
        reach, near = (size, 0) if whole else (n + size - SEGMENT, margin)
        places.sort()
        at = 0
        while at < len(places):
            end = at
            while end < len(places) and places[end][0] - places[at][0] <= near:
                end += 1
            yield places[at][0] - margin, places[end - 1][0] + reach + margin, max(c for _, c in places[at:end])
            at = end

    def checked(self, region: list[int]) -> tuple[float, float]:
        """Shares of the item and of its answer that the region holds in order."""
        n, m = len(self.words), len(self.answer)
        return lcs_length(self.masks, n, region) / n, lcs_length(self.answer_masks, m, region) / m


class Group:
    """Latent space of some queries of one window kind: (item number, its first word,
    numbers of its terms) each."""

    def __init__(self, size: int, step: int, queries: list[tuple], idf: np.ndarray, corpus: np.ndarray,
                 single: bool):
        self.size, self.step = size, step
        #: weighted words and cosine that a window needs
        self.held, self.cosine = (1, 0.0) if single else (2, COSINE)
        self.places = [(k, a) for k, a, _ in queries]
        terms = np.unique(np.concatenate([t for _, _, t in queries]))
        self.terms = terms[idf[terms] > 0]
        rows = np.zeros((len(queries), self.terms.size))
        for r, (_, _, own) in enumerate(queries):
            own = own[idf[own] > 0]
            np.add.at(rows[r], np.searchsorted(self.terms, own), idf[own])
        _, s, own = np.linalg.svd(rows, full_matrices=False)
        own = own[s > 1e-9 * max(s.max(initial=0), 1e-300)].T
        corpus = corpus[self.terms]
        corpus = corpus - own @ (own.T @ corpus)
        left, s, _ = np.linalg.svd(corpus, full_matrices=False)
        basis = np.concatenate([own, left[:, s > 1e-6]], 1)
        folded = rows @ basis
        self.basis = np.ascontiguousarray(basis * idf[self.terms, None], np.float32)
        self.length = np.linalg.norm(folded, axis=1).astype(np.float32)
        self.folded = (folded / np.where(self.length > 0, self.length, 1)[:, None]).astype(np.float32)


class Latent:
    """Vocabulary, idf and groups of one block of items."""

    def __init__(self, items: list[Item]):
        self.items = items
        #: (item number, its first word, words) of every segment
        self.queries = [(k, a, np.array(i.words[a:b], np.uint64))
                        for k, i in enumerate(items) for a, b in zip(i.cuts, i.cuts[1:])]
        self.terms = np.unique(np.array([w for i in items for w in i.words], np.uint64))
        self.idf = np.zeros(self.terms.size)
        self.groups: list[Group] = []

    def locate(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 outside the vocabulary."""
        if not self.terms.size:
            return np.full(hashes.size, -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), self.terms.size - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def weigh(self, seen: np.ndarray, passages: int) -> None:
        idf = np.log((passages + 1) / (seen + 1)) + 1e-3
        keep = seen <= COMMON * passages + EVIDENCE
        for _, _, words in self.queries:
            own = np.unique(self.locate(words))
            keep[own[np.argsort(seen[own], kind="stable")][:RAREST]] = True
        self.idf = np.where(keep, idf, 0.0)

    def entries(self, hashes: np.ndarray, offsets: np.ndarray, size: int):
        """(row, term) of every weighted word, rows being runs of `size` words within a
        text, and the first row of each text."""
        counts = -(-np.diff(offsets) // size)
        first = np.concatenate([[0], np.cumsum(counts)])
        term = self.locate(hashes)
        text = np.repeat(np.arange(counts.size), np.diff(offsets))
        row = first[text] + (np.arange(hashes.size) - offsets[:-1][text]) // size
        used = np.flatnonzero(term >= 0)
        used = used[self.idf[term[used]] > 0]
        return row[used], term[used], first

    def settle(self, sketch: np.ndarray, test: np.ndarray) -> None:
        """Groups from the corpus sketch A'(A test)."""
        inner = test.T @ sketch
        value, vector = np.linalg.eigh((inner + inner.T) / 2)
        good = value > 1e-9 * max(value.max(initial=0), 1e-300)
        root = sketch @ (vector[:, good] / np.sqrt(value[good]))
        corpus = np.linalg.svd(root, full_matrices=False)[0][:, :CORPUS_DIRECTIONS] if good.any() else root
        shortest = 0
        for size, step, longest in WINDOWS:
            chosen = [(k, a, self.locate(words)) for k, a, words in self.queries
                      if shortest < len(self.items[k].words) <= (longest or len(self.items[k].words))]
            shortest = longest
            for single in (True, False):
                mine = [q for q in chosen if (len(self.items[q[0]].words) == 1) == single]
                n = -(-len(mine) // GROUP)
                for i in range(n):
                    part = mine[len(mine) * i // n:len(mine) * (i + 1) // n]
                    self.groups.append(Group(size, step, part, self.idf, corpus, single))

    def _near(self, group: Group, at: np.ndarray, end: np.ndarray, row: np.ndarray,
              term: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(first row, query number, cosine) of the windows of rows [at, end) that are near a
        query of the group; `row` and `term` are the group's words, in order."""
        if not at.size:
            return
        low, high = int(at[0]), int(end.max())
        a, b = np.searchsorted(row, (low, high))
        latent = np.zeros((high - low, group.basis.shape[1]), np.float32)
        starts = np.flatnonzero(np.diff(row[a:b], prepend=-1))
        latent[row[a:b][starts] - low] = np.add.reduceat(group.basis[term[a:b]], starts, axis=0)
        window = latent[at - low]
        for j in range(1, group.size // STEP):
            more = np.flatnonzero(at + j < end)
            window[more] += latent[at[more] + j - low]
        norm = np.sqrt(np.einsum("ij,ij->i", window, window))
        cosine = window @ group.folded.T
        near = cosine >= COVER * group.length
        cosine /= np.where(norm > 0, norm, 1)[:, None]
        for r, c in zip(*np.nonzero(near & (cosine >= group.cosine))):
            yield int(at[r]), int(c), float(cosine[r, c])

    def matches(self, hashes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
        """(text, item id, cosine, lcs, answer, first word, end word) of the best window of
        each text and item that passes the checks."""
        row, term, first = self.entries(hashes, offsets, STEP)
        n_rows = int(first[-1])
        if not row.size:
            return
        text_of = np.repeat(np.arange(offsets.size - 1), np.diff(first))
        place_of = np.arange(n_rows) - first[:-1][text_of]
        places: dict[tuple[int, int, int], list] = {}
        local = np.full(self.terms.size, -1)
        for group in self.groups:
            local[:] = -1
            local[group.terms] = np.arange(group.terms.size)
            own = local[term]
            mine = np.flatnonzero(own >= 0)
            if not mine.size:
                continue
            held = np.concatenate([[0], np.cumsum(np.bincount(row[mine], minlength=n_rows))])
            blocks = group.size // STEP
            at = np.flatnonzero(place_of % (group.step // STEP) == 0)
            end = np.minimum(at + blocks, first[1:][text_of[at]])
            useful = held[end] - held[at] >= group.held
            at, end = at[useful], end[useful]
            cuts = np.searchsorted(at, np.arange(0, n_rows + RUN, RUN))
            for a, b in zip(cuts, cuts[1:]):
                for r, c, cos in self._near(group, at[a:b], end[a:b], row[mine], own[mine]):
                    number, before = group.places[c]
                    low = int(place_of[r]) * STEP - before
                    places.setdefault((int(text_of[r]), number, group.size), []).append((low, cos))
        best: dict[tuple[int, int], tuple] = {}
        for (text, number, size), hits in places.items():
            item, begin, length = self.items[number], int(offsets[text]), int(offsets[text + 1] - offsets[text])
            for low, high, cos in item.regions(hits, size):
                a, b = max(0, low), min(length, high)
                whole, answer = item.checked(hashes[begin + a:begin + b].tolist())
                if (whole >= LCS and answer >= ANSWER) or whole >= STRONG:
                    found = (whole, cos, answer, a, b)
                    if found > best.get((text, item.item_id), (0.0,)):
                        best[text, item.item_id] = found
        for (text, item_id), (whole, cos, answer, a, b) in sorted(best.items()):
            yield text, item_id, cos, whole, answer, a, b


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[Item]]:
    """The items with words in id order, in blocks of QUERIES_PER_BLOCK segments or so (all
    segments of an item are in one block)."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    rows = rows.where("i IS NOT NULL AND t IS NOT NULL").orderBy("i", "t")
    block: list[Item] = []
    queries = 0
    for row in rows.toLocalIterator():
        raw = np.frombuffer(row["t"].encode(), np.uint8)
        words, _ = term_hashes(raw, np.array([0, raw.size]))
        if words.size:
            block.append(Item(row["i"], words.tolist()))
            queries += len(block[-1].cuts) - 1
        if queries >= QUERIES_PER_BLOCK:
            yield block
            block, queries = [], 0
    if block:
        yield block


def _blocks(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for row, end, buf, offs in byte_blocks(batch.column("text")):
            yield (batch, row, end, *term_hashes(buf, offs))


def _fitted(texts: DataFrame, items: list[Item]) -> Latent:
    model = Latent(items)
    n_terms = model.terms.size
    model.idf = np.ones(n_terms)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n_terms + 1, np.int64)
        for _, _, _, hashes, offsets in _blocks(batches):
            row, term, first = model.entries(hashes, offsets, PASSAGE)
            pairs = np.unique(row * (n_terms + 1) + term)
            seen[:-1] += np.bincount(pairs % (n_terms + 1), minlength=n_terms)[:n_terms]
            seen[-1] += first[-1]
        yield from array_sums.shards(seen)

    seen = array_sums.total(texts.mapInArrow(counts, array_sums.SCHEMA), (n_terms + 1,), np.int64)
    model.weigh(seen[:-1], int(seen[-1]))
    width = min(CORPUS_DIRECTIONS + OVERSAMPLE, n_terms)
    test = np.random.default_rng(1).normal(size=(n_terms, width)).astype(np.float32)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((n_terms, width), np.float32)
        weight = model.idf.astype(np.float32)
        for _, _, _, hashes, offsets in _blocks(batches):
            row, term, _ = model.entries(hashes, offsets, PASSAGE)
            if not row.size:
                continue
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            passage = np.add.reduceat(test[term] * weight[term, None], starts, axis=0)
            which = np.cumsum(np.diff(row, prepend=-1) > 0) - 1
            order = np.argsort(term, kind="stable")
            ranked = term[order]
            begin = np.flatnonzero(np.diff(ranked, prepend=-1))
            out[ranked[begin]] += np.add.reduceat(passage[which[order]], begin, axis=0) * weight[ranked[begin], None]
        yield from array_sums.shards(out)

    done = array_sums.total(texts.mapInArrow(sketch, array_sums.SCHEMA), (n_terms, width), np.float32)
    model.settle(done.astype(np.float64), test.astype(np.float64))
    return model


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that the document holds, verbatim or
    paraphrased: doc_id, item_id, cosine, lcs, answer (shares of the item and of its last
    quarter found in order), first_word, end_word (the compared words of the document).

    Items without words or id and texts without words match nothing; an item of one word is
    found wherever a text holds that word.  An empty table or benchmark gives an empty result.  A repeated document row repeats its matches; of
    repeated item ids the better match counts.  Other columns are never read.
    """
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text_col)
    return found.drop("text_hash")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows of `docs` that hold no benchmark item, with all their columns.  Rows are found
    again by (id, null being an id too; hash of the text)."""
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text_col)
    found = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash"))
    return docs.join(saved(found, "contaminated"), same, "left_anti")


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str,
           item_text_col: str) -> DataFrame:
    """The rows of `contaminated` with the hash of the document's text."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                        F.xxhash64(text_col).alias("text_hash"))
    schema = ("doc_id long, item_id long, cosine double, lcs double, answer double, "
              "first_word int, end_word int, text_hash long")
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int64()]
    names = [c.split()[0] for c in schema.split(", ")]
    out = []
    for items in _item_blocks(benchmark, item_col, item_text_col):
        model = _fitted(texts.select("text"), items)

        def search(batches: Iterator[pa.RecordBatch], model: Latent = model) -> Iterator[pa.RecordBatch]:
            for batch, row, _, hashes, offsets in _blocks(batches):
                found = list(model.matches(hashes, offsets))
                if found:
                    at = pa.array([row + f[0] for f in found], pa.int64())
                    ids, hashed = (batch.column(c).take(at) for c in ("doc_id", "text_hash"))
                    rest = list(zip(*found))[1:]
                    yield pa.RecordBatch.from_arrays(
                        [ids, *(pa.array(c, k) for c, k in zip(rest, kinds[1:-1])), hashed], names)

        out.append(saved(texts.mapInArrow(search, schema), "matches"))
    return reduce(DataFrame.unionByName, out) if out else docs.sparkSession.createDataFrame([], schema)
