"""Spelling variants of a vocabulary by a trie of letter-group counts (operator 11).

1. A word becomes the vector of its counts of GROUPS letter groups (code point mod GROUPS).
   One edit changes the vector by a surplus of one (insertion), a surplus and a deficit
   (replacement) or not at all (replacement within a group).
2. The words are arranged in a trie whose levels are the groups, heaviest letter mass
   first; a leaf holds the words of one vector.  The depth-first search of a word may spend
   one surplus, and one deficit after it: the other orders belong to the search that starts
   at the other word of the pair, so each pair of vectors is met once.
3. Words of a reached leaf are verified: one edit leaves the first or the last half of the
   shorter word as it is, so a leaf is looked up by halves and the rest compared.

The trie is spread over the cluster by the prefixes of its first levels: a prefix is one
subtree, and a word also searches the subtrees that its budget reaches.  The number of
prefix levels follows the vocabulary; a subtree above SUBTREE_WORDS words is dealt to
several tries and its searches are sent to each, so no task grows with the vocabulary and
nothing is left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.llm.scratch import saved

GROUPS = 16
SUBTREE_WORDS = 8192
PREFIX_MAX = 6
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX, SEARCH = -1, 0                  # roles of a row; a search row's role is the budget it has spent


# -- vocabulary -----------------------------------------------------------------

def word_counts(docs: DataFrame, least_chars: int = 6, least_count: int = 5,
                rewrite: Callable[[Column, Column], Column] | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(word, n): letter runs of all texts, A-Z folded, with at least `least_chars` code
    points and `least_count` occurrences.  `rewrite(id, run)` may change an occurrence
    first.  Null and empty texts hold no run; repeated rows count each time."""
    runs = docs.select(F.col(id_col).alias("__id"),
                       F.explode(F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("word"))
    if rewrite is not None:
        runs = runs.select(rewrite(F.col("__id"), F.col("word")).alias("word"))
    return (runs.where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= least_count))


# -- vectors and the trie -------------------------------------------------------

def vectors(words: list[str], levels: tuple[int, ...]) -> np.ndarray:
    """Counts of the letter groups of each word, in the order of the levels."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    counts = np.bincount(row * GROUPS + codes % GROUPS, minlength=len(words) * GROUPS)
    return counts.reshape(len(words), GROUPS)[:, list(levels)]


class Leaf:
    """Words of one vector; `rest` are the counts below the node that holds the leaf."""

    def __init__(self, rest: tuple[int, ...], words: list[tuple[str, int]]):
        self.rest, self.words, self.halves = rest, words, {}

    def admits(self, counts: tuple[int, ...], spent: int) -> int | None:
        """Budget spent when the counts meet this leaf, None where it doesn't suffice."""
        for own, other in zip(counts, self.rest):
            if own != other:
                if spent == 0 and other == own + 1:
                    spent = 1
                elif spent == 1 and other == own - 1:
                    spent = 2
                else:
                    return None
        return spent

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Words of this leaf at one edit from `word` (no longer than they are)."""
        half = len(word) // 2
        known = self.halves.get(half)
        if known is None:
            known = self.halves[half] = {}
            for item in self.words:
                known.setdefault((0, item[0][:half]), []).append(item)
                known.setdefault((1, item[0][len(item[0]) - half:]), []).append(item)
        head = known.get((0, word[:half]), ())
        tail = known.get((1, word[len(word) - half:]), ())
        yield from (item for item in head if one_edit(word, item[0]))
        yield from (item for item in tail if item[0][:half] != word[:half] and one_edit(word, item[0]))


def one_edit(short: str, long: str) -> bool:
    """Exactly one code point inserted or replaced turns `short` into `long`."""
    lo, hi = 0, len(short)                      # length of the common prefix, by halving
    if short == long[:hi]:
        return len(long) == hi + 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if short[lo:mid] == long[lo:mid]:
            lo = mid
        else:
            hi = mid
    return short[lo + (len(short) == len(long)):] == long[lo + 1:]


def build(counts: np.ndarray, words: list[tuple[str, int]], level: int) -> dict | Leaf:
    """Trie below `level` of words in the order of their vectors: {count: child}, down to a
    leaf where all words share the remaining counts."""
    if (counts[0, level:] == counts[-1, level:]).all():      # sorted rows: first and last agree
        return Leaf(tuple(counts[0, level:].tolist()), words)
    edges = np.flatnonzero(np.diff(counts[:, level], prepend=-1)).tolist() + [len(words)]
    return {int(counts[a, level]): build(counts[a:b], words[a:b], level + 1) for a, b in zip(edges, edges[1:])}


def search(root: dict | Leaf, level: int, counts: tuple[int, ...], spent: int) -> Iterator[tuple[Leaf, int]]:
    """Depth first: leaves within the budget, and what it took to reach them."""
    stack = [(root, level, spent)]
    while stack:
        node, at, used = stack.pop()
        if isinstance(node, Leaf):
            total = node.admits(counts[at:], used)
            if total is not None:
                yield node, total
            continue
        own = counts[at]
        for count, cost in ((own, used), (own + 1, 1) if used == 0 else (own - 1, 2)):
            child = node.get(count) if cost == used or used < 2 else None
            if child is not None:
                stack.append((child, at + 1, cost))


# -- spread over the cluster ----------------------------------------------------

def _prefixes(counts: list[int]) -> Iterator[tuple[bytes, int]]:
    """(prefix, budget spent): the subtrees that a word with these first counts searches."""
    key = lambda c: np.array(c, np.uint32).tobytes()
    yield key(counts), SEARCH
    for i in range(len(counts)):
        more = counts[:i] + [counts[i] + 1] + counts[i + 1:]
        yield key(more), 1
        for j in range(i + 1, len(counts)):
            if more[j]:
                yield key(more[:j] + [more[j] - 1] + more[j + 1:]), 2


def _rows(batches: Iterator[pa.RecordBatch], levels: tuple[int, ...], depth: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        out: tuple[list, ...] = ([], [], [])
        for i, first in enumerate(vectors(words, levels)[:, :depth].tolist()):
            reached = list(_prefixes(first))
            out[0].extend([reached[0][0]] + [p for p, _ in reached])
            out[1].extend([INDEX] + [s for _, s in reached])
            out[2].extend([i] * (len(reached) + 1))
        rows = batch.take(pa.array(out[2], pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()),
                                          rows.column("word"), rows.column("n")], ["subtree", "role", "word", "n"])


def _pairs(table: pa.Table, levels: tuple[int, ...], depth: int) -> pa.Table:
    """(word, other, other_n) of the near words of one trie, both ways."""
    out: tuple[list, ...] = ([], [], [])
    rows = list(zip(table["role"].to_pylist(), table["word"].to_pylist(), table["n"].to_pylist()))
    held = [r for r in rows if r[0] == INDEX]
    asked = [r for r in rows if r[0] != INDEX]
    if held and asked:
        counts = vectors([w for _, w, _ in held], levels)
        order = np.lexsort(counts.T[::-1])
        root = build(counts[order], [held[k][1:] for k in order.tolist()], depth)
        for (spent, word, n), own in zip(asked, vectors([w for _, w, _ in asked], levels).tolist()):
            for leaf, used in search(root, depth, tuple(own), spent):
                for other, other_n in leaf.near(word):
                    out[0].append(word)
                    out[1].append(other)
                    out[2].append(other_n)
                    if used:                    # equal vectors: the other word's search finds this one
                        out[0].append(other)
                        out[1].append(word)
                        out[2].append(n)
    return pa.table({"word": pa.array(out[0], pa.string()), "other": pa.array(out[1], pa.string()),
                     "other_n": pa.array(out[2], pa.int64())})


def near_words(counts: DataFrame, subtree_words: int = SUBTREE_WORDS) -> DataFrame:
    """(word, other, other_n): every ordered pair of words at one edit, once.

    `counts` holds distinct, non-null, non-empty words (word, n)."""
    mass = {r["g"]: r["m"] for r in counts.select(F.explode(F.split("word", "")).alias("c"))
            .groupBy((F.ascii("c") % GROUPS).alias("g")).agg(F.count(F.lit(1)).alias("m")).collect()}   # GROUPS rows
    levels = tuple(sorted(range(GROUPS), key=lambda g: (-mass.get(g, 0), g)))
    size = counts.count()
    depth = min(PREFIX_MAX, math.ceil(math.log2(size / subtree_words))) if size > subtree_words else 0
    rows = counts.select("word", "n").mapInArrow(lambda it: _rows(it, levels, depth),
                                                 "subtree binary, role int, word string, n long")
    rows = saved(rows, "trie-rows")
    cut = lambda held: F.ceil(F.count(F.when(held, 1)) / F.lit(float(subtree_words))).cast("int")
    # (a subtree without words answers no search)
    tries = saved(rows.groupBy("subtree").agg(cut(F.col("role") == INDEX).alias("tries"), cut(F.col("role") != INDEX).alias("askers"))
                  .where("tries > 0"), "trie-counts")
    hashed = F.xxhash64("word")
    is_index = F.col("role") == INDEX
    dealt = rows.join(tries, "subtree").select(
        "subtree", "role", "word", "n",
        F.explode(F.when(is_index, F.sequence(F.lit(0), F.col("askers") - 1))
                  .otherwise(F.sequence(F.lit(0), F.col("tries") - 1))).alias("copy"),
        F.pmod(hashed, F.when(is_index, F.col("tries")).otherwise(F.col("askers")).cast("long")).cast("int").alias("own"))
    group = ["subtree", F.when(is_index, F.col("own")).otherwise(F.col("copy")).alias("trie"),
             F.when(is_index, F.col("copy")).otherwise(F.col("own")).alias("asker")]
    # dealt by all three, or the tries of a hot subtree would stay in the task of its join
    dealt = dealt.select("role", "word", "n", *group).repartition("subtree", "trie", "asker")
    return dealt.groupBy("subtree", "trie", "asker").applyInArrow(
        lambda t: _pairs(t, levels, depth), "word string, other string, other_n long")


def variants(counts: DataFrame, ratio: int = 5, subtree_words: int = SUBTREE_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of `counts` (distinct word, n).

    Near words differ by exactly one inserted, deleted or replaced code point.  `form` is
    the near word of largest n (ties: smallest in code-point order) if its n is at least
    `ratio` (two or more) times the word's, else null; `root` follows forms to the last, and is the
    word itself without a form; n_near counts near words.  An empty vocabulary gives an
    empty result.
    """
    if ratio < 2:
        raise ValueError("ratio: two or more")
    words = saved(counts.select("word", "n"), "vocabulary")
    best = near_words(words, subtree_words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    found = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    table = saved(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(is_form, F.col("best.other")).alias("form"),
                               F.when(is_form, -F.col("best.less")).alias("form_n")), "word-forms")
    # a form is `ratio` times as frequent as its word, so chains are short and end
    roots = table.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = saved(roots.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "word-roots")
        if not roots.where("moved").limit(1).count():
            break
        roots = roots.select("word", "root")
    return table.join(roots.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
