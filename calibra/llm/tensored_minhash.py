"""MinHash near-duplicates with tensored banding (operator 5).

Two collections of m short keys, each made of r minhashes, give m * m table keys by
pairing: table (i, j) uses (left_i, right_j).  That costs 2 * m * r minhashes where
plain banding with keys of 2 * r hashes would cost m * m * 2 * r.  A pair of similarity s
meets in some table unless one collection misses entirely, so it is missed with
probability below 2 * (1 - s**r)**m; `tables` picks m for a bound of 0.2 % at the
threshold, less above it.  Every candidate is confirmed on the full shingle sets.

1. One pass makes each document's distinct shingles (64-bit hashes), a 128-bit digest of
   the set and the two collections.  Documents with equal sets form a class (a partial
   aggregate); only its number goes on, with the smallest (id, text hash) to find a text by.
   So texts that share an id keep sets of their own; ids are joined at the very end.
2. (table key, id) rows are range-partitioned and sorted by both columns, so a huge bucket
   is spread over several ranges.  Each range passes on the rows of runs of two or more;
   a small aggregate joins runs that cross ranges.
3. Every bucket gets a hub, the document that meets most others over all buckets (the
   original among its near copies).  Links are confirmed in three steps: every document
   with the hub it meets most often; then with its other hubs outside its component; then
   documents of buckets that still hold several components, by prefix filtering, which
   is exact: similar documents share one of their rarest shingles, and where it stands in
   both orders bounds their intersection.  So every pair of a bucket is confirmed, is
   provably no link, or is in one component already, and near copies are not compared all
   to all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.llm.components import components
from calibra.llm.scratch import saved
from calibra.llm.textblocks import byte_blocks, mix, rolling, window_starts, words_of

HASHES_PER_KEY = 3
MISS = 0.002
#: Bits of the map of text hashes that `possible` broadcasts: 2 MB, whatever the table's size.
MAP_BITS = 1 << 24


def tables(threshold: float) -> int:
    """Keys per collection so that a pair at the threshold is missed with probability <= MISS."""
    return max(2, math.ceil(math.log(MISS / 2) / math.log(1 - threshold ** HASHES_PER_KEY)))


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block, and their offsets.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z as a-z; fewer than k words make one shingle
    of all of them; no words make none.
    """
    w, h = words_of(buf, offs, fold=True)
    at, rows = window_starts(w.offsets, k)
    grams = rolling(h, k)[at] if at.size else np.zeros(0, np.uint64)
    bounds = np.searchsorted(rows, np.arange(offs.size))
    sets = []
    for i in range(offs.size - 1):
        a, b = w.offsets[i], w.offsets[i + 1]
        if b - a >= k:
            sets.append(np.unique(grams[bounds[i]:bounds[i + 1]]))
        elif b > a:
            sets.append(mix(rolling(h[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64),
            np.concatenate([[0], np.cumsum([s.size for s in sets])]).astype(np.int64))


def _signature_batches(k: int, m: int):
    rng = np.random.default_rng(71)
    n = 2 * m * HASHES_PER_KEY
    factor = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, n, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buf, offs in byte_blocks(batch.column("text")):
                items, cuts = shingle_sets(buf, offs, k)
                sizes = np.diff(cuts)
                full = np.flatnonzero(sizes)
                keys = np.zeros((sizes.size, 2 * m), np.uint64)
                digest = np.zeros((2, sizes.size), np.uint64)
                if full.size:
                    at = cuts[:-1][full]
                    digest[0, full] = np.add.reduceat(mix(items + np.uint64(1)), at)
                    digest[1, full] = np.add.reduceat(mix(items ^ np.uint64(0x5851F42D4C957F2D)), at)
                    for j in range(n):
                        least = np.minimum.reduceat(items * factor[j] + shift[j], at)
                        keys[full, j // HASHES_PER_KEY] = mix(keys[full, j // HASHES_PER_KEY] * np.uint64(31) + least)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(part).view(np.int64).ravel()), m)
                         .cast(pa.list_(pa.int64())) for part in (keys[:, :m], keys[:, m:])]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(row, end - row) for c in ("doc_id", "text_hash")), pa.array(sizes, pa.int64()),
                     pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), *lists],
                    ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "left_keys", "right_keys"])
    return run


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range: (key, member, centre, edge).  Every row of a run but the
    first is linked to the first; the first rows of the range's first and last run are
    edge rows, as their runs may go on in the neighbouring range."""
    key = centre = None
    names = ["key", "member", "centre", "edge"]

    def made(k, a, c, edge):
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(a, pa.int64()), pa.array(c, pa.int64()),
                                           pa.array(np.full(len(k), edge))], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "rep"))
        new = np.ones(keys.size, bool)
        new[1:] = keys[1:] != keys[:-1]
        if key is None:
            yield made(keys[:1], ids[:1], ids[:1], True)
        elif keys[0] == key:
            new[0] = False
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1                        # -1: the run of the last batch goes on
        centres = np.where(run >= 0, ids[first[np.maximum(run, 0)]] if first.size else 0, centre if centre is not None else 0)
        rest = ~new
        if rest.any():
            yield made(keys[rest], ids[rest], centres[rest], False)
        key, centre = keys[-1], centres[-1]
    if key is not None:
        yield made([key], [centre], [centre], True)


def _similar(k: int, percent: int):
    """Rows (u, v, text_u, text_v) whose shingle sets have 100 * both >= percent * either."""
    def sets_of(ids: list, texts: pa.Array) -> dict:
        rows = {i: r for r, i in enumerate(ids)}
        column = texts.take(pa.array(list(rows.values()), pa.int64()))
        found = {}
        names = list(rows)
        for row, end, buf, offs in byte_blocks(column):
            items, cuts = shingle_sets(buf, offs, k)
            for i in range(end - row):
                found[names[row + i]] = items[cuts[i]:cuts[i + 1]]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                us, vs = batch.column("u").to_pylist(), batch.column("v").to_pylist()
                left, right = sets_of(us, batch.column("text_u")), sets_of(vs, batch.column("text_v"))
                keep = []
                for i, (u, v) in enumerate(zip(us, vs)):
                    a, b = left[u], right[v]
                    low, high = sorted((a.size, b.size))
                    if low and 100 * low >= percent * high:
                        both = np.intersect1d(a, b, assume_unique=True).size
                        if 100 * both >= percent * (a.size + b.size - both):
                            keep.append(i)
                got = batch.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([got.column("u"), got.column("v")], ["u", "v"])
    return run


def _shingles(k: int):
    """(rep, shingle) of every distinct shingle of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buf, offs in byte_blocks(batch.column("text")):
                items, cuts = shingle_sets(buf, offs, k)
                ids = batch.column("rep").slice(row, end - row).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, np.diff(cuts)), pa.int64()), pa.array(items.view(np.int64))],
                    ["rep", "shingle"])
    return run


def possible(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of `texts` whose text_hash may be one of `wanted`, so that a join with `wanted`
    shuffles few other texts: every wanted hash sets one of MAP_BITS bits, and rows whose
    bit is not set go.  The map has a fixed size; the more hashes, the more rows stay."""
    place = F.pmod("text_hash", F.lit(MAP_BITS).cast("long")) + 1
    bits = wanted.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    rows = texts.select("*", F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0
    return rows.join(F.broadcast(bits), "bucket").where(is_set).select(*texts.columns)


def _linked(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, roots): doc_id, text_hash, n_shingles and class number `rep` (null
    without words or id) of every row; rep, doc_id, text_hash of every class, its smallest
    row; (node, root) of the classes that have links, components of which share a root."""
    m = tables(percent / 100)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                        F.xxhash64(text_col).alias("text_hash"))
    signed = saved(texts.mapInArrow(
        _signature_batches(k, m), "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, "
                                  "left_keys array<long>, right_keys array<long>"), "signatures")
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["set_a", "set_b", "n_shingles"]
    grouped = usable.groupBy(*same).agg(F.min(F.struct("doc_id", "text_hash")).alias("least"),
                                        F.first("left_keys").alias("left_keys"), F.first("right_keys").alias("right_keys"))
    # The numbers are fixed by the written table; only their being distinct matters.
    classes = saved(grouped.select(F.monotonically_increasing_id().alias("rep"), "least.doc_id", "least.text_hash",
                                   *same, "left_keys", "right_keys"), "classes")
    keyed = classes.select("rep", F.explode(F.expr(
        "flatten(transform(left_keys, (a, i) -> transform(right_keys, (b, j) -> xxhash64(a, b, i, j))))")).alias("key"))
    ranged = keyed.repartitionByRange("key", "rep").sortWithinPartitions("key", "rep")
    linked = saved(ranged.select("key", "rep").mapInArrow(
        _bucket_links, "key long, member long, centre long, edge boolean"), "bucket-links")
    edge = linked.where("edge").select("key", "centre").distinct()
    over = edge.groupBy("key").agg(F.min("centre").alias("least"))
    crossing = edge.join(over, "key").where("centre > least").select(
        "key", F.col("centre").alias("member"), F.col("least").alias("centre"))
    first = linked.where("NOT edge").select("key", "member", "centre").unionByName(crossing)
    inside = saved(first.select("key", F.col("member").alias("rep"))
                   .union(first.select("key", F.col("centre").alias("rep"))).distinct(), "buckets")
    sizes = saved(inside.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "bucket-sizes")
    reach = saved(inside.join(sizes, "key").groupBy("rep").agg(F.sum("size").alias("reach")), "reach")
    hubs = saved(inside.join(reach, "rep").groupBy("key").agg(
        (-F.max(F.struct("reach", (-F.col("rep")).alias("r")))["r"]).alias("centre")), "hubs")
    stars = inside.select("key", F.col("rep").alias("member")).join(hubs, "key").where("member <> centre")
    involved = saved(classes.select("rep", "doc_id", "text_hash").join(inside.select("rep").distinct(), "rep", "left_semi"),
                     "involved")
    wanted = possible(texts.where("doc_id IS NOT NULL"), involved).join(involved, ["doc_id", "text_hash"])
    wanted = saved(wanted.groupBy("doc_id", "text_hash", "rep").agg(F.first("text").alias("text"))  # repeated rows once
                   .select("rep", "text"), "involved-texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        u = wanted.select(F.col("rep").alias("u"), F.col("text").alias("text_u"))
        v = wanted.select(F.col("rep").alias("v"), F.col("text").alias("text_v"))
        return saved(pairs.select("u", "v").join(v, "v").join(u, "u").select("u", "v", "text_u", "text_v")
                     .mapInArrow(_similar(k, percent), "u long, v long").distinct(), "confirmed")

    met = saved(stars.groupBy("member", "centre").agg(F.count(F.lit(1)).alias("n")), "met")
    best = saved(met.groupBy("member").agg(F.max(F.struct("n", (-F.col("centre")).alias("c"))).alias("best"))
                 .select((-F.col("best.c")).alias("u"), F.col("member").alias("v"))
                 .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "best")
    links = confirmed(best)
    roots = components(links)

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs (u, v) whose ends are in different components so far."""
        a, b = (roots.select(F.col("node").alias(f"{c}_node"), F.col("root").alias(f"{c}_root")) for c in "uv")
        return (pairs.join(a, F.col("u") == F.col("u_node"), "left").join(b, F.col("v") == F.col("v_node"), "left")
                .where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v"))

    tried = best
    others = met.select(F.least("centre", "member").alias("u"), F.greatest("centre", "member").alias("v")).distinct()
    others = others.join(tried, ["u", "v"], "left_anti")
    second = saved(apart(others), "second")
    if second.limit(1).count():
        more = confirmed(second)
        tried = tried.union(second)
        if more.limit(1).count():
            links = links.union(more)
            roots = components(links)
    label = roots.select(F.col("node").alias("rep"), "root")
    inside = inside.join(label, "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("part"))
    inside = inside.join(classes.select("rep", F.col("n_shingles").alias("n")), "rep")

    several = inside.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b")
    inside = saved(inside.join(several.select("key"), "key", "left_semi"), "mixed-buckets")
    # The exact way for these: order shingles by how many of the documents have them; two
    # similar documents share one of their rarest shingles, early enough in both orders.
    left = inside.select("rep", "part", "n").distinct()
    every = saved(wanted.join(left.select("rep"), "rep", "left_semi").select("rep", "text")
                  .mapInArrow(_shingles(k), "rep long, shingle long"), "shingles")
    spread = every.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # One document's shingles, rarest first; those that no other has come before all others,
    # so only the others are numbered, from the last place (n) down.
    order = Window.partitionBy("rep").orderBy(F.col("df").desc(), F.col("shingle").desc())
    early = (every.join(saved(spread, "shingle-counts"), "shingle").withColumn("last", F.row_number().over(order))
             .join(left, "rep").withColumn("at", F.col("n") - F.col("last") + 1)
             .where((F.col("n") - F.col("at") + 1) * 100 >= F.col("n") * percent))
    early = saved(early.select("shingle", "rep", "part", "n", "at"), "early-shingles")
    one, two = early.alias("one"), early.alias("two")
    most = F.least(F.col("one.n") - F.col("one.at"), F.col("two.n") - F.col("two.at")) + 1
    third = saved(one.join(two, (F.col("one.shingle") == F.col("two.shingle")) & (F.col("one.part") < F.col("two.part"))
                           & (F.col("one.n") * 100 >= F.col("two.n") * percent)
                           & (F.col("two.n") * 100 >= F.col("one.n") * percent)
                           & (most * (100 + percent) >= (F.col("one.n") + F.col("two.n")) * percent))
                  .select(F.least("one.rep", "two.rep").alias("u"), F.greatest("one.rep", "two.rep").alias("v"))
                  .distinct().join(tried, ["u", "v"], "left_anti"), "third")
    if third.limit(1).count():
        more = confirmed(third)
        if more.limit(1).count():
            roots = components(links.union(more))
    rows = saved(signed.select("doc_id", "text_hash", *same)
                 .join(classes.select(*same, "rep"), same, "left")
                 .select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")),
                 "rows-of-classes")
    return rows, classes.select("rep", "doc_id", "text_hash"), roots


def _least_of_components(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(rep, least_id, least_hash): the smallest (doc_id, text_hash) of each class's component."""
    placed = saved(classes.join(roots, F.col("rep") == F.col("node"), "left")
                   .select("rep", F.coalesce("root", "rep").alias("root"), "doc_id", "text_hash"), "placed")
    least = saved(placed.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("least")), "least")
    return saved(placed.join(least, "root").select("rep", F.col("least.doc_id").alias("least_id"),
                                                   F.col("least.text_hash").alias("least_hash")), "least-of-classes")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    A document's set holds its distinct k-word shingles (A-Z as a-z; fewer words: all of
    them as one shingle).  Documents are linked when 100 * intersection >= percent * union;
    component_id is the smallest doc_id reachable.  Null, empty and wordless texts have an
    empty set, are linked with nothing and stay.  Rows with a null id are linked with
    nothing: their component_id is null and kept is true.  Rows with words that share an id
    are one node: each text has its own set and links, and the links of all of them count
    for the id.  An empty table gives an empty result; other columns are never read.
    """
    rows, classes, roots = _linked(docs, k, percent, id_col, text_col)
    owned = rows.where("rep IS NOT NULL")
    shared = saved(owned.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("last"))
                   .where("u < last").select("doc_id", "u"), "shared-ids")
    if shared.limit(1).count():
        through = owned.join(shared, "doc_id").select("u", F.col("rep").alias("v")).where("u <> v").distinct()
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(through))
    own = F.col("doc_id")
    return (rows.join(_least_of_components(classes, roots), "rep", "left")
            .select("doc_id", "n_shingles", F.when(own.isNotNull(), F.coalesce("least_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("component_id").isNull() | (own == F.col("component_id"))))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `docs`, with all their columns, without the near copies: of texts linked
    directly or through others, the one with the smallest (id, hash of the text) stays.

    Rows are judged by their own text, also where they share an id, and are found again by
    (id, hash of the text); equal rows stay or go together.  Wordless texts and null ids stay.
    """
    rows, classes, roots = _linked(docs, k, percent, id_col, text_col)
    gone = (rows.join(_least_of_components(classes, roots), "rep")
            .where("doc_id <> least_id OR text_hash <> least_hash")
            .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    same = (F.col(id_col).cast("long") == F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash"))
    return docs.join(saved(gone, "near-copies"), same, "left_anti")
