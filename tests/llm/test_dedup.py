"""Deduplication operators against brute force on small tables with awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from calibra.llm import difference_cover, tensored_minhash
from calibra.llm.anchors import remove_repeats
from calibra.llm.components import components
from calibra.llm.content_sort import exact_dedup, keep_first_copies
from calibra.llm.difference_cover import remove_later_copies
from calibra.llm.tensored_minhash import drop_near_copies, near_duplicates, tables

#: Names that operators use inside, as columns of the input.
CLASHES = ("chunk", "key", "rep", "part", "run", "hash", "norm", "string", "pos", "rank", "component_id", "kept",
           "removed", "text_hash")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(c) for c in CLASHES})


def words(rng, n):
    return [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(9)) for _ in range(n)]


def awkward(rng):
    """Null and empty texts, a null id, copies, near copies, a long text, whitespace."""
    base = words(rng, 120)
    near = list(base)
    near[50] = "changed"
    other = words(rng, 90)
    return [(10, " ".join(base)), (11, None), (12, ""), (13, " \t\n"), (14, " ".join(base)), (15, "  ".join(base)),
            (16, " ".join(near)), (17, " ".join(other)), (18, " ".join(other[:60] + words(rng, 60))),
            (19, " ".join(words(rng, 4000) + other[:50])), (20, "uno dos"), (21, "UNO dos"), (22, "tres"),
            (None, " ".join(words(rng, 50))), (23, "día ñandú 中文 " * 30), (24, "día ñandú 中文 " * 29)]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup_matches_grouping_whatever_the_ranges(spark):
    rng = random.Random(3)
    rows = awkward(rng) + [(100 + i, "same  text") for i in range(300)] + [(500 + i, "same text") for i in range(300)]
    rows += [(30, "twice"), (30, "twice")]
    rng.shuffle(rows)
    got = exact_dedup(frame(spark, rows).repartition(5)).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    expected = collections.Counter(
        (i, min((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest())
        for t, g in groups.items() for i in g)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert len(kept) == len(groups) and set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    left = keep_first_copies(frame(spark, rows)).collect()
    assert len(left) == len(groups) and "chunk" in left[0].asDict()


def test_empty_tables_give_empty_results(spark):
    none = frame(spark, [])
    assert exact_dedup(none).count() == 0
    assert remove_repeats(none).count() == 0
    assert near_duplicates(none).count() == 0


def brute_repeats(rows, window):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = collections.Counter(tuple(w[i:i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, texts):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((doc, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return collections.Counter(out)


@pytest.mark.parametrize("window", [35, 8])
def test_repeated_windows_match_brute_force(spark, window):
    rows = awkward(random.Random(4)) + [(17, None), (40, "la la " * 60)]
    rows += [rows[0]]                               # a repeated row repeats its own windows
    got = remove_repeats(frame(spark, rows), window).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute_repeats(rows, window)
    for r in got:
        assert sum(s.end - s.first for s in r.removed) == r.n_removed


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for n, (a, s) in enumerate(sets):
        for b, t in sets[:n]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, k, percent):
    rng = random.Random(5)
    rows = awkward(rng)
    base = words(rng, 300)
    for i in range(40):                              # near copies at all distances
        copy = list(base)
        for _ in range(i // 4):
            copy[rng.randrange(300)] = f"edit{i}{rng.randrange(99)}"
        rows.append((200 + i, " ".join(copy)))
    chain = words(rng, 150)
    for i in range(12):                              # a chain whose ends aren't alike
        rows.append((300 + i, " ".join(chain[4 * i:100 + 4 * i])))
    got = near_duplicates(frame(spark, rows), k, percent).collect()
    expected = brute_components(rows, k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == expected
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def similar(s, t, percent):
    return bool(s and t) and 100 * len(s & t) >= percent * len(s | t)


def shared_id_rows(rng):
    """Ids with several texts, links through them, repeated rows, rows without words or id."""
    base = [words(rng, 60) for _ in range(30)]
    rows = []
    for i in range(50):
        for _ in range(rng.randrange(1, 4)):
            text = list(rng.choice(base))
            for _ in range(rng.randrange(0, 6)):
                text[rng.randrange(60)] = f"edit{rng.randrange(40)}"
            rows.append((i, " ".join(text)))
    rows += rows[:9] + rows[:3] + [(None, rows[0][1]), (4, None), (4, ""), (5, " \t"), (60, None), (61, "solo"), (61, "SOLO")]
    return rows


def root_finder():
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    def join(a, b):
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return find, join


def test_a_link_through_texts_that_share_an_id_is_kept(spark):
    one, two = words(random.Random(31), 40), words(random.Random(32), 40)
    rows = [(1, " ".join(one)), (2, " ".join([*one, "more"])), (2, " ".join(two)), (3, " ".join([*two, "more"]))]
    got = near_duplicates(frame(spark, rows), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [
        (1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False)]
    left = drop_near_copies(frame(spark, rows), 3, 85).collect()
    assert sorted((r.doc_id, r.text) for r in left) == sorted([rows[0], rows[2]])


def test_near_duplicates_with_shared_ids_match_brute_force(spark):
    rows = shared_id_rows(random.Random(21))
    sets = [shingles(t, 3) for _, t in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(a)
              if None not in (rows[a][0], rows[b][0]) and similar(sets[a], sets[b], 85)]
    find, join = root_finder()
    for a, b in linked:
        join(rows[a][0], rows[b][0])
    expected = collections.Counter(
        (i, len(s), None if i is None else find(i) if s else i) for (i, _), s in zip(rows, sets))
    got = near_duplicates(frame(spark, rows).repartition(3), 3, 85).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)

    find, join = root_finder()
    for a, b in linked:
        join(a, b)
    groups = collections.defaultdict(list)
    for a, (i, t) in enumerate(rows):
        groups[find(a)].append((i, t))
    left = drop_near_copies(frame(spark, rows).repartition(3), 3, 85)
    assert left.columns == frame(spark, []).columns
    left = collections.Counter((r.doc_id, r.text) for r in left.collect())
    assert not left - collections.Counter(rows)
    for group in groups.values():
        kept = {r for r in group if left[r]}
        assert len(kept) == 1 and next(iter(kept))[0] == min(group, key=lambda r: (r[0] is not None, r[0]))[0]
        assert all(left[r] == rows.count(r) for r in kept)


def test_number_of_tables_bounds_the_miss():
    for threshold in (0.5, 0.8, 0.85, 0.95):
        m = tables(threshold)
        assert 1 - (1 - (1 - threshold ** 3) ** m) ** 2 <= 0.002


def test_components_of_random_links(spark):
    rng = random.Random(6)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)]
    links += [(500, 500 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}


def test_later_byte_copies_match_brute_force(spark):
    rng = random.Random(7)
    rows = awkward(rng)[:13] + [(23, "día ñandú 中文 " * 12), (30, "ab" * 130), (31, None)]
    window, seen, expected = 100, set(), []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            piece = data[i:i + window]
            if piece in seen:
                gone[i:i + window] = b"\1" * window
            seen.add(piece)
        spans = len(re.findall(b"\1+", bytes(gone)))
        expected.append((doc, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    got = remove_later_copies(frame(spark, rows), window).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(expected)


def test_a_hot_key_is_cut_into_slices(spark, monkeypatch):
    """A line that every document holds before another text: one row per document."""
    monkeypatch.setattr(difference_cover, "HOT", 100)
    monkeypatch.setattr(difference_cover, "SLICE", 40)
    largest, slices = [], difference_cover._slices

    def counted(distinct, base, keys):
        out = slices(distinct, base, keys)
        parts = [*keys, "slice"] if "slice" in out.columns else keys
        largest.append(tuple(out.groupBy(*parts).count().agg(F.max("count"), F.sum("count")).first()))
        assert distinct.count() == largest[-1][1]
        return out
    monkeypatch.setattr(difference_cover, "_slices", counted)
    rng = random.Random(12)
    line = " ".join(words(rng, 30))[:101]
    texts = [(i, f"{rng.random()} {line} {' '.join(words(rng, 6))}") for i in range(400)]
    window, seen, expected = 100, set(), []
    for doc, text in texts:
        data, gone = text.encode(), bytearray(len(text))
        for i in range(len(data) - window + 1):
            if data[i:i + window] in seen:
                gone[i:i + window] = b"\1" * window
            seen.add(data[i:i + window])
        expected.append((doc, sum(gone), bytes(b for b, g in zip(data, gone) if not g)))
    got = remove_later_copies(frame(spark, texts), window).collect()
    assert sorted((r.doc_id, r.n_removed, bytes(r.kept)) for r in got) == expected
    assert max(x for x, _ in largest) <= 200, largest


def test_later_byte_copies_with_null_ids_repeats_and_an_empty_table(spark):
    """The null id is the smallest; rows that repeat id and text are one document."""
    rng = random.Random(21)
    passage = " ".join(words(rng, 60))[:120]
    rows = [(None, passage + "|"), (5, "lead " + passage), (5, "lead " + passage), (9, passage[:99]), (None, None), (7, "")]
    got = remove_later_copies(frame(spark, rows).repartition(3), 100).collect()
    size = len(passage)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted([
        (-1, size + 1, 0, 0, (passage + "|").encode()), (-1, 0, 0, 0, b""), (7, 0, 0, 0, b""),
        (5, size + 5, size, 1, b"lead "), (5, size + 5, size, 1, b"lead "), (9, 99, 0, 0, passage[:99].encode())])
    assert remove_later_copies(frame(spark, []), 100).collect() == []


def test_equal_windows_are_neighbours_in_suffix_order():
    rng = np.random.default_rng(3)
    for letters in (1, 2, 3, 200):
        for window in (1, 5, 8, 20, 33, 100):
            part = rng.integers(0, letters, 180).astype(np.uint8)
            data = np.concatenate([rng.integers(0, letters, 400).astype(np.uint8), part, part[:50], part, part])
            starts = np.flatnonzero(rng.random(data.size - window + 1) < 0.6)
            group = difference_cover._window_groups(data, starts, window)
            pieces = [data[i:i + window].tobytes() for i in starts.tolist()]
            assert len(set(zip(group.tolist(), pieces))) == len(set(pieces)) == group.max() + 1


@pytest.mark.parametrize("hot", [3, 1000])
def test_pieces_of_chunks_match_brute_force(monkeypatch, hot):
    """Null, tied and repeated ids, periodic texts, grams that are cut, sorts of few bytes."""
    monkeypatch.setattr(difference_cover, "GROUP", 700)
    rng = random.Random(hot)
    passages = [" ".join(words(rng, 40)) for _ in range(4)] + ["ab" * 130, "x" * 220]
    rows = [(None if i % 17 == 0 else i // 2, f"{rng.random()} {rng.choice(passages)[rng.randrange(40):]} {rng.choice(passages)}")
            for i in range(120)] + [(3, passages[0]), (3, passages[0]), (90, ""), (4, passages[1][:99])]
    chunks = []
    for number in range(3):
        own = [(k, r) for k, r in enumerate(rows) if zlib.crc32(repr(r).encode()) % 3 == number]
        chunks.append(pa.table({
            "doc_id": pa.array([r[0] for _, r in own], pa.int64()), "text": [r[1] for _, r in own],
            "text_hash": [zlib.crc32(r[1].encode()) - (1 << 31) for _, r in own], "chunk": [number] * len(own)}))
    grams = pa.concat_tables(difference_cover._grams(c, 100, 1) for c in chunks)
    hits = pa.concat_tables(difference_cover._hits(grams.filter(pc.field("bucket") == b), 100, hot, 40) for b in (0, 1))
    pieces = pa.concat_tables(difference_cover._pieces(c, hits.filter(pc.field("chunk") == n), 100, 1)
                              for n, c in enumerate(chunks))
    assert (max(pieces["parts"].to_pylist()) > 1) == (hot == 3)
    later = difference_cover._later(pieces, 100)
    got = []
    for n, chunk in enumerate(chunks):
        cut = difference_cover._cut(chunk, later.filter(pc.field("chunk") == n), 100)
        got += [(t, r["doc_id"], r["n_removed"], r["kept"]) for t, r in zip(chunk["text"].to_pylist(), cut.to_pylist())]
    first, expected = {}, []
    places = [(i is not None, i or 0, p, zlib.crc32(t.encode()), t) for i, t in set(rows) for p in range(len(t) - 99)]
    for place in sorted(places):
        first.setdefault(place[4][place[2]:place[2] + 100], place)
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 99):
            if first[t[p:p + 100]] != (i is not None, i or 0, p, zlib.crc32(t.encode()), t):
                gone[p:p + 100] = b"\1" * 100
        expected.append((t, i, sum(gone), bytes(b for b, g in zip(t.encode(), gone) if not g)))
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_a_frequent_gram_sends_a_bounded_sketch():
    """A chunk sends some hashes of a gram's pieces, however many it has; their number is estimated."""
    rng = random.Random(5)
    line = "".join(rng.choice("abcdefgh") for _ in range(70))
    sent = [difference_cover._grams(pa.table({
        "doc_id": list(range(3000)), "text": [f"{rng.random():.17f}{rng.random():.17f}"[:38] + line for _ in range(3000)],
        "text_hash": list(range(3000)), "chunk": [number] * 3000}), 100, 1) for number in range(4)]
    grams = pa.concat_tables(sent)
    counts = [np.unique(difference_cover._joined(g, np.uint32), return_counts=True)[1].max()
              for g in grams["grams"].to_pylist()]
    assert max(counts) == 2 * difference_cover.SKETCH
    hits = [difference_cover._hits(grams.filter(pc.field("bucket") == b), 100, 2000, 100)
            for b in sorted(set(grams["bucket"].to_pylist()))]
    parts = [np.frombuffer(p, np.int32) for t in hits for p in t["parts"].to_pylist()]
    assert 3000 < max(p.max() for p in parts) < 3500            # 3246 when every piece is counted


def test_suffixes_are_sent_in_pieces(spark, monkeypatch):
    """No row per byte of repeated text (they took 0.33 GB of disk for 1,000 documents)."""
    sent, slices = [], difference_cover._slices

    def counted(distinct, base, keys):
        sent.append(distinct.count())
        return slices(distinct, base, keys)
    monkeypatch.setattr(difference_cover, "_slices", counted)
    rng = random.Random(41)
    passages = [" ".join(words(rng, 80)) for _ in range(20)]
    rows = [(i, f"{rng.random()} {rng.choice(passages)} {rng.random()}") for i in range(200)]
    got = remove_later_copies(frame(spark, rows), 100).collect()
    assert sum(r.n_removed > 300 for r in got) == 180
    assert 0 < sum(sent) < sum(len(t) for _, t in rows) / 20, sent


def test_only_texts_that_may_be_wanted_are_joined(spark, monkeypatch):
    """The join that fetches the texts of candidates gets few other texts, also where Spark
    would not broadcast; a full map of hashes lets all texts through and changes no row."""
    rng = random.Random(33)
    base = words(rng, 60)
    rows = [(i, " ".join(words(rng, 30))) for i in range(100, 400)] + awkward(rng)
    rows += [(1, " ".join(base)), (2, " ".join([*base, "more"])), (2, " ".join([*base, "more"])), (3, " ".join(base[:-1]))]
    passed, whole = [], tensored_minhash.possible

    def counted(texts, wanted):
        out = whole(texts, wanted)
        passed.append((out.count(), {r.text_hash for r in out.collect()} >= {r.text_hash for r in wanted.collect()}))
        return out
    monkeypatch.setattr(tensored_minhash, "possible", counted)

    def found():
        return sorted(map(str, near_duplicates(frame(spark, rows).repartition(4), 3, 85).collect()))
    got = found()
    monkeypatch.setattr(tensored_minhash, "MAP_BITS", 2)
    assert found() == got
    assert passed[0][0] < 40 and passed[0][1] and passed[1] == (sum(i is not None for i, _ in rows), True), passed
    assert {"Row(doc_id=3, n_shingles=57, component_id=1, kept=False)"} <= set(got)
