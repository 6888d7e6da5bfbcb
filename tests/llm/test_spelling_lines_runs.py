"""Spelling variants, line dedup and periodic runs against brute force, with awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.llm import frequency_trie, line_stream, periodic_runs, queries

CLASHES = ("word", "n", "pos", "h1", "h2", "keep", "text_hash", "start", "length", "period", "subtree", "role", "line", "key")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in CLASHES})


@pytest.fixture
def narrow(spark):
    """Tiny Arrow batches and many ranges, so that state crosses batches and ranges."""
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "13"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


# -- operator 11 ----------------------------------------------------------------

def brute_near(words):
    by = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by[w[:i], w[i + 1:]].add(w)
    near = collections.defaultdict(set)
    for (a, b), group in by.items():
        for w in group:
            near[w] |= group - {w}
            if a + b in words:
                near[w].add(a + b)
                near[a + b].add(w)
    return near


def brute_variants(counts, ratio=5):
    near, form = brute_near(counts), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return out


def vocabulary(rng, size):
    """Words with many neighbours, accents, equal vectors (anagrams), chains of forms."""
    letters = "abcdeqstué"
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(6, 9))) for _ in range(size)}
    for w in list(words)[:size // 2]:
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i + 1:], w[:i] + rng.choice(letters) + w[i:],
                  "".join(rng.sample(w, len(w)))}
    words |= {"long" * 500, "long" * 499 + "lung", "long" * 500 + "x", "aaaaaa", "aaaaaaa", "aaaaaaaa", "qaaaaa"}
    return {w: rng.choice([5, 6, 25, 130, 700, 5000]) for w in words if w}


@pytest.mark.parametrize("subtree_words", [8192, 40])
def test_variants_match_brute_force_whatever_the_tries(spark, subtree_words):
    counts = vocabulary(random.Random(subtree_words), 700)
    table = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("role", F.lit(1))
    got = frequency_trie.variants(table, subtree_words=subtree_words).collect()
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got]
    assert len(rows) == len(set(rows)) and set(rows) == brute_variants(counts)


def test_no_trie_takes_more_than_its_share(spark):
    """Words of one vector (the hottest subtree possible) are dealt to several tries."""
    rng = random.Random(5)
    words = list({"".join(rng.sample("abcdefghij", 10)) for _ in range(600)})
    counts = dict.fromkeys(words, 9)
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = frequency_trie.near_words(table, subtree_words=50).groupBy("word").count().collect()
    near = brute_near(counts)
    assert {r["word"]: r["count"] for r in got} == {w: len(s) for w, s in near.items() if s}


def brute_words(rows):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_word_counts_lose_letters_as_the_rule_says(spark):
    rng = random.Random(8)
    bag = ["Straße", "ÉCOLES", "écoles", "banana", "bananas", "x", "señorita", "mañanas", "a" * 3000, "d'accord", "naïve×÷ÿ"]
    rows = [(i, " ".join(rng.choices(bag, k=rng.randrange(60)))) for i in range(-3, 120)]
    rows += [(None, "banana " * 40), (7, None), (8, ""), (9, "1 2 3"), rows[5], rows[5]]
    table = frame(spark, rows)
    got = frequency_trie.word_counts(table, rewrite=queries.drop_letter).collect()
    assert {r.word: r.n for r in got} == brute_words(rows)
    whole = frequency_trie.variants(frequency_trie.word_counts(table, rewrite=queries.drop_letter)).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in whole} == brute_variants(brute_words(rows))


def test_variants_of_nothing(spark):
    assert frequency_trie.variants(frequency_trie.word_counts(frame(spark, [(1, None)]))).count() == 0
    assert frequency_trie.word_counts(frame(spark, [])).count() == 0


def test_one_edit():
    near = frequency_trie.one_edit
    assert near("abc", "abcd") and near("abc", "xabc") and near("abc", "abxc") and near("abc", "abd") and near("", "a")
    assert not near("abc", "abc") and not near("abc", "acb") and not near("abc", "abcde") and not near("abc", "axcd")


# -- operator 12 ----------------------------------------------------------------

def brute_lines(rows, least_chars=20, least_docs=3):
    low = float("-inf")
    lines = [[(x, x.strip(" \t\n\x0b\f\r").translate(FOLD)) for x in (t or "").split("\n")] for _, t in rows]
    holders = collections.defaultdict(set)
    for (doc, _), ls in zip(rows, lines):
        for _, k in ls:
            if len(k) >= least_chars:
                holders[k].add(low if doc is None else doc)
    out = []
    for (doc, _), ls in zip(rows, lines):
        keep = [x for x, k in ls if len(holders.get(k, ())) < least_docs or max(holders[k]) == (low if doc is None else doc)]
        out.append((doc, len(ls), len(ls) - len(keep), "\n".join(keep)))
    return collections.Counter(out)


def awkward_lines(rng):
    hot = "  This line is held by a third of all documents\t"
    pool = [f"shared line number {i} of some length" for i in range(40)] + ["short", "", "ÉTÉ À LA PLAGE AVEC MOI", "été à la plage avec moi"]
    rows = [(i, "\n".join(([hot] if i % 3 == 0 else []) + rng.choices(pool, k=rng.randrange(9)) + [f"own line of document {i}, long"]))
            for i in range(300)]
    rows += [(None, hot), (None, "a\n" + hot), (5, None), (6, ""), (7, "\n\n"), rows[3], rows[3], (3, "another text\n" + hot),
             (1000, "\n".join([pool[0]] * 500)), (1001, (pool[1].upper() + "\r\n") * 300), (1002, "x" * 200000 + "\n" + pool[2])]
    rows += [(None, "two null rows hold this line\n" * 2), (None, "two null rows hold this line"), (2000, "two null rows hold this line"),
             (2001, "exactly two documents hold it"), (2002, "Exactly two documents hold it")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("least_docs", [3, 2, 5])
def test_lines_match_brute_force(narrow, least_docs):
    rows = awkward_lines(random.Random(least_docs))
    docs = frame(narrow, rows).repartition(4)
    maps = line_stream.keep_bitmaps(docs, least_docs=least_docs)
    got = line_stream.apply_bitmaps(docs, maps).collect()
    assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == brute_lines(rows, least_docs=least_docs)
    for m in maps.collect():                    # the bitmap alone tells which lines go
        bits = np.unpackbits(np.frombuffer(zlib.decompress(m.keep), np.uint8), bitorder="little")
        assert int((bits == 0).sum()) == m.n_dropped > 0


def test_lines_of_nothing(spark):
    none = frame(spark, [])
    assert line_stream.keep_bitmaps(none).count() == 0
    assert line_stream.apply_bitmaps(none, line_stream.keep_bitmaps(none)).count() == 0
    empty = frame(spark, [(1, None), (2, "")])
    got = line_stream.apply_bitmaps(empty, line_stream.keep_bitmaps(empty)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == [(1, 1, 0, ""), (2, 1, 0, "")]


def test_only_hashes_are_shuffled(spark):
    """The range shuffle holds hashes, ids and positions, never a line."""
    plan = line_stream.line_rows(frame(spark, [(1, "x")]), 20, "doc_id", "text")
    assert {f.name: f.dataType.simpleString() for f in plan.schema} == {
        "h1": "bigint", "h2": "bigint", "doc_id": "bigint", "text_hash": "bigint", "pos": "int"}


# -- operator 13 ----------------------------------------------------------------

def brute_runs(words, least=6, periods=4):
    found = {}
    for p in range(1, len(words) // periods + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - s + p >= max(least, periods * p):
                found.setdefault((s, i - s + p), p)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc, text, planted):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode())
    if planted and doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def periodic_rows(rng):
    rows = []
    for i in range(-2, 150):
        words = [rng.choice("abcdefgh")[:1] * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 3, 5, 6, 40, 120, 300]))]
        if i % 4 == 0:
            unit = words[:rng.randrange(1, 9)]
            words = words + unit * rng.randrange(1, 30) + words[:3] + unit * 4
        rows.append((i, rng.choice([" ", "\n", "\t  "]).join(words)))
    rows += [(None, "la " * 50), (200, None), (201, ""), (202, " \t\n"), (203, "día ñandú 中文 " * 30), (204, "a b " * 12000),
             (205, " ".join(["x"] * 5)), (206, " ".join(["x"] * 6)), rows[8], rows[8]]
    return rows


def test_runs_match_brute_force(spark):
    rows = periodic_rows(random.Random(13))
    got = queries.repeat_tail(frame(spark, rows))
    found = periodic_runs.periodic_runs(got).collect()
    assert len(found) == len(rows)
    # the registered query's columns over the same rows
    made = collections.Counter(tuple(r) for r in queries.run_digests(periodic_runs.periodic_runs(got)).collect())
    assert made == collections.Counter(brute_row(d, t, True) for d, t in rows)
    plain = collections.Counter(tuple(r) for r in queries.run_digests(periodic_runs.periodic_runs(frame(spark, rows))).collect())
    assert plain == collections.Counter(brute_row(d, t, False) for d, t in rows)


def test_extensions_reach_far_beyond_the_direct_comparison():
    """One period of a thousand words, and two long stretches that differ by one word."""
    unit = list(range(1000))
    words = np.array(unit * 5 + [7] + unit * 6 + [8, 8], np.uint64)
    runs = [r.tolist() for r in periodic_runs.find_runs(words, np.array([0, words.size]))]
    assert list(zip(*runs)) == brute_runs(words.tolist())


def test_runs_of_nothing(spark):
    assert periodic_runs.periodic_runs(frame(spark, [])).count() == 0
