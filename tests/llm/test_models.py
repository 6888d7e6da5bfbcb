"""Trained operators and the latent search on small tables with known answers."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from calibra.llm import latent_retrieval, mil_toxicity, ri_quality
from calibra.llm.latent_retrieval import lcs_length, position_masks
from calibra.llm.learning import fold

ALL = "doc_id IS NOT NULL"


def sentence(rng, n=8):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 7))) for _ in range(n)).capitalize() + "."


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn(
        "label", F.lit(9))


def test_toxicity_learns_from_documents_and_finds_the_sentence(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        body = [sentence(rng) for _ in range(5)]
        if i % 3 == 0:
            body[2] = f"{sentence(rng, 3)[:-1]} grumblefoot {sentence(rng, 2)}"
        rows.append((i, " ".join(body)))
        labels.append((i, int(i % 3 == 0)))
    labels += [(0, None), (None, 1), (0, 1)]
    rows += [(1000, None), (1001, ""), (1002, "... !!"), (None, "Grumblefoot!"), (5, rows[5][1]), (1003, "x " * 200_000)]
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = mil_toxicity.train(docs, known, fold(F.col("doc_id"), 5) != 0)
    got = mil_toxicity.toxicity(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert np.mean([by_id[i].predicted == (i % 3 == 0) for i in range(300)]) > 0.97
    hit = by_id[3]
    texts = {i: t for i, t in rows}
    assert [texts[3].encode()[s.start:s.end].decode().count("grumblefoot") for s in hit.offending] == [1]
    assert by_id[1000].predicted == by_id[1001].predicted == by_id[1002].predicted == 0 and by_id[None].predicted == 1
    kept = mil_toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_models_without_labels_or_rows(spark):
    docs, none = frame(spark, [(1, "Uno dos."), (2, None)]), spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert {r.predicted for r in mil_toxicity.toxicity(docs, mil_toxicity.train(docs, none, ALL)).collect()} == {0}
    assert ri_quality.quality(docs, ri_quality.train(docs, none, ALL)).count() == 2
    empty = frame(spark, [])
    assert mil_toxicity.toxicity(empty, mil_toxicity.train(empty, none, ALL)).count() == 0
    assert ri_quality.quality(empty, ri_quality.train(empty, none, ALL)).count() == 0


def test_quality_separates_prose_from_junk(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        text = " ".join(sentence(rng) for _ in range(4))
        if i % 4 == 0:
            text = " ".join(w + rng.choice(["%%%", "$$$"]) for w in text.split())
        rows.append((i, text))
        labels.append((i, int(i % 4 != 0)))
    rows += [(900, None), (901, ""), (None, rows[1][1]), (3, rows[3][1])]
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    held = fold(F.col("doc_id"), 4) == 2
    model = ri_quality.train(docs, known, ~held)
    got = ri_quality.quality(docs, model).withColumn("held", held).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    right = [r.predicted == (r.doc_id % 4 != 0) for r in got if r.held and r.doc_id is not None and r.doc_id < 400]
    assert len(right) > 50 and np.mean(right) > 0.97
    assert 0.25 <= model.temperature <= 8


def test_context_vectors_add_up_over_partitions(spark):
    rng = random.Random(3)
    docs = frame(spark, [(i, sentence(rng, 30)) for i in range(60)])
    one = ri_quality.context_vectors(docs.coalesce(1))
    assert np.allclose(one, ri_quality.context_vectors(docs.repartition(7)), atol=1e-6) and one.any()


def test_lcs_matches_dynamic_programming():
    rng = random.Random(4)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert lcs_length(position_masks(a), len(a), b) == table[-1][-1]


def test_contamination_verbatim_paraphrased_and_clean(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("bcdfglmnprstaeiou") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]

    def prose(n):
        return [rng.choice(vocabulary[:60] if rng.random() < 0.5 else vocabulary) for _ in range(n)]
    items = [(i, " ".join(prose(15 + 2 * i))) for i in range(20)]
    rows, leaks = [(i, " ".join(prose(200))) for i in range(150)], set()
    for i, text in items:
        whole = text.split()
        rows.append((1000 + i, " ".join(prose(37 + i) + whole + prose(90))))
        light = list(whole)
        for j in range(0, len(light), 6):                  # every sixth word is another one
            light[j] = rng.choice(vocabulary)
        rows.append((2000 + i, " ".join(prose(11 + i) + light + prose(50))))
        rows.append((3000 + i, " ".join(whole)))
        leaks |= {(base + i, i) for base in (1000, 2000, 3000)}
    rows += [(5000, None), (5001, ""), (None, items[3][1]), (3000, items[0][1])]
    bench = spark.createDataFrame(items + [(77, None), (78, " "), (None, "x y")], "item_id long, text string")
    got = latent_retrieval.contaminated(frame(spark, rows).repartition(3), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.doc_id is not None} == leaks
    assert [r.item_id for r in got if r.doc_id is None] == [3]
    assert latent_retrieval.contaminated(frame(spark, rows), bench.limit(0)).count() == 0
    assert latent_retrieval.contaminated(frame(spark, []), bench).count() == 0


def invented(rng, n):
    return ["".join(rng.choice("bcdfglmnprstaeiou") for _ in range(rng.randrange(2, 8))) for _ in range(n)]


def edited(rng, words, vocabulary, step):
    """`words` with every step-th word another one (0: none)."""
    return [rng.choice(vocabulary) if step and j % step == 0 else w for j, w in enumerate(words)]


def test_contamination_by_items_of_one_word(spark):
    rng = random.Random(17)
    vocabulary = invented(rng, 3000)
    words = [f"lonely{k}" for k in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(120))) for i in range(60)]
    rows += [(100, words[0]), (101, "Lonely1!"), (102, f"{rows[0][1]} {words[2]} {rows[1][1]}"),
             (103, " ".join(words)), (104, "lonely"), (105, f"{words[5]} {words[5]}"), (None, words[7]), (106, "lonely8x")]
    bench = spark.createDataFrame([*enumerate(words), (900, " ".join(rows[3][1].split()[20:45])), (901, "lonely9 absent")],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in latent_retrieval.contaminated(frame(spark, rows), bench).collect()}
    assert got == {(100, 0), (101, 1), (102, 2), (105, 5), (None, 7), (3, 900)} | {(103, k) for k in range(300)}


def latent_matches(texts, items):
    """Matches of a model fitted without Spark, and the words of the texts."""
    joined = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    hashes, cuts = latent_retrieval.term_hashes(np.frombuffer(joined, np.uint8), offsets)
    model = latent_retrieval.Latent(items)
    model.idf = np.ones(model.terms.size)
    row, term, first = model.entries(hashes, cuts, latent_retrieval.PASSAGE)
    pairs = np.unique(row * (model.terms.size + 1) + term)
    model.weigh(np.bincount(pairs % (model.terms.size + 1), minlength=model.terms.size), int(first[-1]))
    test = np.random.default_rng(1).normal(size=(model.terms.size, 16))
    model.settle(np.zeros_like(test), test)
    return list(model.matches(hashes, cuts)), [hashes[a:b].tolist() for a, b in zip(cuts, cuts[1:])]


def item_of(k, words):
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    return latent_retrieval.Item(k, latent_retrieval.term_hashes(raw, np.array([0, raw.size]))[0].tolist())


def test_runs_of_windows_change_nothing_and_bound_the_memory(monkeypatch):
    rng = random.Random(18)
    vocabulary = invented(rng, 4000)
    kept = [[rng.choice(vocabulary) for _ in range(n)] for n in (1, 2, 3, 9, 20, 28, 29, 60, 130)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(40)) + " " for _ in range(30)]
    for words in kept:
        body = [rng.choice(vocabulary) for _ in range(900)]
        at = rng.randrange(900)
        texts.append(" ".join(body[:at] + words + body[at:]) + " ")
    items = [item_of(k, words) for k, words in enumerate(kept)]
    whole = latent_matches(texts, items)[0]
    assert {(30 + k, k) for k in range(len(kept))} <= {m[:2] for m in whole}
    for run in (1, 5, 64):
        monkeypatch.setattr(latent_retrieval, "RUN", run)
        got = latent_matches(texts, items)[0]
        assert [m[:2] + m[3:] for m in got] == [m[:2] + m[3:] for m in whole]
        assert np.allclose([m[2] for m in got], [m[2] for m in whole], atol=1e-4)
    monkeypatch.undo()
    long = [" ".join(rng.choice(vocabulary) for _ in range(400_000)) + " " + " ".join(kept[4])]
    many = [item_of(k, [rng.choice(vocabulary) for _ in range(20)]) for k in range(190)] + [items[4]]
    many[-1].item_id = 777
    tracemalloc.start()
    found, _ = latent_matches(long, many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 777 in {m[1] for m in found}
    assert peak < 120 * len(long[0])          # arrays per word; latent rows of all windows took far more


def test_search_against_brute_force_subsequences_over_every_window():
    rng = random.Random(19)
    vocabulary = invented(rng, 2500)
    kept = [[rng.choice(vocabulary) for _ in range(rng.randrange(12, 50))] for _ in range(24)]
    texts = []
    for k, words in enumerate(kept):
        for step in (0, 6, 3):
            around = [[rng.choice(vocabulary) for _ in range(45)] for _ in range(2)]
            texts.append(" ".join(around[0] + edited(rng, words, vocabulary, step) + around[1]) + " ")
    items = [item_of(k, words) for k, words in enumerate(kept)]
    found, rows = latent_matches(texts, items)
    found = {m[:2] for m in found}
    expected, possible = set(), set()
    for t, text in enumerate(rows):
        for item in items:
            n = len(item.words)
            if len(set(text) & set(item.words)) < latent_retrieval.LCS * len(set(item.words)) - 1:
                continue                           # too few words in common for either share
            shares = [item.checked(text[a:a + n]) for a in range(max(1, len(text) - n + 1))]
            if any((w >= latent_retrieval.LCS and x >= latent_retrieval.ANSWER) or w >= latent_retrieval.STRONG for w, x in shares):
                expected.add((t, item.item_id))
            if lcs_length(item.masks, n, text) >= latent_retrieval.LCS * n:
                possible.add((t, item.item_id))
    assert len(expected) > 60 and len(found & expected) >= 0.98 * len(expected)
    assert found <= possible


def test_contamination_by_long_items(spark):
    rng = random.Random(8)
    vocabulary = invented(rng, 6000)
    items = [(k, [rng.choice(vocabulary) for _ in range(n)])
             for k, n in enumerate(n for n in (49, 150, 300, 1000) for _ in range(4))]
    rows, leaks = [(i, " ".join(rng.choice(vocabulary) for _ in range(1500))) for i in range(40)], set()
    for k, words in items:
        for base, step in ((1000, 0), (2000, 6), (3000, 3)):
            around = [[rng.choice(vocabulary) for _ in range(rng.randrange(20, 400))] for _ in range(2)]
            rows.append((base + k, " ".join(around[0] + edited(rng, words, vocabulary, step) + around[1])))
            leaks.add((base + k, k))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = latent_retrieval.contaminated(frame(spark, rows).repartition(4), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leaks and len(got) == len(leaks)
    assert all(r.lcs > 0.95 for r in got if r.doc_id < 2000)


def test_every_query_is_spanned_in_a_large_benchmark(spark):
    rng = random.Random(9)
    vocabulary = invented(rng, 5000)
    items = [latent_retrieval.Item(k, [hash(rng.choice(vocabulary)) % 2 ** 62 for _ in range(rng.randrange(15, 60))])
             for k in range(1000)]
    docs = frame(spark, [(i, " ".join(rng.choice(vocabulary) for _ in range(300))) for i in range(40)])
    model = latent_retrieval._fitted(docs, items)
    known = {}
    for group in model.groups:
        assert len(group.places) <= latent_retrieval.GROUP
        for (k, a), length in zip(group.places, group.length):
            words = items[k].words[a:items[k].cuts[items[k].cuts.index(a) + 1]]
            at = model.locate(np.array(words, np.uint64))
            full = np.linalg.norm(np.bincount(at, minlength=model.terms.size) * model.idf)
            known[k, a] = length / full
    assert len(known) == sum(len(i.cuts) - 1 for i in items) and min(known.values()) > 0.999


def test_contamination_by_items_cut_at_the_front_or_the_end(spark):
    rng = random.Random(10)
    vocabulary = invented(rng, 4000)
    items = [(k, [rng.choice(vocabulary) for _ in range(n)]) for k, n in enumerate((16, 24, 40, 56, 120, 400))]
    rows, leaks = [], set()
    for k, words in items:
        cut = len(words) // 4
        for base, part in ((1000, words[:-cut]), (2000, words[cut:])):
            around = [[rng.choice(vocabulary) for _ in range(80)] for _ in range(2)]
            rows.append((base + k, " ".join(around[0] + part + around[1])))
            leaks.add((base + k, k))
    rows += [(i, " ".join(rng.choice(vocabulary) for _ in range(300))) for i in range(40)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = latent_retrieval.contaminated(frame(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leaks
