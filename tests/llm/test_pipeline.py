"""The corpus pipeline on a small table: every stage's decisions take effect."""

import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline
from calibra.llm import latent_retrieval, mil_toxicity, tensored_minhash, textblocks
from calibra.llm.pair_merge import read_ranks
from calibra.llm.queries import ORACLE, QUERIES


def test_queries_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(ORACLE) <= set(QUERIES) and [n for n, _ in corpus_pipeline.STAGES][-1] == "byte-level BPE"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("bcdfglmnprstaeiou") for _ in range(rng.randrange(2, 8))) for _ in range(4000)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    def text(w):
        return " ".join(" ".join(w[i:i + 9]).capitalize() + "." for i in range(0, len(w), 9))
    rows, labels, expected = [], [], {}
    for i in range(240):
        w = prose(60)
        if i % 6 == 0:
            w[20] = "grumblefoot"
        rows.append((i, text(w), "en", "s", 1))
        labels.append((i, 1, int(i % 6 == 0)))
        if i % 6:
            expected[i] = rows[-1][1]
    items = [(i, text(prose(30))) for i in range(12)]
    near = expected[1].split()
    near[30] = "other"
    rows += [(500, expected[2], "en", "s", 1), (501, "  " + expected[2].replace(" ", "  "), "en", "s", 1),
             (502, " ".join(near), "en", "s", 1), (503, text(prose(20)) + " " + items[4][1], "en", "s", 1),
             (504, None, None, None, None), (505, "", "en", "s", 0), (3, expected[3], "en", "s", 1)]
    expected[501] = rows[-6][1]                # an outer blank makes it another text; near dedup takes it
    del expected[501]
    expected[504] = ""
    path = str(tmp_path_factory.mktemp("corpus"))
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
                               ("labels", labels, "doc_id long, quality int, toxic int"),
                               ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    return path, expected


def test_pipeline_keeps_exactly_the_clean_documents(spark, folder):
    path, expected = folder
    encoder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")),
                                special_tokens={})
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted((r.doc_id, tuple(r.ids), r.n_tokens, r.decoded_sha256) for r in got) == sorted(
        (i, tuple(ids := encoder.encode_ordinary(t)), len(ids), hashlib.sha256(t.encode()).hexdigest())
        for i, t in expected.items())


def test_stages_return_the_columns_of_documents(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs.limit(0), path)
        assert out.columns == docs.columns and out.count() == 0, name


def test_decontamination_judges_null_and_shared_ids_by_their_text(spark, folder):
    path, _ = folder
    item = spark.read.parquet(f"{path}/benchmark.parquet").where("item_id = 4").first().text
    clean = "Nothing of the kind is said here, " * 9
    rows = [(None, item), (None, clean), (7, f"{clean} {item}"), (7, clean), (8, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.decontamination(spark, docs, path)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(
        [(None, clean), (7, clean), (8, None), (None, None)], key=str)


def test_a_worker_takes_a_batch_in_small_blocks(monkeypatch):
    """What a stage's task holds at once for an Arrow batch of 4 MB of text, powers that stay
    with the worker included: an executor has two workers beside its JVM."""
    monkeypatch.setattr(textblocks, "_POWERS", {})
    rng = random.Random(3)
    words = ["".join(rng.choice("bcdfglmnprstaeiou") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=300)) + "." for _ in range(2200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2200)), pa.array(range(2200)), pa.array(texts)],
                                       ["doc_id", "text_hash", "text"])
    assert sum(map(len, texts)) > 1 << 21
    model = mil_toxicity.MilModel(np.zeros(mil_toxicity.EMPTY + 1), 0.0, 0.0)

    def scored():
        for _, _, buf, offs in textblocks.byte_blocks(batch.column("text")):
            yield model.score(buf, offs)[0].size

    stages = {"toxicity": scored, "signatures": lambda: tensored_minhash._signature_batches(5, 10)(iter([batch])),
              "terms": lambda: latent_retrieval._blocks(iter([batch]))}
    for name, stage in stages.items():
        tracemalloc.start()
        for _ in stage():
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 64 << 20, (name, peak)
