"""Tokenisation operators against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from calibra.llm import bpe_scan, mixing_coder, token_count
from calibra.llm.pair_merge import from_ranks, read_ranks
from calibra.llm.textblocks import byte_blocks
from calibra.session import scratch_path

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
PIECES = ["a", "s", "t", "re", "'", "'s", "'ll", "'ve", " ", "  ", "\n", "\t", "\r\n", "1", "23", "!", "...", "é", "中", "　",
          "😀", "x", "d", "²", "̀", "\x85", "​", "٣", "ß", " the", "<|endoftext|>", "\x1c", "\xa0"]


def texts(n=1500):
    rng = random.Random(8)
    out = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(n)]
    return out + ["", "ab" * 5000, " " * 300, "\n" * 200 + "x", "don't'll 'tis I've 'S", "naïve café " * 2000]


@pytest.fixture(scope="module")
def encoder():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def test_transition_scan_finds_the_pattern_s_pre_tokens(encoder):
    model = bpe_scan.ranks(RANKS)
    many = texts()
    for limit in (1 << 21, 500):                       # texts never see each other's state
        got = [ids.tolist() for _, _, buf, offs in byte_blocks(pa.array(many), limit)
               for ids, _ in bpe_scan.encode_block(buf, offs, model.packed)]
        assert got == [encoder.encode_ordinary(t) for t in many]


def test_merging_in_lockstep_equals_merging_alone(encoder):
    merger = from_ranks(read_ranks(RANKS))
    rng = random.Random(9)
    words = [bytes(rng.randrange(256) for _ in range(rng.randrange(40))) for _ in range(300)] + [b"", b"a", b"aaaa" * 60]
    for w, ids in zip(words, merger.packed(words)):
        assert np.frombuffer(ids, "<i4").tolist() == merger._merge_long(w).tolist()


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn(
        "n_tokens", F.lit(-1))


def test_encode_and_decode_round_trip(spark, encoder):
    rows = list(enumerate(texts(200))) + [(7, None), (None, "null id"), (3, "repeated"), (3, "repeated")]
    got = bpe_scan.decode(bpe_scan.encode(frame(spark, rows).repartition(3), RANKS), RANKS).collect()
    assert sorted((r.doc_id or -1, tuple(r.ids), bytes(r.decoded)) for r in got) == sorted(
        (i or -1, tuple(encoder.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert bpe_scan.decode(bpe_scan.encode(frame(spark, []), RANKS), RANKS).count() == 0
    once = bpe_scan.round_trip(frame(spark, rows).repartition(3), RANKS).collect()
    assert sorted((r.doc_id or -1, tuple(r.ids), bytes(r.decoded)) for r in once) == sorted(
        (r.doc_id or -1, tuple(r.ids), bytes(r.decoded)) for r in got)
    assert bpe_scan.round_trip(frame(spark, []), RANKS).count() == 0
    one = bpe_scan.encode(frame(spark, [(1, "it's é 12")]), RANKS).first()
    assert one.offsets == [0, 2, 4, 7]


def test_whole_tokens_are_single_tokens():
    model, library = token_count.count_model(JSON, P.PATTERN), Tokenizer.from_file(JSON)
    assert len(model.proven) > 40_000
    words = [w for w in model.proven if model.pattern.fullmatch(w)]
    assert {len(e.ids) for e in library.encode_batch(words, add_special_tokens=False)} == {1}


def test_token_counts_equal_the_library_s(spark):
    library = Tokenizer.from_file(JSON)
    rows = list(enumerate(texts(300))) + [(5, None), (None, "a b"), (6, "x"), (6, "x")]
    got = token_count.token_counts(frame(spark, rows), JSON, P.PATTERN, limit=20).collect()
    expected = [(i or -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
                for i, t in rows]
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == sorted(expected)
    assert all(r.over_limit == (r.n_tokens > 20) for r in got)
    assert token_count.token_counts(frame(spark, []), JSON, P.PATTERN).count() == 0


@pytest.mark.parametrize("ids", [[], [5], [0] * 5000, list(range(3000)) * 3], ids=len)
def test_range_coder_round_trip(ids):
    blocks = mixing_coder.encode_ids(np.array(ids, np.int64))
    assert mixing_coder.decode_ids(blocks).tolist() == ids
    if len(ids) > 1000:
        assert sum(map(len, blocks)) < 2 * len(ids)


def test_range_coder_uneven_blocks_and_damage():
    rng = np.random.default_rng(1)
    ids = (rng.pareto(0.7, 9001) * 2).astype(np.int64) % 50_257
    blocks = mixing_coder.encode_ids(ids)
    assert len(blocks) == 3 and np.array_equal(mixing_coder.decode_ids(blocks), ids)
    assert np.array_equal(mixing_coder.decode_ids(blocks[1:2]), ids[4096:8192])       # blocks stand alone
    broken = bytearray(blocks[0])
    broken[200] ^= 1
    with pytest.raises(ValueError):
        mixing_coder.decode_ids([bytes(broken)])
    with pytest.raises(ValueError):
        mixing_coder.encode_ids(np.array([mixing_coder.IDS]))


def test_coded_table_reads_back_in_id_order(spark, tmp_path):
    library = Tokenizer.from_file(JSON)
    rows = [(i * 7 % 301, t) for i, t in enumerate(texts(120))] + [(400, None), (401, "")]
    path = scratch_path(spark, f"coded-{tmp_path.name}-{hashlib.md5(str(tmp_path).encode()).hexdigest()[:6]}")
    mixing_coder.write_coded(frame(spark, rows), path, JSON)
    got = mixing_coder.ids_crc32(mixing_coder.read_coded(spark, path)).collect()
    start, expected = 0, []
    for i, t in sorted(rows):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((i, start, ids.size, zlib.crc32(ids.tobytes())))
        start += ids.size
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == expected
    empty = path + "-empty"
    mixing_coder.write_coded(frame(spark, []), empty, JSON)
    assert mixing_coder.read_coded(spark, empty).count() == 0


def test_coded_table_keeps_null_tied_and_repeated_rows(spark, tmp_path):
    library = Tokenizer.from_file(JSON)
    rows = [(None, "no id"), (None, None), (3, "b c"), (3, "a"), (3, "a"), (1, ""), (2, "long word " * 3000)]
    path = scratch_path(spark, f"tied-{hashlib.md5(str(tmp_path).encode()).hexdigest()}")
    docs = frame(spark, rows).selectExpr("*", "1 AS part", "'x' AS ids", "0L AS start")
    mixing_coder.write_coded(docs.repartition(3), path, JSON)
    got = mixing_coder.read_coded(spark, path).collect()
    assert sorted(((r.doc_id or -1), tuple(r.ids)) for r in got) == sorted(
        (i or -1, (*library.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):          # no gaps, ids ascending, null first
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    ids = [r.doc_id or -1 for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids)


@pytest.mark.parametrize("distinct", [1, 2, 16, 17, 256, 257, 300, 4096])
def test_range_coder_lists_of_any_length(distinct):
    rng = np.random.default_rng(distinct)
    alphabet = np.sort(rng.choice(mixing_coder.IDS, distinct, replace=False))
    ids = np.concatenate([rng.permutation(alphabet), rng.choice(alphabet, 9000 - distinct)])
    ids = np.concatenate([ids, np.repeat(ids[0], 5000), rng.choice(alphabet[:max(distinct // 8, 1)], 4097)])
    assert np.array_equal(mixing_coder.decode_ids(mixing_coder.encode_ids(ids)), ids)


def test_three_orders_beat_the_single_ones():
    """Ids that the last two determine cost next to nothing; ids of a skewed distribution
    cost about its entropy."""
    rng = np.random.default_rng(7)
    pattern = rng.integers(0, 50_000, 40)
    repeating = np.tile(pattern, 102)[:4096]
    assert len(mixing_coder.encode_ids(repeating)[0]) < 450
    skewed = rng.choice([5, 900, 40_000, 7], 4096, p=[0.85, 0.05, 0.05, 0.05])
    entropy = 4096 * (0.85 * np.log2(1 / 0.85) + 0.15 * np.log2(20)) / 8
    assert len(mixing_coder.encode_ids(skewed)[0]) < 1.15 * entropy + 50


def test_an_id_takes_four_mixed_symbols_at_most(monkeypatch):
    """Blocks go through the coder in lockstep: a decision and three digits for all of them."""
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.permutation(4096), rng.choice(40, 4096), rng.choice(900, 4096), rng.choice(3000, 700)])
    calls = []
    narrow = mixing_coder._Coder.narrow
    monkeypatch.setattr(mixing_coder._Coder, "narrow", lambda *a: calls.append(1) or narrow(*a))
    blocks = mixing_coder.encode_ids(ids)
    assert len(calls) <= 4 * 4096
    assert np.array_equal(mixing_coder.decode_ids(blocks), ids) and len(calls) <= 8 * 4096


def test_zipf_words_cost_about_their_entropy():
    """Each id's rank is drawn alone, so orders 1 and 2 must not cost more than they give."""
    rng = np.random.default_rng(5)
    chance = 1 / np.arange(1, 501)
    chance /= chance.sum()
    ids = np.sort(rng.choice(50_000, 500, replace=False))[rng.choice(500, 4096 * 8, p=chance)]
    entropy = -(chance * np.log2(chance)).sum() / 8
    assert sum(map(len, mixing_coder.encode_ids(ids))) < ids.size * (1.1 * entropy + 0.14)


def test_sums_in_one_pass_equal_those_of_the_ids(spark, tmp_path):
    rows = [(i * 7 % 61, t) for i, t in enumerate(texts(60))] + [(None, "a\x00b"), (3, None), (3, ""), (70, "a" * 7 + " \x00" * 9)]
    path = scratch_path(spark, f"sums-{hashlib.md5(str(tmp_path).encode()).hexdigest()}")
    mixing_coder.write_coded(frame(spark, rows).repartition(3), path, JSON)
    expected = sorted(map(str, mixing_coder.ids_crc32(mixing_coder.read_coded(spark, path)).collect()))
    assert sorted(map(str, mixing_coder.read_sums(spark, path).collect())) == expected


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_ids_of_words_looked_up_once_a_block_equal_the_library_s(limit):
    library, own = Tokenizer.from_file(JSON), mixing_coder.LibraryIds(JSON)
    many = texts(500) + ["a\x00b\x00", "\x00", " \x00\x00 \x00", "abcdefg", "abcdefgh", " abcdefg" * 3]
    got = [ids.tolist() for _, _, buf, offs in byte_blocks(pa.array(many), limit) for ids in own.texts(buf, offs)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in many]


def test_no_part_of_few_blocks_follows_a_full_one(monkeypatch):
    monkeypatch.setattr(mixing_coder, "LANES", 4)
    assert [mixing_coder._parts(n) for n in (0, 1, 4, 5, 9)] == [
        [], [(0, 1)], [(0, 4)], [(0, 2), (2, 5)], [(0, 3), (3, 6), (6, 9)]]
    ids = np.random.default_rng(2).choice(700, 4096 * 5 + 10)
    assert np.array_equal(mixing_coder.decode_ids(mixing_coder.encode_ids(ids)), ids)
