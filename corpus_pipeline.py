"""Corpus pipeline: from raw documents to token ids, in five stages.

toxicity -> exact dedup -> MinHash near-dedup -> benchmark decontamination -> BPE.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of
`documents`; the last returns the encoded corpus.  `run` writes each stage's rows as
Parquet and rereads them, so a stage starts from a table, never from a long lineage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm import bpe_scan, content_sort, latent_retrieval, mil_toxicity, tensored_minhash
from calibra.llm.learning import fold
from calibra.llm.scratch import saved
from calibra.llm.shipping import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of `docs`, doesn't reject
    (null and empty texts stay).  Training rows: crc32(doc_id) mod 5 is not 0."""
    ship(spark)
    model = mil_toxicity.train(docs, _table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return mil_toxicity.drop_toxic(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal whitespace-normalised texts, the one with the smallest id
    (of repeated rows one; null and empty texts are equal)."""
    ship(spark)
    return content_sort.keep_first_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on shingles of five words, the
    one with the smallest id.  Wordless texts and null ids stay; rows that share an id are
    judged by their own text."""
    ship(spark)
    return tensored_minhash.drop_near_copies(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or paraphrased; null ids and rows
    that share an id are judged by their own text."""
    ship(spark)
    return latent_retrieval.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 (digest of the bytes the ids decode to) of every
    row, repeated rows and null ids included; null and empty texts have no ids."""
    ship(spark)
    decoded = bpe_scan.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                          F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encoding),
]

#: SQL can't express the classifier, the latent search or the merges; tests/llm compares
#: the run with a brute-force version on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table; the encoded corpus."""
    rows = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = saved(stage(spark, rows, sf_dir), "stage-" + name.replace(" ", "-"))
    return rows
