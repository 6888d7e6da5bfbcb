"""Token counts with a whole-token shortcut (operator 7).

Before any text is read `whole_tokens` proves, from the file alone, which vocabulary strings encode alone as
exactly one token: it replays the merge rules on the string's own bytes and keeps the
strings that end as one piece.  A pre-token in that set counts 1 without merging; only
the others are merged, and their counts are cached per worker.

Special strings inside a text count as one token each and cut the text there, which is
the library's default; no begin or end tokens, no truncation, no padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.pair_merge import PairMerger, read_byte_bpe
from calibra.llm.textblocks import byte_blocks

CACHE_ENTRIES = 1 << 19


class CountModel:
    """Merge rules, proven strings and specials of one tokenizer file, ready to count."""

    def __init__(self, path: str, pattern: str):
        self.merger, vocabulary, specials = read_byte_bpe(path)
        self.proven = whole_tokens(self.merger, vocabulary)
        self.known = dict(self.proven)
        specials = sorted(specials, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.pattern = regex.compile(pattern)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the pre-tokens that are new to this worker are merged together."""
        found, words = [], []
        for text in texts:
            pieces, marks = (text,), 0
            if self.special is not None and (marks := len(self.special.findall(text))):
                pieces = self.special.split(text)
            found.append(marks)
            words.append([w for piece in pieces for w in self.pattern.findall(piece)])
        known = self.known
        new = list({w for ws in words for w in ws if w not in known})
        if len(known) + len(new) > CACHE_ENTRIES + len(self.proven):
            known = self.known = dict(self.proven)
            new = list({w for ws in words for w in ws if w not in known})
        known.update(zip(new, self.merger.count([w.encode() for w in new])))
        return [n + sum(map(known.__getitem__, ws)) for n, ws in zip(found, words)]


def whole_tokens(merger: PairMerger, vocabulary: dict[bytes, int]) -> dict[str, int]:
    """Vocabulary strings proven to encode alone as one token (text -> 1): the merge rules
    are replayed on the bytes of each.  A part of a character is never a pre-token."""
    strings = list(vocabulary)
    proven = {}
    for string, n in zip(strings, merger.count(strings)):
        if n == 1:
            try:
                proven[string.decode("utf-8")] = 1
            except UnicodeDecodeError:
                continue
    return proven


@lru_cache(maxsize=4)
def count_model(path: str, pattern: str) -> CountModel:
    """One model per worker process and file."""
    return CountModel(path, pattern)


def token_counts(docs: DataFrame, tokenizer: str, pattern: str, limit: int = 512,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    `tokenizer`: path of a byte-level BPE file in the tokenizers JSON format, present on
    every executor; `pattern`: its pre-token pattern.  A null or empty text has 0 bytes
    and 0 tokens.  Repeated rows and null ids give one result row each; an empty table
    gives none; other columns of `docs` are never read.  One pass, no shuffle.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = count_model(tokenizer, pattern)
        for batch in batches:
            tokens: list[int] = []
            for row, end, _, _ in byte_blocks(batch.column("text")):
                tokens += model.count(batch.column("text").slice(row, end - row).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
                       F.octet_length(text).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
