"""N-gram index of a Parquet table, so that a term search skips files (Q21).

Per data file the index keeps which trigrams its values hold: a bitmap of trigram hashes
(16 KB a file, less where a file holds few).  A term is looked up by its own trigrams; only
files whose bitmaps hold all of them are read, and `search_rows` then decides row by row, so
the index can only save reads, never change a result.  Files the index doesn't know are
always read.  A 128 MB file adds about a ten-thousandth of its size.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.functions.text import qcol
from calibra.operators.search import search_rows
from calibra.sources.io import exists

N, BITS = 3, 1 << 17


#: Spark writes a local file's scheme with one slash or with three.
_LOCAL = "^file:/+"


def _files(df: DataFrame) -> list[str]:
    return [re.sub(_LOCAL, "file:/", f) for f in df.inputFiles()]


def _file() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), _LOCAL, "file:/").alias("archivo")


def _folded(text: Column) -> Column:
    """Text in which everything that a case-insensitive search takes for an ASCII letter is
    that letter (dotless and dotted i, long s, the Kelvin sign)."""
    return F.translate(F.lower(text), "\u0131\u017f\u0307", "is")


def _grams(text: Column) -> Column:
    """Distinct trigrams of ASCII characters.  Others are left out on both sides: their case
    rules differ between a folding and a search."""
    n = F.char_length(text)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n - N + 1, F.lit(1))), lambda i: F.substring(text, i, N))
    return F.array_distinct(F.filter(every, lambda g: (F.char_length(g) == N) & (F.octet_length(g) == N)))


def _place(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BITS).cast("long"))


def _known(spark: SparkSession, index: str) -> list[str]:
    """Names of the files the index holds (one per file, as Spark's own listing of the table)."""
    return [r[0] for r in spark.read.parquet(index).select("archivo").distinct().collect()] if exists(spark, index) else []


def update_index(spark: SparkSession, table: str, index: str) -> int:
    """Index the files of the table that the index doesn't hold yet; returns their number.
    Map-side each task reduces a file to its distinct bits before the shuffle."""
    known = set(_known(spark, index))
    fresh = [f for f in _files(spark.read.parquet(table)) if f not in known]
    if not fresh:
        return 0
    rows = spark.read.option("basePath", table).parquet(*fresh)
    words = F.array(*[_folded(qcol(c).cast("string")) for c in rows.columns])
    bits = (rows.select(_file(), F.explode(words).alias("t")).where("t IS NOT NULL")
            .select("archivo", F.explode(_grams(F.col("t"))).alias("g")).select("archivo", _place(F.col("g")).alias("p")).distinct())
    maps = bits.groupBy("archivo", F.bitmap_bucket_number("p").alias("cubo")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("mapa"))
    # files without any trigram are known too
    names = rows.select(_file()).distinct().select(
        "archivo", F.lit(-1).cast("long").alias("cubo"), F.lit(None).cast("binary").alias("mapa"))
    maps.unionByName(names).write.mode("append").parquet(index)
    return len(fresh)


def candidate_files(spark: SparkSession, table: str, index: str, term: str) -> list[str]:
    """Files that may hold the term (literal, any case)."""
    every = _files(spark.read.parquet(table))
    probe = spark.range(1).select(F.explode(_grams(_folded(F.lit(term)))).alias("g")).select(_place(F.col("g")).alias("p")) \
        .select("p", F.bitmap_bucket_number("p").alias("b"), F.bitmap_bit_position("p").alias("i")).distinct().collect()
    if not probe or not exists(spark, index):
        return list(every)                             # a term of fewer than three ASCII characters
    maps = spark.read.parquet(index)

    def has(r) -> Column:
        byte = F.conv(F.hex(F.substring("mapa", r["i"] // 8 + 1, 1)), 16, 10).cast("int")
        return (F.col("cubo") == r["b"]) & (F.shiftright(byte, r["i"] % 8).bitwiseAND(F.lit(1)) == 1)

    flags = [F.max(F.coalesce(has(r), F.lit(False))).alias(f"h{k}") for k, r in enumerate(probe)]
    held = maps.groupBy("archivo").agg(*flags)
    lacking = {r[0] for r in held.where(~reduce(lambda a, b: a & b, [F.col(f"h{k}") for k in range(len(probe))]))
               .select("archivo").collect()}
    return [f for f in every if f not in lacking]


def search_indexed(spark: SparkSession, table: str, index: str, term: str, name: str = "tabla") -> DataFrame:
    """`search_rows` for a literal term, over the candidate files only."""
    whole = spark.read.parquet(table)
    files = candidate_files(spark, table, index, term)
    rows = spark.read.schema(whole.schema).option("basePath", table).parquet(*files) if files else whole.limit(0)
    return search_rows({name: rows}, term, regex=False)
