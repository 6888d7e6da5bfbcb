"""Findings that came, stayed or went between two audits (set operations with multiplicity)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra import constants as K
from calibra.functions.text import qcol, utrim


def finding_rows(audited: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, falla) of every finding of every row."""
    parts = audited.select(*[qcol(k) for k in keys], F.explode(F.split(
        F.coalesce(qcol(K.FINDINGS).cast("string"), F.lit("")), K.FINDING_SEPARATOR)).alias("p"))
    keep = (utrim(F.col("p")) != F.lit("")) & (F.col("p") != F.lit("nan")) & (utrim(F.col("p")) != F.lit("Sin Errores"))
    return parts.where(keep).select(*[qcol(k) for k in keys], utrim(F.col("p")).alias("falla"))


def finding_changes(before: DataFrame, after: DataFrame, keys: Sequence[str] = (K.COL_SKU,)) -> DataFrame:
    """One row per (keys, finding) of either audit: antes, despues (how often each holds it),
    aparecen (EXCEPT ALL), siguen (INTERSECT ALL), desaparecen (EXCEPT ALL the other way).

    Both audits are tagged and counted in one aggregate: one shuffle instead of a full
    outer join of two, and a key that holds a third of the rows is combined map-side.
    Null keys are one key.  Keys must have the same type in both.
    """
    tagged = finding_rows(before, keys).withColumn("lado", F.lit(0)).unionByName(
        finding_rows(after, keys).withColumn("lado", F.lit(1)))
    counts = tagged.groupBy(*[qcol(k) for k in keys], "falla").agg(
        F.count(F.when(F.col("lado") == 0, 1)).alias("antes"), F.count(F.when(F.col("lado") == 1, 1)).alias("despues"))
    more = F.col("despues") - F.col("antes")
    return counts.select(*[qcol(k) for k in keys], "falla", "antes", "despues",
                         F.greatest(more, F.lit(0).cast("long")).alias("aparecen"), F.least("antes", "despues").alias("siguen"),
                         F.greatest(-more, F.lit(0).cast("long")).alias("desaparecen"))


def change_summary(changes: DataFrame) -> DataFrame:
    """Totals per finding."""
    return changes.groupBy("falla").agg(*[F.sum(c).alias(c) for c in ("aparecen", "siguen", "desaparecen")])
