"""Uniqueness markers: is the normalised key of a row seen more than once?

Plan per distinct key set:  key projection -> partial+final count (map-side combine
absorbs hot keys, including the blank key) -> keep count > 1 -> left join back on
the normalised key.  The repeated-key side is only the keys that repeat, so AQE
turns the join into a broadcast when its measured size is small; otherwise a
sort-merge join runs on (key, salt), where keys above a row threshold are answered
from a bounded broadcast and spread by salt.  No window: a window would sort full
rows and put each hot key in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.functions.text import norm_key, qcol
from calibra.operators.skew import COUNT, HOT_KEY_ROWS, flag_by_key, key_counts


def _key_names(i: int, n: int) -> list[str]:
    return [f"__calibra_k{i}_{j}" for j in range(n)]


def key_projection(df: DataFrame, keys: Sequence[str], names: Sequence[str],
                   reference: DataFrame | None = None) -> DataFrame:
    """Normalised keys of `df` (plus those of an optional reference frame)."""
    proj = df.select([norm_key(qcol(k)).alias(n) for k, n in zip(keys, names)])
    if reference is not None:
        ref_cols = set(reference.columns)
        proj = proj.unionByName(reference.select(
            [(norm_key(qcol(k)) if k in ref_cols else F.lit("")).alias(n) for k, n in zip(keys, names)]))
    return proj


def add_duplicate_markers(df: DataFrame, key_sets: Sequence[Sequence[str]], marker_name,
                          reference: DataFrame | None = None,
                          hot_key_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Add one boolean column per key set: true when the row's normalised key repeats.

    Keys with more than `hot_key_rows` rows (the blank key, a default code) are
    answered from a bounded broadcast and spread by salt (see `calibra.operators.skew`).
    """
    for i, keys in enumerate(key_sets):
        names = _key_names(i, len(keys))
        counts = key_counts(key_projection(df, keys, names, reference), names)
        repeated = counts.where(F.col(COUNT) > 1).select(*names)
        keyed = df.withColumns({n: norm_key(qcol(k)) for k, n in zip(keys, names)})
        # hot keys (> hot_key_rows >= 1 rows) repeat by definition
        df = flag_by_key(keyed, names, repeated, counts, marker_name(i), hot_key_rows,
                         hot_always_match=True).drop(*names)
    return df


def duplicate_rows(df: DataFrame, keys: Sequence[str], marker: str = "is_duplicate") -> DataFrame:
    """Every row with a boolean marker of a repeated normalised key."""
    return add_duplicate_markers(df, [tuple(keys)], lambda i: marker).withColumn(
        marker, F.coalesce(F.col(marker), F.lit(False)))
