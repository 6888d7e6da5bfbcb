"""Key lookups that stay balanced when one key holds a large share of the rows.

`flag_by_key` marks every row of `left` whose key is in `lookup`.  A plain join
would send all rows of a hot key (or of the null key) to one task; here:

* `counts` (rows per key of `left`, a partial-then-final aggregate) names the hot
  keys: more than `hot_key_rows` rows, the HOT_KEYS_MAX largest at most, so the hot
  table is broadcast with a constant bound (a key beyond it holds less than a
  HOT_KEYS_MAX-th of all rows).  Their answer is joined map-side from that broadcast.
* Rows of hot keys get a salt 1..ceil(n / hot_key_rows); all other rows salt 0.
  The salt is part of the shuffle key of the main join, so a hot key is spread over
  as many tasks as it needs, and salted rows match nothing there (the lookup side
  carries salt 0 only).  The salt hashes the key, the optional `spread_by` columns (a
  record key) and the input partition id only: no other column of `left` is read, and a
  retried task gives its rows the same salt.

Nothing is sampled, capped or dropped: every row keeps its exact answer.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEY_ROWS = 1_000_000
HOT_KEYS_MAX = 10_000
SALT = "__calibra_salt"
SPREAD = "__calibra_spread"
HIT = "__calibra_hit"
MATCH = "__calibra_match"
COUNT = "__calibra_n"


def key_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows per key (names are existing columns of `df`); map-side combine absorbs hot keys."""
    return df.groupBy(*names).agg(F.count(F.lit(1)).alias(COUNT))


def join_unique(left: DataFrame, names: Sequence[str], right: DataFrame, counts: DataFrame,
                matched: str, hot_key_rows: int = HOT_KEY_ROWS, hot_always_match: bool = False,
                spread_by: Sequence[str] = ()) -> DataFrame:
    """Left join of `left` with `right` (at most one row per key, keys non-null) on the
    key columns `names`, balanced for hot keys.

    Adds the value columns of `right` (null when unmatched) and a boolean `matched`.
    `counts` is `key_counts(left, names)` or a superset of it.  `hot_always_match`:
    every hot key is known to be in `right` and `right` has no value columns (the
    uniqueness case: a key with more than `hot_key_rows` >= 1 rows repeats).
    """
    names = list(names)
    values = [c for c in right.columns if c not in names]
    hot = (counts.where(F.col(COUNT) > F.lit(hot_key_rows)).orderBy(F.desc(COUNT), *names).limit(HOT_KEYS_MAX)
           .select(*names, F.ceil(F.col(COUNT) / F.lit(float(hot_key_rows))).cast("int").alias(SPREAD)))
    if hot_always_match and not values and hot_key_rows >= 1:
        hot = hot.withColumn(HIT, F.lit(True))
    else:
        # answers for the hot keys: scan `right` once against the broadcast hot keys
        # (map-side), then attach them to the hot table -- HOT_KEYS_MAX rows at most
        hits = (right.join(F.broadcast(hot.select(*names)), names, "inner")
                .select(*names, F.lit(True).alias(HIT), *[F.col(f"`{v}`").alias(f"{v}__h") for v in values]))
        hot = hot.join(hits, names, "left")
    hot = hot.select(*[F.col(n).alias(f"{n}__k") for n in names], SPREAD, HIT, *[f"{v}__h" for v in values])
    cond = reduce(lambda a, b: a & b, [left[n].eqNullSafe(F.col(f"{n}__k")) for n in names])
    w = left.join(F.broadcast(hot), cond, "left").drop(*[f"{n}__k" for n in names])
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, *spread_by])], F.spark_partition_id())
    w = w.withColumn(SALT, F.when(F.col(SPREAD).isNotNull(),
                                  F.pmod(row_hash, F.col(SPREAD).cast("long")) + 1).otherwise(F.lit(0).cast("long")))
    # salt 0 on the lookup side, written so that Catalyst cannot fold it into a literal:
    # a literal would turn `salt = 0` into a post-join filter and drop the salt from
    # the shuffle key, sending the hot key back to one task
    # (and non-nullable, so no `isnotnull` filter is inferred and pushed under the
    # lookup's aggregate, which would also stop the key-count exchange being reused)
    zero = F.coalesce(F.pmod(F.xxhash64(*[F.col(n) for n in names]), F.lit(1).cast("long")),
                      F.lit(0).cast("long"))
    probe = right.select(*names, zero.alias(SALT), F.lit(True).alias(MATCH),
                         *[F.col(f"`{v}`").alias(f"{v}__p") for v in values])
    w = w.join(probe, names + [SALT], "left")
    out = w.withColumn(matched, F.coalesce(F.col(HIT), F.col(MATCH), F.lit(False)))
    for v in values:
        out = out.withColumn(v, F.when(F.col(HIT), F.col(f"{v}__h")).otherwise(F.col(f"{v}__p")))
    return out.drop(SALT, SPREAD, HIT, MATCH, *[f"{v}__h" for v in values], *[f"{v}__p" for v in values])


def flag_by_key(left: DataFrame, names: Sequence[str], lookup: DataFrame, counts: DataFrame,
                flag: str, hot_key_rows: int = HOT_KEY_ROWS, hot_always_match: bool = False,
                spread_by: Sequence[str] = ()) -> DataFrame:
    """`left` plus boolean `flag`: the row's key (columns `names`) is in `lookup`.

    `lookup` holds distinct non-null keys in columns `names`.  Null keys never match.
    """
    return join_unique(left, names, lookup.select(*names), counts, flag, hot_key_rows, hot_always_match,
                       spread_by)
