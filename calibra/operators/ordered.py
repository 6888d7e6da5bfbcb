"""Ordered operators over keys of any size: as-of join, and window frames of a few rows.

A window puts all rows of a key in one task.  Here the rows are dealt by range of (key,
order), so a key that holds a third of all rows fills as many ranges as it needs; windows
run within (range, key), and only what crosses a range border is added: the last value so
far (as-of join) or the few rows that a frame reaches back to.  The border tables have a
few rows per range.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions.text import qcol
from calibra.session import scratch_path

PART, CONTEXT = "__calibra_part", "__calibra_context"


def frozen(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: sampled ranges must not be
    drawn again by a retry, and small tables get a size that Spark knows."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """`df` with PART, the number of its range of (keys, order), ascending."""
    return frozen(df.repartitionByRange(*[qcol(k) for k in keys], *order).withColumn(PART, F.spark_partition_id()), name)


def _same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    out = None
    for a, b in zip(left, right):
        out = a.eqNullSafe(b) if out is None else out & a.eqNullSafe(b)
    return out


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str,
              columns: Sequence[str], ties: Sequence[str] = (), suffix: str = "_vigente") -> DataFrame:
    """Every row of `left` with the row of `right` that is valid at its time: of the same
    key (as text), the latest with right_time <= left_time; of equal times the greatest by
    `ties`.

    Adds right_time and `columns` under their names plus `suffix`, null where no row is
    valid.  Rows of `left` are kept as they are, repeated ones too; a null key or time
    matches nothing.  Neither side has to be unique, and no pair of rows is formed.
    """
    given = [right_time, *[c for c in dict.fromkeys([*columns]) if c != right_time]]
    value = F.struct(*[qcol(c).alias(c) for c in given])
    rank = F.struct(*[qcol(c).alias(f"t{i}") for i, c in enumerate(ties)], F.lit(0).alias("t"))
    row = F.struct(*[qcol(c).alias(c) for c in left.columns])
    kind = left.schema[left_time].dataType
    a = left.select(qcol(key).cast("string").alias("k"), qcol(left_time).alias("at"), F.lit(1).alias("side"), row.alias("row"))
    b = (right.where(qcol(key).isNotNull() & qcol(right_time).isNotNull())
         .select(qcol(key).cast("string").alias("k"), qcol(right_time).cast(kind).alias("at"), F.lit(0).alias("side"),
                 rank.alias("tie"), value.alias("v")))
    every = dealt(a.unionByName(b, allowMissingColumns=True), ["k"], ["at", "side", "tie"], "asof")
    within = Window.partitionBy(PART, "k").orderBy("at", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = every.withColumn("v", F.last("v", ignorenulls=True).over(within)).where("side = 1 AND k IS NOT NULL AND at IS NOT NULL")
    # keys on both sides of a border: the last value of each range, then of all earlier ranges
    wide = every.where("k IS NOT NULL").groupBy("k").agg(F.min(PART).alias("p"), F.max(PART).alias("q")).where("p < q").select("k")
    wide = frozen(wide, "asof-border")
    last = (every.join(wide, "k", "left_semi").groupBy("k", PART)
            .agg(F.max_by(F.when(F.col("side") == 0, F.col("v")), F.when(F.col("side") == 0, F.struct("at", "tie"))).alias("v")))
    before = Window.partitionBy("k").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)    # one row per range
    last = frozen(last.select(F.col("k").alias("bk"), F.col(PART).alias("bp"), F.last("v", ignorenulls=True).over(before).alias("bv")),
                  "asof-carry")
    found = carried.join(last, (F.col("k") == F.col("bk")) & (F.col(PART) == F.col("bp")), "left") \
        .select("row", F.coalesce("v", "bv").alias("v"))
    none = every.where("side = 1 AND (k IS NULL OR at IS NULL)").select("row", F.lit(None).cast(every.schema["v"].dataType).alias("v"))
    return found.unionByName(none).select("row.*", *[F.col("v")[c].alias(f"{c}{suffix}") for c in given])


def with_context(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int) -> DataFrame:
    """`df` with PART and CONTEXT, so that a window over (PART, keys) ordered by `order` sees
    the `rows` preceding rows of every row: rows flagged CONTEXT are copies for the frames
    and must be dropped afterwards.  `order` has to be a total order within a key."""
    every = dealt(df, keys, order, "frames")
    k = [qcol(c) for c in keys]
    border = every.groupBy(*k).agg(F.min(PART).alias("p"), F.max(PART).alias("q")).where("p < q") \
        .select(*[qcol(c).alias(f"__b_{c}") for c in keys])
    border = frozen(border, "frames-border")
    on_border = every.join(border, _same(k, [qcol(f"__b_{c}") for c in keys]), "left_semi")
    back = Window.partitionBy(PART, *k).orderBy(*[qcol(c).desc() for c in order])
    tails = on_border.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= rows)
    # at most `rows` rows per key and range: their place in the key's order, and how many come before each range
    place = Window.partitionBy(*k).orderBy(PART, *[qcol(c) for c in order])
    tails = frozen(tails.withColumn("__place", F.row_number().over(place)), "frames-tails")
    counts = on_border.groupBy(PART, *k).agg(F.least(F.count(F.lit(1)), F.lit(rows)).alias("__n"))
    ahead = Window.partitionBy(*k).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    wanted = counts.withColumn("__upto", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).where("__upto > 0").select(
        F.col(PART).alias("__to"), *[qcol(c).alias(f"__w_{c}") for c in keys],
        F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("__upto") - rows + 1), F.col("__upto"))).alias("__want"))
    copies = tails.join(wanted, _same(k, [qcol(f"__w_{c}") for c in keys]) & (F.col("__place") == F.col("__want"))) \
        .select(*[qcol(c) for c in df.columns], F.col("__to").alias(PART), F.lit(True).alias(CONTEXT))
    return every.withColumn(CONTEXT, F.lit(False)).unionByName(copies)
