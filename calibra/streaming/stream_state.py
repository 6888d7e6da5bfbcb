"""Stateful streams over arriving changes: uniqueness and failures per event-time window.

State lives in Spark's state store and is dropped behind the watermark; no batch re-reads
what earlier batches saw.  Each query runs until the available input is consumed and keeps
its place in its checkpoint.  Counting states (`stream_repeats`, `stream_failures`) are
streaming aggregates: rows are combined map-side before the state, so a hot key costs one
row per task and batch.  Every batch leaves the groups it changed in `<target>/batch=<id>`
(overwritten when a batch is replayed); a reader takes the newest of each group.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from calibra import constants as K
from calibra.functions.text import norm_key, qcol
from calibra.operators.audit import audit
from calibra.plans.compiler import compile_document
from calibra.plans.ruledoc import load_document

Prepare = Callable[[DataFrame], DataFrame] | None


def _instant(df: DataFrame, time: str) -> Column:
    """A time as the instant that watermarks need: wall-clock times count as UTC, whatever
    the session's zone."""
    if isinstance(df.schema[time].dataType, T.TimestampNTZType):
        return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), qcol(time)))
    return qcol(time).cast("timestamp")


def _as_given(df: DataFrame, time: str, instant: Column) -> Column:
    """An instant in the type of the source's time column."""
    if isinstance(df.schema[time].dataType, T.TimestampNTZType):
        return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.lit("1970-01-01").cast("timestamp_ntz"))
    return instant


def _read(spark: SparkSession, source_dir: str, schema: T.StructType, prepare: Prepare) -> DataFrame:
    changes = spark.readStream.schema(schema).parquet(source_dir)
    return changes if prepare is None else prepare(changes)


def _changed_groups(groups: DataFrame, target_dir: str, checkpoint: str) -> StreamingQuery:
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(target_dir, f"batch={batch_id}"))

    query = (groups.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
             .foreachBatch(handle).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def newest_groups(spark: SparkSession, target_dir: str, group: Sequence[str]) -> DataFrame:
    """The state of each group after the last batch that changed it (a partial maximum by
    batch number: no window, no hot group)."""
    rows = spark.read.parquet(target_dir)
    values = [c for c in rows.columns if c not in (*group, "batch")]
    newest = rows.groupBy(*[qcol(c) for c in group]).agg(F.max_by(F.struct(*[qcol(c) for c in values]), "batch").alias("v"))
    return newest.select(*[qcol(c) for c in group], "v.*")


def stream_repeats(spark: SparkSession, source_dir: str, schema: T.StructType, target_dir: str, keys: Sequence[str],
                   record: str, time: str, horizon: str, delay: str, checkpoint: str, prepare: Prepare = None) -> StreamingQuery:
    """Uniqueness over a stream: how often each normalised key occurred within its period of
    length `horizon` (event time), and its first record (smallest time, then record id).

    Keys of a period are forgotten once the watermark (greatest time seen minus `delay`)
    passes its end; rows that arrive later than that are left out.  Rows without a time
    have no period and are left out too.
    """
    changes = _read(spark, source_dir, schema, prepare).where(qcol(time).isNotNull())
    names = [norm_key(qcol(k)).alias(k) for k in keys]
    rows = changes.select(*names, _instant(changes, time).alias("__t"), qcol(record).alias("__r")).withWatermark("__t", delay)
    counted = rows.groupBy(F.window("__t", horizon).alias("w"), *[qcol(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("veces"), F.min(F.struct("__t", "__r")).alias("first"))
    return _changed_groups(counted.select(_as_given(changes, time, F.col("w.start")).alias("periodo"), *[qcol(k) for k in keys], "veces",
                                          F.col("first.__r").alias("primero")), target_dir, checkpoint)


def read_repeats(spark: SparkSession, target_dir: str, keys: Sequence[str]) -> DataFrame:
    """(periodo, keys, veces, primero) of the keys that occurred more than once."""
    return newest_groups(spark, target_dir, ["periodo", *keys]).where("veces > 1")


def first_records(changes: DataFrame, keys: Sequence[str], record: str, time: str, horizon: str, salts: int = 16) -> DataFrame:
    """A stream without repeated keys: of the rows of a normalised key that arrive within
    `horizon` of the first, one goes on.

    Two keyed states in a row: by (key, salt of the record), which spreads a hot key over
    `salts` tasks, then by key, which a key reaches `salts` times at most.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    rows = changes.withColumns({n: norm_key(qcol(k)) for n, k in zip(names, keys)})
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(qcol(record)), F.lit(salts).cast("long")))
    rows = rows.withColumn("__t", _instant(changes, time)).withWatermark("__t", horizon)
    return rows.dropDuplicatesWithinWatermark([*names, "__salt"]).dropDuplicatesWithinWatermark(names).drop(*names, "__salt", "__t")


def stream_first_records(spark: SparkSession, source_dir: str, schema: T.StructType, target_dir: str, keys: Sequence[str],
                         record: str, time: str, horizon: str, checkpoint: str, prepare: Prepare = None,
                         salts: int = 16) -> StreamingQuery:
    """`first_records` appended to `target_dir` (Spark's file sink: exactly once)."""
    changes = _read(spark, source_dir, schema, prepare).where(qcol(time).isNotNull())
    query = (first_records(changes, keys, record, time, horizon, salts).writeStream.outputMode("append").format("parquet")
             .option("path", target_dir).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def stream_failures(spark: SparkSession, source_dir: str, schema: T.StructType, target_dir: str, rules, time: str,
                    width: str, delay: str, checkpoint: str, slide: str | None = None, units: Sequence[str] = (),
                    prepare: Prepare = None, group: Sequence[str] = (K.COL_TYPE,)) -> StreamingQuery:
    """Audited and failed rows per event-time window (tumbling, or sliding with `slide`) and
    `group`.

    A row is late when its window ended at or before the watermark (greatest time of the
    runs before minus `delay`) and is left out of that window.  Rules that compare rows
    with other rows (uniqueness) need `stream_repeats`; here they are an error.
    """
    changes = _read(spark, source_dir, schema, prepare).where(qcol(time).isNotNull())
    if compile_document(load_document(rules), changes.schema, units).key_sets:
        raise ValueError("uniqueness rules are not judged row by row: use stream_repeats")
    audited = audit(changes.withColumn("__t", _instant(changes, time)).withWatermark("__t", delay), rules, units)
    window: Column = F.window("__t", width, slide) if slide else F.window("__t", width)
    counted = audited.groupBy(window.alias("w"), *[qcol(c) for c in group]).agg(
        F.count(F.lit(1)).alias("filas"), F.count(F.when(qcol(K.STATUS) == 0, 1)).alias("fallidas"))
    return _changed_groups(counted.select(_as_given(changes, time, F.col("w.start")).alias("inicio"),
                                          _as_given(changes, time, F.col("w.end")).alias("fin"), *[qcol(c) for c in group], "filas", "fallidas"), target_dir, checkpoint)


def read_failures(spark: SparkSession, target_dir: str, group: Sequence[str] = (K.COL_TYPE,)) -> DataFrame:
    return newest_groups(spark, target_dir, ["inicio", "fin", *group])
