"""Audit history table (S4-S6): fixed 11-column schema, append-only Parquet."""

from __future__ import annotations

import hashlib
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra import constants as K
from calibra.functions.text import qcol
from calibra.operators import reports
from calibra.operators.ordered import CONTEXT, PART, with_context
from calibra.sources.io import exists, hadoop_path

_TYPES = {"string": T.StringType(), "timestamp": T.TimestampType(), "bigint": T.LongType(),
          "double": T.DoubleType()}
_LAST: dict[tuple[str, str], str] = {}          # last recorded source by application and history
HISTORY_SCHEMA = T.StructType([T.StructField(n, _TYPES[t], True) for n, t in K.HISTORY_COLUMNS])


def ensure_history(spark: SparkSession, path: str) -> None:
    """Create the empty history table at `path` when absent."""
    if not exists(spark, path):
        spark.createDataFrame([], HISTORY_SCHEMA).write.mode("ignore").parquet(path)


def history_record(audited: DataFrame, user: str, domain: str, types=None,
                   run_id: str | None = None) -> DataFrame:
    """One history row computed from the audited frame (one aggregate, no collect).

    Means of missing columns and NaN/empty means become 0.0; the type list is
    joined with ', ' or 'Todos'.
    """
    rid = run_id or f"{K.HISTORY_ID_PREFIX}{int(time.time())}"
    mats = ", ".join(types) if types else K.HISTORY_ALL_TYPES
    aggs = [F.count(F.lit(1)).alias("total_registros")]
    for name, src in reports.SUMMARY_COLUMNS:
        v = F.avg(qcol(src).cast("double")) if src in audited.columns else F.lit(0.0)
        aggs.append(F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)).alias(name))
    one = audited.agg(*aggs)
    return one.select(
        F.lit(rid).alias("id_ejecucion"),
        F.date_trunc("second", F.current_timestamp()).alias("fecha"),
        F.lit(user).cast("string").alias("usuario"),
        F.lit(domain).cast("string").alias("dominio"),
        F.lit(mats).alias("materiales_auditados"),
        F.col("total_registros").cast("bigint").alias("total_registros"),
        *[F.col(n).cast("double").alias(n) for n, _ in reports.SUMMARY_COLUMNS])


def _claim(spark: SparkSession, path: str, source: str, run_id: str, stale_seconds: float) -> tuple[str, str] | None:
    """(place of the claim, run id to write) when `source` is this caller's to record.

    The claim is a file that the store creates only if there is none, so of any number of
    applications one gets it.  A claim that was never completed is taken over once it is
    older than `stale_seconds`, unless its record is in the history.
    """
    place = f"{path.rstrip('/')}_claims/{hashlib.sha256(source.encode()).hexdigest()}"
    files, file = hadoop_path(spark, place)
    jvm = spark.sparkContext._jvm
    try:
        out = files.create(file, False)
        out.write(bytearray(run_id.encode()))
        out.close()
        return place, run_id
    except Py4JJavaError as exc:
        if not files.exists(file):
            raise exc
    if exists(spark, place + ".done"):
        return None
    age = time.time() - files.getFileStatus(file).getModificationTime() / 1000
    if age < stale_seconds:
        return None
    stream = files.open(file)
    held = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    stream.close()
    if exists(spark, path) and read_history(spark, path).where(F.col("id_ejecucion") == held).limit(1).count():
        files.create(hadoop_path(spark, place + ".done")[1], True).close()
        return None
    return place, held


def append_history(audited: DataFrame, path: str, user: str, domain: str, types=None,
                   run_id: str | None = None, strict: bool = False, source_name: str | None = None,
                   once: str = "ever", stale_seconds: float = 3600.0) -> str | None:
    """Append one record; a failure only warns unless `strict`.  Returns the run id,
    None when nothing was written.

    With `source_name`, `once` says how often a source is recorded.  "ever": once per
    history, whatever applications record it (`_claim`; run ids must be unique for a
    failed claim to be told from a written one).  "last": not again while it is the last
    source that this application recorded, as the original does, so A, B, A are three
    records.  A failed write is forgotten: the source can be recorded again.
    """
    spark = audited.sparkSession
    rid = run_id or f"{K.HISTORY_ID_PREFIX}{int(time.time())}"
    claim, last = None, (spark.sparkContext.applicationId, path)
    if source_name is not None and once == "last" and _LAST.get(last) == source_name:
        return None
    if source_name is not None and once == "ever":
        claim = _claim(spark, path, source_name, rid, stale_seconds)
        if claim is None:
            return None
        rid = claim[1]
    try:
        ensure_history(spark, path)
        history_record(audited, user, domain, types, rid).write.mode("append").parquet(path)
    except Exception as exc:  # the original only shows a toast
        if claim:
            files, file = hadoop_path(spark, claim[0])
            files.delete(file, False)
        if strict:
            raise
        import warnings
        warnings.warn(f"history not written: {exc}")
        return None
    if claim:
        files, done = hadoop_path(spark, claim[0] + ".done")
        files.create(done, True).close()
    elif source_name is not None:
        _LAST[last] = source_name
    return rid


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).parquet(path)


def list_history_frame(history: DataFrame, display: bool = True) -> DataFrame:
    """Newest first; the display subset of columns when `display`."""
    out = history.orderBy(F.desc("fecha"))
    if display:
        out = out.select(*[qcol(c) for c in K.HISTORY_DISPLAY_COLUMNS if c in history.columns])
    return out


def list_history(spark: SparkSession, path: str, display: bool = True) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], HISTORY_SCHEMA)
    return list_history_frame(read_history(spark, path), display)


def score_trend(history: DataFrame, runs: int = 3, order=("fecha", "id_ejecucion"), domain: str = "dominio",
                score: str = "score_global", digits: int | None = None) -> DataFrame:
    """Every run with `anterior` (the score of the domain's run before), `cambio` against it
    and `media_movil`, the mean of its last `runs` runs.

    `order` is a total order within a domain; a null domain is one domain.  A domain with
    most of the runs is spread over ranges (`with_context`).
    """
    rows = with_context(history, [domain], order, max(1, runs - 1))
    w = Window.partitionBy(PART, qcol(domain)).orderBy(*[qcol(c) for c in order])
    mean = F.avg(qcol(score)).over(w.rowsBetween(1 - runs, 0))
    before = F.lag(qcol(score)).over(w)
    out = rows.withColumns({"anterior": before, "cambio": qcol(score) - before,
                            "media_movil": mean if digits is None else F.bround(mean, digits)})
    return out.where(~F.col(CONTEXT)).drop(PART, CONTEXT)
