"""Incremental loads against the audit target.

Keys are compared as text on both sides, as the original warehouse SQL does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra import constants as K
from calibra.functions.text import qcol
from calibra.operators.skew import HOT_KEY_ROWS, flag_by_key, join_unique, key_counts


def _text_key(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.withColumn(name, qcol(key).cast("string"))


def _key_lookup(src: DataFrame, target_keys: DataFrame, key: str, flag: str,
                hot_key_rows: int) -> DataFrame:
    """Source rows with a boolean: their text key is among the (distinct) target keys.

    Null and hot source keys are spread by salt instead of landing in one task.
    """
    s = _text_key(src, key, "__calibra_sk")
    counts = key_counts(s.select("__calibra_sk"), ["__calibra_sk"])
    lookup = target_keys.where(F.col("__calibra_sk").isNotNull()).distinct()
    return flag_by_key(s, ["__calibra_sk"], lookup, counts, flag, hot_key_rows)


def new_records(src: DataFrame, target: DataFrame, key: str = K.COL_SKU,
                target_key: str | None = None, hot_key_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Source rows whose key has no row in the target (anti semantics).

    A null source key never matches, so such rows are always new; source
    duplicates are kept.  Only the target's key column is read; its distinct keys
    are pre-aggregated map-side, so a hot target key costs one row per task.
    """
    tk = target.select(qcol(target_key or key).cast("string").alias("__calibra_sk"))
    out = _key_lookup(src, tk, key, "__calibra_in", hot_key_rows)
    return out.where(~F.col("__calibra_in")).select(*[qcol(c) for c in src.columns])


def open_anomalies(src: DataFrame, target: DataFrame, key: str = K.COL_SKU,
                   target_key: str | None = None, status: str = K.STATUS,
                   hot_key_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """I4: source rows with at least one target row of status 0 (semi semantics, no duplicates)."""
    tk = (target.where(qcol(status) == 0)
          .select(qcol(target_key or key).cast("string").alias("__calibra_sk")))
    out = _key_lookup(src, tk, key, "__calibra_open", hot_key_rows)
    return out.where(F.col("__calibra_open")).select(*[qcol(c) for c in src.columns])


def latest_per_key(src: DataFrame, key: str, order: Sequence[str],
                   columns: Sequence[str] | None = None) -> DataFrame:
    """The latest row per key, ordered by `order` descending (later names break ties).

    `row_number() ... = 1` lets Spark insert a partial per-group limit before the
    shuffle (window group limit), so a hot key ships at most one row per map task.
    """
    w = Window.partitionBy(qcol(key)).orderBy(*[qcol(c).desc() for c in order])
    cols = list(columns) if columns else src.columns
    return (src.select(*[qcol(c) for c in dict.fromkeys([key, *order, *cols])])
            .withColumn("__calibra_rn", F.row_number().over(w))
            .where(F.col("__calibra_rn") == 1)
            .select(*[qcol(c) for c in cols]))


def latest_value(src: DataFrame, key: str, ts: str) -> DataFrame:
    """I2 when only the date is needed: max per key (partial aggregation, skew-proof)."""
    return src.groupBy(qcol(key).alias(key)).agg(F.max(qcol(ts)).alias(ts))


def _date_text(col):
    return F.coalesce(col.cast("string"), F.lit(K.MISSING_DATE_TEXT))


def sync_dates(target: DataFrame, src: DataFrame, key: str = K.COL_SKU,
               src_date: str = "fecha_actualiza", src_created: str = "fecha_creacion",
               order: Sequence[str] | None = None, now=None,
               hot_key_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """The target with dates refreshed from the latest source version per key.

    A target row changes when the text of its date differs from the latest source
    date (missing -> 1900-01-01): it takes the source dates and a change stamp.
    Returns the whole new snapshot with a boolean `__changed`; write it as a new
    table version (never over the table being read).
    """
    has_created = src_created in src.columns
    cols = [key, src_date] + ([src_created] if has_created else [])
    if order:
        latest = latest_per_key(src, key, order, cols)
    elif has_created:
        latest = latest_per_key(src, key, [src_date], cols)
    else:
        latest = latest_value(src, key, src_date)
    latest = latest.select(qcol(key).cast("string").alias("__calibra_tk"),
                           qcol(src_date).alias("__calibra_new"),
                           (qcol(src_created) if has_created else F.lit(None)).alias("__calibra_created"))
    latest = latest.where(F.col("__calibra_tk").isNotNull())
    t = _text_key(target, key, "__calibra_tk")
    counts = key_counts(t.select("__calibra_tk"), ["__calibra_tk"])
    j = join_unique(t, ["__calibra_tk"], latest, counts, "__calibra_found", hot_key_rows)
    changed = (F.col("__calibra_found")
               & (_date_text(F.col("__calibra_new")) != _date_text(qcol("Fecha_Actualizacion"))))
    stamp = now if now is not None else F.current_timestamp()
    updates = {"Fecha_Actualizacion": F.when(changed, F.col("__calibra_new")).otherwise(qcol("Fecha_Actualizacion"))}
    if "Fecha_Ingreso" in target.columns and has_created:      # else the source says nothing about it
        updates["Fecha_Ingreso"] = F.when(changed, F.col("__calibra_created")).otherwise(qcol("Fecha_Ingreso"))
    if "Fecha_Actualizacion_M" in target.columns:
        updates["Fecha_Actualizacion_M"] = F.when(changed, stamp).otherwise(qcol("Fecha_Actualizacion_M"))
    out = [updates[c].alias(c) if c in updates else qcol(c) for c in target.columns]
    return j.select(*out, changed.alias("__changed"))


def sync(spark, master: DataFrame, target_dir: str, rules, units=(), domain: str = "Maestro de Materiales",
         user: str | None = None, key: str = K.COL_SKU, src_date: str = "fecha_actualiza",
         src_created: str = "fecha_creacion", order: Sequence[str] | None = None,
         refresh_dates: bool = True) -> dict:
    """One synchronisation, step by step (sequential, no background thread).

    1. new master records (anti join on the current target) are audited, their
       status re-derived from the score (A10) and appended to the current target
       version (S3) -- an append, cheap at any size;
    2. dates of audited records are refreshed from the latest master version (I3);
       Parquet cannot update in place, so this writes the next version and moves
       the pointer (with a table format this step is a MERGE INTO);
    3. the master rows of records still open (status 0) are returned (I4).

    `target_dir` is a versioned snapshot folder (see `calibra.sources.io`).
    """
    from pyspark.sql.observation import Observation

    from calibra.operators.audit import audit, restate
    from calibra.sources import io

    current = io.current_version(spark, target_dir)
    if current is None:
        audited = restate(audit(master, rules, units, domain=domain, user=user))
        obs = Observation("sync_first_load")
        current = io.write_version(
            audited.observe(obs, F.count(F.lit(1)).alias("rows")), target_dir)
        inserted = int(obs.get["rows"])
    else:
        target = spark.read.parquet(current)
        new = new_records(master, target, key)
        audited = restate(audit(new, rules, units, domain=domain, user=user))
        inserted = io.append_results(audited, current, allowed=target.columns)

    updated = 0
    target = spark.read.parquet(current)
    if refresh_dates and src_date in master.columns and "Fecha_Actualizacion" in target.columns:
        refreshed = sync_dates(target, master, key, src_date, src_created, order)
        updated = refreshed.where("__changed").count()
        if updated:                                 # an unchanged table keeps its version
            current = io.write_version(refreshed.drop("__changed"), target_dir)

    final = spark.read.parquet(current)
    return {"inserted": inserted, "updated": updated, "version": current,
            "anomalies": open_anomalies(master, final, key)}
