"""Tables that grow by deltas: dates kept beside the table (I3) and key counts (Q-8).

Both are folders of numbered versions.  A version is complete when its `_SUCCESS` is there
(the write commits it last), so a failed step leaves nothing that a reader would see, and
a reader of earlier versions is never disturbed.  Rows are dealt to a fixed number of key
buckets (folders `bucket=<b>`): readers prune by bucket, and compaction rewrites only the
buckets that changed.  One writer at a time, as for the versioned snapshots.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from calibra import constants as K
from calibra.functions.text import norm_key, qcol
from calibra.operators.incremental import _date_text, latest_per_key, latest_value
from calibra.operators.skew import COUNT, HOT_KEY_ROWS, join_unique, key_counts
from calibra.sources.io import exists, hadoop_path

BUCKET, VERSION = "bucket", "__calibra_version"


def complete_versions(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, path) of the complete versions of a folder, ascending."""
    files, root = hadoop_path(spark, folder)
    if not files.exists(root):
        return []
    names = [s.getPath().getName() for s in files.listStatus(root) if s.isDirectory()]
    found = sorted((int(m[1]), os.path.join(folder, n)) for n in names if (m := re.fullmatch(r"v(\d+)", n)))
    return [(k, p) for k, p in found if exists(spark, os.path.join(p, "_SUCCESS"))]


def version_path(folder: str, number: int) -> str:
    return os.path.join(folder, f"v{number:012d}")


def bucket_of(keys: Sequence[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets).cast("long")).cast("int")


def _present(spark: SparkSession, version: str) -> list[int]:
    """Buckets that a version holds."""
    files, root = hadoop_path(spark, version)
    names = [s.getPath().getName() for s in files.listStatus(root) if s.isDirectory()]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}="))


def _buckets(spark: SparkSession, version: str, wanted: Sequence[int]) -> DataFrame:
    """The named buckets of a version: the scan lists no other folder."""
    return spark.read.option("basePath", version).parquet(*[os.path.join(version, f"{BUCKET}={b}") for b in wanted])


def _write_buckets(df: DataFrame, path: str) -> None:
    """One folder per bucket.  Spark gathers a bucket's rows into few files and splits a
    bucket that a hot key makes large (`rebalance`)."""
    df.hint("rebalance", qcol(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


class DatedTable:
    """An audit target whose dates are refreshed without rewriting it (I3, merge on read).

    `<path>/base/v<n>` holds whole rows by bucket; version n has the dates of the overlays
    up to n.  `<path>/dates/v<n>` holds one row per key whose dates changed in step n.  A
    reader lays the overlays over the base rows of their bucket in order: an overlay
    changes a row where the text of its date differs, as I3 says, so a row takes the
    creation date and stamp of the step that really changed it.  `compact` folds the
    overlays into the buckets that have some; the others stay as they are.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = K.COL_SKU, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.base, self.dates = os.path.join(path, "base"), os.path.join(path, "dates")

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, bucket_of([qcol(self.key).cast("string")], self.buckets))

    def create(self, df: DataFrame) -> None:
        """The first version; an error if there is one."""
        if complete_versions(self.spark, self.base):
            raise ValueError(f"{self.path} exists")
        _write_buckets(self._bucketed(df), version_path(self.base, 0))

    def append(self, df: DataFrame) -> None:
        """New records as files of their own bucket folders, at the current version: they
        carry the dates of their audit, so earlier overlays don't apply to them."""
        number = self.version() + 1
        _write_buckets(self._bucketed(df).withColumn(VERSION, F.lit(number)), version_path(os.path.join(self.path, "added"), number))

    def version(self) -> int:
        return max((n for folder in (self.base, self.dates, os.path.join(self.path, "added"))
                    for n, _ in complete_versions(self.spark, folder)), default=-1)

    def _rows(self) -> DataFrame:
        """Base rows with the version whose overlays they already hold."""
        newest = {b: (n, p) for n, p in complete_versions(self.spark, self.base) for b in _present(self.spark, p)}
        if not newest:
            raise FileNotFoundError(f"no version under {self.path}")
        out = None
        for n, p in sorted(set(newest.values())):
            wanted = [b for b, at in newest.items() if at == (n, p)]
            part = _buckets(self.spark, p, wanted).withColumn(VERSION, F.lit(n))
            out = part if out is None else out.unionByName(part)
        for n, p in complete_versions(self.spark, os.path.join(self.path, "added")):
            # compacted buckets hold the rows added before their compaction
            wanted = [b for b in _present(self.spark, p) if newest.get(b, (-1, ""))[0] < n]
            if wanted:
                out = out.unionByName(_buckets(self.spark, p, wanted))
        return out

    def _overlays(self) -> DataFrame | None:
        """(key text, steps): the dates of a key in order of version, one row per key."""
        oldest = min(n for n, _ in complete_versions(self.spark, self.base))
        paths = [(n, p) for n, p in complete_versions(self.spark, self.dates) if n > oldest]
        if not paths:
            return None
        every = None
        for n, p in paths:
            part = self.spark.read.parquet(p).drop(BUCKET).withColumn("version", F.lit(n))
            every = part if every is None else every.unionByName(part)
        return every.groupBy("__calibra_tk").agg(F.array_sort(F.collect_list(
            F.struct("version", "fecha", "creada", "con_creada", "marca_tiempo"))).alias("pasos"))

    def read(self, hot_key_rows: int = HOT_KEY_ROWS, buckets: Sequence[int] | None = None) -> DataFrame:
        """The current rows.  The overlay side has one row per changed key; Spark ships it
        when it is small, else joins by key with hot keys spread (`join_unique`)."""
        rows = self._rows()
        if buckets is not None:
            rows = rows.where(F.col(BUCKET).isin(list(buckets)))
        names = [c for c in rows.columns if c not in (BUCKET, VERSION)]
        steps = self._overlays()
        if steps is None:
            return rows.select(*[qcol(c) for c in names])
        t = rows.withColumn("__calibra_tk", qcol(self.key).cast("string"))
        j = join_unique(t, ["__calibra_tk"], steps, key_counts(t.select("__calibra_tk"), ["__calibra_tk"]),
                        "__calibra_found", hot_key_rows)
        now = [c for c in ("Fecha_Actualizacion", "Fecha_Ingreso", "Fecha_Actualizacion_M") if c in names]
        source = {"Fecha_Actualizacion": "fecha", "Fecha_Ingreso": "creada", "Fecha_Actualizacion_M": "marca_tiempo"}
        kinds = {f.name: f.dataType for f in rows.schema}
        start = F.struct(*[qcol(c).alias(c) for c in now])

        def step(row: Column, s: Column) -> Column:
            changes = (s["version"] > qcol(VERSION)) & (_date_text(s["fecha"].cast(kinds["Fecha_Actualizacion"]))
                                                        != _date_text(row["Fecha_Actualizacion"]))
            value = {c: s[source[c]].cast(kinds[c]) for c in now}
            if "Fecha_Ingreso" in value:               # a source without creation dates says nothing about them
                value["Fecha_Ingreso"] = F.when(s["con_creada"], value["Fecha_Ingreso"]).otherwise(row["Fecha_Ingreso"])
            return F.when(changes, F.struct(*[value[c].alias(c) for c in now])).otherwise(row)

        j = j.withColumn("__calibra_now", F.when(F.col("pasos").isNull(), start).otherwise(F.aggregate("pasos", start, step)))
        return j.select(*[F.col("__calibra_now")[c].alias(c) if c in now else qcol(c) for c in names])

    def sync_dates(self, src: DataFrame, src_date: str = "fecha_actualiza", src_created: str = "fecha_creacion",
                   order: Sequence[str] | None = None, now=None) -> int:
        """I3 as a delta: one row per key with a target row whose date text differs from the
        latest source date.  Returns the target rows that changed; nothing is written where
        none did.  Reads keys and dates of the target only."""
        created = src_created in src.columns
        cols = [self.key, src_date] + ([src_created] if created else [])
        latest = latest_per_key(src, self.key, order or [src_date], cols) if order or created \
            else latest_value(src, self.key, src_date)
        latest = latest.select(qcol(self.key).cast("string").alias("__calibra_tk"), qcol(src_date).alias("fecha"),
                               (qcol(src_created) if created else F.lit(None).cast("timestamp")).alias("creada"))
        # rows per key and date: a partial aggregate, so a hot key is a few rows per task
        held = (self.read().select(qcol(self.key).cast("string").alias("__calibra_tk"),
                                   _date_text(qcol("Fecha_Actualizacion")).alias("texto"))
                .groupBy("__calibra_tk", "texto").agg(F.count(F.lit(1)).alias("filas")))
        number, obs = self.version() + 1, Observation(f"dates_{self.version() + 1}")
        changed = (held.join(latest, "__calibra_tk").where(F.col("texto") != _date_text(F.col("fecha")))
                   .groupBy("__calibra_tk").agg(F.sum("filas").alias("filas"), F.first("fecha").alias("fecha"),
                                                F.first("creada").alias("creada"))
                   .observe(obs, F.sum("filas").alias("filas")))
        stamp = (F.lit(now) if now is not None else F.current_timestamp()).cast("timestamp")
        out = changed.select("__calibra_tk", "fecha", "creada", F.lit(created).alias("con_creada"), stamp.alias("marca_tiempo"),
                             bucket_of([F.col("__calibra_tk")], self.buckets).alias(BUCKET))
        path = version_path(self.dates, number)
        _write_buckets(out, path)
        rows = obs.get.get("filas") or 0
        if not rows:                                   # an empty step isn't a version
            files, place = hadoop_path(self.spark, path)
            files.delete(place, True)
        return int(rows)

    def compact(self, least: int = 1) -> list[int]:
        """Fold overlays and added rows into the buckets that `least` versions or more have
        changed since their last rewrite; returns these buckets.  Other buckets aren't read."""
        newest = {b: n for n, p in complete_versions(self.spark, self.base) for b in _present(self.spark, p)}
        pending: dict[int, int] = {}
        for folder in (self.dates, os.path.join(self.path, "added")):
            for n, p in complete_versions(self.spark, folder):
                for b in _present(self.spark, p):
                    if n > newest.get(b, -1):
                        pending[b] = pending.get(b, 0) + 1
        chosen = sorted(b for b, k in pending.items() if k >= least)
        if chosen:
            _write_buckets(self._bucketed(self.read(buckets=chosen)), version_path(self.base, self.version() + 1))
        return chosen


class KeyCounts:
    """How often each normalised key was loaded so far (uniqueness over several loads, Q-8).

    A load adds one row per distinct key it holds (`add`) and asks only for the keys it
    holds (`known`): the stored side is pruned to the load's buckets and semi-joined, so no
    earlier load is read again as a whole.  `compact` sums the versions into one.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets

    def _load_keys(self, load: DataFrame) -> DataFrame:
        rows = load.select(*[(norm_key(qcol(k)) if k in load.columns else F.lit("")).alias(k) for k in self.keys])
        return key_counts(rows, self.keys).withColumn(BUCKET, bucket_of([qcol(k) for k in self.keys], self.buckets))

    def _versions(self) -> list[tuple[int, str]]:
        """Current versions: the last compacted one and all after it."""
        done = complete_versions(self.spark, os.path.join(self.path, "sums"))
        after = done[-1][0] if done else -1
        return done[-1:] + [(n, p) for n, p in complete_versions(self.spark, os.path.join(self.path, "loads")) if n > after]

    def counts(self, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """(keys, bucket, count) over all loads; null before the first."""
        out = None
        for _, p in self._versions():
            wanted = [b for b in _present(self.spark, p) if buckets is None or b in buckets]
            if wanted:
                part = _buckets(self.spark, p, wanted)
                out = part if out is None else out.unionByName(part)
        return None if out is None else out.groupBy(BUCKET, *self.keys).agg(F.sum(COUNT).alias(COUNT))

    def known(self, load: DataFrame) -> DataFrame | None:
        """Keys of the load that earlier loads hold, with their counts: the `reference` of
        an audit of the load.  At most `buckets` numbers come to the driver."""
        keys = self._load_keys(load)
        wanted = [r[0] for r in keys.select(BUCKET).distinct().collect()]
        stored = self.counts(wanted)
        return None if stored is None else stored.join(keys.select(BUCKET, *self.keys), [BUCKET, *self.keys], "left_semi").drop(BUCKET)

    def add(self, load: DataFrame, number: int | None = None) -> int:
        """Record a load's keys as version `number` (default: the next).  A load that is
        run again under its number replaces what it wrote, so nothing counts twice."""
        if number is None:
            number = max((n for n, _ in self._versions()), default=-1) + 1
        elif any(n >= number for n, _ in complete_versions(self.spark, os.path.join(self.path, "sums"))):
            raise ValueError(f"load {number} is already part of a compacted version")
        _write_buckets(self._load_keys(load), version_path(os.path.join(self.path, "loads"), number))
        return number

    def compact(self) -> None:
        versions = self._versions()
        if len(versions) > 1:
            _write_buckets(self.counts(), version_path(os.path.join(self.path, "sums"), versions[-1][0]))
