"""Readers and writers (S1-S3, S7, S8) and versioned snapshots of the audit target.

Tables are Parquet folders.  Writers append or write a new version; nothing ever
overwrites a folder that the same job reads.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from calibra import constants as K
from calibra.functions.text import qcol, utrim
from calibra.operators import reports, shaping


def read_master(spark: SparkSession, source: str) -> DataFrame:
    """The master table, all columns (a catalog table name or a Parquet path)."""
    if os.path.sep in source or source.endswith(".parquet") or "://" in source:
        return spark.read.parquet(source)
    return spark.table(source)


def read_extract(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A file extract read as text only (no type inference), headers trimmed.

    Spreadsheet workbooks are out of scope; export the sheet (the directory sheet
    or the first one) to CSV and point here.  An empty file gives an empty frame.
    """
    df = (spark.read.option("header", True).option("inferSchema", False)
          .option("sep", sep).option("multiLine", True).option("escape", '"').csv(path))
    return shaping.dedupe_columns(shaping.trim_headers(df))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Code list (`CODE<TAB>description` lines): first field, trimmed, upper,
    distinct, sorted; blank lines and blank codes dropped."""
    lines = spark.read.text(path)
    code = F.upper(utrim(F.split(utrim(F.col("value")), "\t").getItem(0)))
    return (lines.where(utrim(F.col("value")) != F.lit(""))
            .select(code.alias("code")).where(F.col("code") != F.lit(""))
            .distinct().orderBy("code"))


def append_results(df: DataFrame, path: str, allowed: list[str] | None = None) -> int:
    """S3: append audit results to the target table; returns rows written.

    Duplicate column names keep the last (N2), columns the target lacks are dropped
    (N4), identifier columns become nullable text (N5).  The count comes from an
    observation on the write itself, not from a second pass.
    """
    spark = df.sparkSession
    target_schema = spark.read.parquet(path).schema if exists(spark, path) else None
    if allowed is None and target_schema is not None:
        allowed = [f.name for f in target_schema.fields]
    out = shaping.dedupe_columns(df)
    if allowed is not None:
        out = shaping.project_to(out, allowed)
    out = shaping.as_text_columns(out)
    if target_schema is not None:
        # every file of the folder carries the full target schema, in target order
        have = set(out.columns)
        out = out.select(*[(qcol(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                           for f in target_schema.fields])
    obs = Observation(f"append_{uuid.uuid4().hex[:8]}")
    out.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(path)
    return int(obs.get.get("rows", 0))


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a path in any store Spark can read."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = hadoop_path(spark, path)
    return files.exists(place)


def read_text(spark: SparkSession, path: str) -> str:
    """A small configuration file as text; raises when it isn't there."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path}: one file expected")
    return rows[0][0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text (of whole lines) as a folder of one file; the new content is
    complete under another name before the old one goes."""
    files, place = hadoop_path(spark, path)
    fresh = f"{path}.{uuid.uuid4().hex[:8]}"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(fresh)
    if files.exists(place):
        files.rename(place, hadoop_path(spark, f"{fresh}.old")[1])
    if not files.rename(hadoop_path(spark, fresh)[1], place):
        raise OSError(f"{path} could not be replaced; the new content is in {fresh}")


def export_remediation(audited: DataFrame, messages, path: str, digits: int = 1) -> str:
    """The remediation export.

    `<path>/matriz`: every row to fix with its mark columns (Q5 wide); `<path>/por_falla/
    clave=<n>`: one subset per finding (Q7) with its full text in column `falla`.  `n`
    numbers the findings the rule document can produce in sorted order, so neither their
    length nor their characters matter.
    """
    reports.remediation_matrix(audited, messages, digits, ordered=False).write.mode("overwrite") \
        .parquet(os.path.join(path, "matriz"))
    names = reports.candidate_findings(messages)
    marks = reports.remediation_long(audited, messages, digits)
    number = F.lit(0)
    if names:
        number = F.create_map(*[F.lit(x) for pair in zip(names, range(len(names))) for x in pair])[F.col("falla")]
    marks.withColumn("clave", number).write.mode("overwrite").partitionBy("clave") \
        .parquet(os.path.join(path, "por_falla"))
    return path


# -- versioned snapshots of a table that is updated (I3) ---------------------

def current_version(spark: SparkSession, table_dir: str) -> str | None:
    """Path of the newest complete version of a snapshot table.

    A version is complete when its folder holds `_SUCCESS`, which the write commits last;
    there is no pointer to keep, so no failure can leave the table without a current
    version or move it back.
    """
    files, root = hadoop_path(spark, table_dir)
    if not files.exists(root):
        return None
    names = [s.getPath().getName() for s in files.listStatus(root) if s.isDirectory()]
    done = [n for n in names if n.startswith("v") and exists(spark, os.path.join(table_dir, n, "_SUCCESS"))]
    return os.path.join(table_dir, max(done)) if done else None


def write_version(df: DataFrame, table_dir: str) -> str:
    """Write `df` as a new version folder; it becomes current when the write commits.

    Names carry a number one above the current version's, so they sort in order whatever
    the clock says.  Readers of the previous version are never disturbed.
    """
    last = current_version(df.sparkSession, table_dir)
    number = int(os.path.basename(last)[1:].split("_")[0]) + 1 if last else 1
    version = os.path.join(table_dir, f"v{number:012d}_{uuid.uuid4().hex[:6]}")
    df.write.mode("errorifexists").parquet(version)
    return version


def read_version(spark: SparkSession, table_dir: str) -> DataFrame:
    v = current_version(spark, table_dir)
    if v is None:
        raise FileNotFoundError(f"no version written under {table_dir}")
    return spark.read.parquet(v)


# -- business catalogues (driver-side configuration, a few KB) ---------------

def load_units(spark: SparkSession, text_path: str | None = None, json_catalog: dict | None = None) -> DataFrame:
    """The unit codes as a table (column `code`, any size: the audit looks codes up
    by a join): the text code list when it exists and is not empty, else the JSON
    catalogue's `unidades_medida` list, else no codes."""
    if text_path and exists(spark, text_path):
        codes = read_codes(spark, text_path)
        if codes.limit(1).count():
            return codes
    units = (json_catalog or {}).get("unidades_medida", [])
    return spark.createDataFrame([(str(u),) for u in units] if isinstance(units, list) else [], "code string")


def read_catalogs(spark: SparkSession, path: str | None) -> dict:
    """The business catalogue JSON as small DataFrames: `custodians` (tipo_mat,
    custodio), `type_names` (tipo_mat, nombre), plus the raw `domains` dict and the
    `units` list.  No path gives empty catalogues; a path that can't be read raises."""
    import json
    raw: dict = json.loads(read_text(spark, path)) if path else {}
    custodians = raw.get("custodios_por_tipo", {}) or {}
    names = raw.get("mapeo_nombres_material", {}) or {}
    return {
        "custodians": spark.createDataFrame([(str(k), str(v)) for k, v in custodians.items()],
                                            "tipo_mat string, custodio string"),
        "type_names": spark.createDataFrame([(str(k), str(v)) for k, v in names.items()],
                                            "tipo_mat string, nombre string"),
        "domains": raw.get("dominios_config", {}) or {},
        "units": raw.get("unidades_medida", []) if isinstance(raw.get("unidades_medida", []), list) else [],
    }
