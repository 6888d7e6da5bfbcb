"""Schema shaping (projections only; no shuffle): N1-N9 and type normalisation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra import constants as K
from calibra.functions.text import qcol


def trim_headers(df: DataFrame) -> DataFrame:
    """Strip surrounding whitespace from every column name."""
    names = [str(c).strip() for c in df.columns]
    return df if names == df.columns else df.toDF(*names)


def dedupe_columns(df: DataFrame) -> DataFrame:
    """When a name occurs more than once keep the last occurrence."""
    names = df.columns
    if len(set(names)) == len(names):
        return df
    keep_last = {n: i for i, n in enumerate(names)}
    tmp = [f"__c{i}" for i in range(len(names))]
    renamed = df.toDF(*tmp)
    return renamed.select([qcol(tmp[i]).alias(n) for i, n in enumerate(names) if keep_last[n] == i])


def shadow_columns(columns: Iterable[str]) -> list[str]:
    wanted = {c.lower() for c in K.SHADOW_COLUMNS}
    return [c for c in columns if str(c).strip().lower() in wanted]


def drop_shadow(df: DataFrame) -> DataFrame:
    """Drop columns that would collide with audit outputs (trimmed, case-insensitive)."""
    drop = shadow_columns(df.columns)
    if not drop:
        return df
    keep = [c for c in df.columns if c not in drop]
    return df.select([qcol(c) for c in keep])


def project_to(df: DataFrame, allowed: Iterable[str]) -> DataFrame:
    """Keep only the columns the target table has; error if none is left."""
    allowed = set(allowed)
    cols = [c for c in df.columns if c in allowed]
    if not cols:
        raise ValueError("no column of the frame matches the target schema")
    return df.select([qcol(c) for c in cols])


def as_text_columns(df: DataFrame, cols: Sequence[str] = K.TEXT_TARGET_COLUMNS) -> DataFrame:
    """Force nullable text on identifier columns that exist."""
    present = [c for c in cols if c in df.columns]
    if not present:
        return df
    return df.withColumns({c: qcol(c).cast("string") for c in present})


def _stored(col: Column, kind: T.DataType, wall_clock: bool) -> tuple[Column, T.DataType] | None:
    """A value in its storage type and that type; None where nothing changes."""
    if isinstance(kind, T.UserDefinedType):
        plain = F.unwrap_udt(col)
        return _stored(plain, kind.sqlType(), wall_clock) or (plain, kind.sqlType())
    if isinstance(kind, T.TimestampNTZType) and not wall_clock:
        instant = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col))
        return instant, T.TimestampType()
    if isinstance(kind, T.StructType):
        parts = [(f, _stored(col[f.name], f.dataType, wall_clock)) for f in kind.fields]
        if not any(p for _, p in parts):
            return None
        made = F.struct(*[(p[0] if p else col[f.name]).alias(f.name) for f, p in parts])
        return (F.when(col.isNotNull(), made),
                T.StructType([T.StructField(f.name, p[1] if p else f.dataType, f.nullable) for f, p in parts]))
    if isinstance(kind, T.ArrayType):
        found: list = []
        made = F.transform(col, lambda x: found.append(_stored(x, kind.elementType, wall_clock)) or (found[-1] or (x,))[0])
        return (made, T.ArrayType(found[-1][1], kind.containsNull)) if found[-1] else None
    if isinstance(kind, T.MapType):                  # keys can't change: two keys could become one
        found = []
        made = F.transform_values(col, lambda k, x: found.append(_stored(x, kind.valueType, wall_clock)) or (found[-1] or (x,))[0])
        return (made, T.MapType(kind.keyType, found[-1][1], kind.valueContainsNull)) if found[-1] else None
    return None


def normalize_types(df: DataFrame, wall_clock: bool = True) -> DataFrame:
    """User-defined types to their storage type, at any depth of structs, arrays and map
    values.  Timestamps without a zone stay (the original keeps date-times as they are);
    with `wall_clock=False` they become instants, read as UTC.  Nulls stay null."""
    changes = {f.name: done[0] for f in df.schema.fields if (done := _stored(qcol(f.name), f.dataType, wall_clock))}
    return df.withColumns(changes) if changes else df


def _set_column(df: DataFrame, name: str, value) -> DataFrame:
    """Replace in place when present, append otherwise (with_columns semantics)."""
    if name in df.columns:
        return df.select([value.alias(name) if c == name else qcol(c) for c in df.columns])
    return df.select(*[qcol(c) for c in df.columns], value.alias(name))


def adapt_domain(df: DataFrame, domain: str) -> DataFrame:
    """Directory domain -> id, description and constant type; defaults for any domain."""
    if K.DIRECTORY_MARKER in str(domain):
        for src in K.DIRECTORY_ID_COLUMNS:
            if src in df.columns:
                df = _set_column(df, K.COL_ID_NUM, qcol(src))
                break
        if K.DIRECTORY_NAME_COLUMN in df.columns:
            df = _set_column(df, K.COL_DESC, qcol(K.DIRECTORY_NAME_COLUMN))
        df = _set_column(df, K.COL_TYPE, F.lit(K.DIRECTORY_BLOCK))
    if K.COL_TYPE not in df.columns:
        df = _set_column(df, K.COL_TYPE, F.lit(K.DEFAULT_BLOCK))
    if K.COL_DESC not in df.columns:
        df = _set_column(df, K.COL_DESC, F.lit(""))
    if K.COL_ID_NUM in df.columns:
        df = _set_column(df, K.COL_ID_NUM, qcol(K.COL_ID_NUM).cast("string"))
    return df


def missing_columns(columns: Sequence[str], required: Sequence[str]) -> list[str]:
    """Required names absent from the frame, in the required order."""
    present = set(columns)
    return [c for c in required if c not in present]


def stamp_auditor(df: DataFrame, user: str | None) -> DataFrame:
    """The auditing user, trimmed, or ''."""
    return _set_column(df, K.AUDITOR, F.lit(str(user).strip() if user else ""))
