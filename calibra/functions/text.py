"""Text column helpers (all JVM built-ins, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra import constants as K


_QCOL_CACHE: dict = {}


def qcol(name: str) -> Column:
    """Column by exact name; dots, spaces and accents are taken literally.

    Unresolved column references are immutable, so they are reused per SparkContext
    (each creation is a round trip to the JVM).
    """
    from pyspark import SparkContext
    key = (id(SparkContext._active_spark_context), name)
    col = _QCOL_CACHE.get(key)
    if col is None:
        if len(_QCOL_CACHE) > 4096:
            _QCOL_CACHE.clear()
        col = _QCOL_CACHE[key] = F.col("`" + name.replace("`", "``") + "`")
    return col


def as_text(col: Column) -> Column:
    return col.cast("string")


def utrim(col: Column) -> Column:
    """Strip Unicode whitespace from both ends (plain `trim` strips spaces only)."""
    return F.trim(col, F.lit(K.WHITESPACE_CHARS))


def norm_key(col: Column) -> Column:
    """Key normalisation of the duplicate test: missing -> '', text, trim, upper."""
    return F.upper(utrim(F.coalesce(as_text(col), F.lit(""))))


def norm_token(col: Column) -> Column:
    """Normalisation of white/black list comparison: text, trim, upper (null stays null)."""
    return F.upper(utrim(as_text(col)))


def not_empty_text(col: Column) -> Column:
    """Not null and its untrimmed text is not ''."""
    return col.isNotNull() & (as_text(col) != F.lit(""))


def canonical_id(col: Column, dtype: T.DataType | None = None) -> Column:
    """Identifier as readable text.

    Integral floats print without the fraction, text that is digits plus a
    trailing ``.0`` loses the suffix, missing values become ''.
    """
    if dtype is not None and isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        d = col.cast("double")
        integral = (~F.isnan(d)) & (d == F.floor(d)) & (F.abs(d) < F.lit(9.2e18))
        return (F.when(col.isNull(), F.lit(""))
                .when(integral, F.floor(d).cast("bigint").cast("string"))
                .otherwise(utrim(as_text(col))))
    if dtype is not None and isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return F.coalesce(as_text(col), F.lit(""))
    s = utrim(as_text(col))
    cut = F.regexp_replace(s, r"\.0\z", "")
    digits = F.regexp_replace(cut, "-", "")
    strip = (F.char_length(s) > 2) & s.endswith(".0") & digits.rlike(r"^[0-9]+\z")
    return F.when(col.isNull(), F.lit("")).when(strip, cut).otherwise(s)


def column_type(df: DataFrame, name: str) -> T.DataType:
    for f in df.schema.fields:
        if f.name == name:
            return f.dataType
    raise KeyError(name)
