"""Column profile (Q19) and rule proposal from a profile (Q20).

The profile is a handful of aggregates per column, computed in one pass with
map-side combine.  Distinct counts and most-frequent values come from one
(column, value) frequency aggregate, so a hot value is pre-aggregated per task and
no group of rows is ever collected.  Quartiles are exact: running counts over ranges of
values, no task sees a whole column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra import constants as K
from calibra.functions.text import qcol


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and not isinstance(f.dataType, T.BooleanType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _stack(df_one_row: DataFrame, names: list[str], stats: list[str], types: dict) -> DataFrame:
    parts = []
    for i, n in enumerate(names):
        vals = ", ".join(f"CAST(`__{s}{i}` AS {types[s]})" for s in stats)
        parts.append(f"'{n.replace(chr(39), chr(39) * 2)}', {vals}")
    cols = ", ".join(["columna"] + stats)
    return df_one_row.selectExpr(f"stack({len(names)}, {', '.join(parts)}) AS ({cols})")


def numeric_profile(df: DataFrame, columns: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """count, mean, sample std, min, max per numeric column (one row per column)."""
    cols = columns or numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = qcol(c).cast("double")
        mean, std = F.avg(x), F.stddev_samp(x)
        if digits is not None:
            mean, std = F.bround(mean, digits), F.bround(std, digits)
        aggs += [F.count(x).alias(f"__count{i}"), mean.alias(f"__mean{i}"), std.alias(f"__std{i}"),
                 F.min(x).alias(f"__min{i}"), F.max(x).alias(f"__max{i}")]
    one = df.agg(*aggs)
    return _stack(one, cols, ["count", "mean", "std", "min", "max"],
                  {"count": "BIGINT", "mean": "DOUBLE", "std": "DOUBLE", "min": "DOUBLE", "max": "DOUBLE"})


QUARTILES = (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))
RANGES = 64


def numeric_quantiles(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Exact 25/50/75 % per numeric column, linearly interpolated.

    The (column, value) frequencies are cut into value ranges per column (approximate
    percentiles as splitters; any splitters give the same result); running counts are
    taken within a range and shifted by the sizes of the ranges before it, so no task
    holds or sorts all values of a column.
    """
    cols = columns or numeric_columns(df)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("columna"), qcol(c).cast("double").alias("v")) for c in cols]))
    freq = (df.select(pairs.alias("p")).select("p.columna", "p.v").where(F.col("v").isNotNull())
            .groupBy("columna", "v").agg(F.count(F.lit(1)).alias("n")))
    cuts = freq.groupBy("columna").agg(F.percentile_approx(
        "v", [i / RANGES for i in range(1, RANGES)], F.lit(1000)).alias("cuts"))
    ranged = freq.join(F.broadcast(cuts), "columna").select(       # one row per column
        "columna", "v", "n", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("part"))
    sizes = ranged.groupBy("columna", "part").agg(F.sum("n").alias("size"))
    by_part = Window.partitionBy("columna").orderBy("part")        # RANGES rows per column
    sizes = sizes.select("columna", "part", (F.sum("size").over(by_part) - F.col("size")).alias("before"),
                         F.sum("size").over(Window.partitionBy("columna")).alias("total"))
    inside = Window.partitionBy("columna", "part").orderBy("v")
    placed = ranged.join(sizes, ["columna", "part"]).select(
        "columna", "v", "total", (F.col("before") + F.sum("n").over(inside)).alias("end"), "n")

    def at(k):
        return F.max(F.when((F.col("end") - F.col("n") <= k) & (k < F.col("end")), F.col("v")))

    out = []
    for name, q in QUARTILES:
        place = (F.col("total") - 1) * F.lit(q)
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return placed.groupBy("columna").agg(*out)


def column_types(df: DataFrame) -> DataFrame:
    """(columna, posicion, tipo) of the frame."""
    rows = [(f.name, i, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "columna string, posicion int, tipo string")


def profile(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Q19: every column of the frame in one table, one row each.

    columna, tipo, count (non-null), nulos; unique, top, freq for text and boolean
    columns; mean, std, min, p25, p50, p75, max for numeric ones; desde, hasta (as text)
    for dates and timestamps.  What does not apply is null.
    """
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    flags = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    counts = _stack(df.agg(*[F.count(qcol(c)).alias(f"__count{i}") for i, c in enumerate(df.columns)],
                           *[F.count_if(qcol(c).isNull()).alias(f"__nulos{i}") for i, c in enumerate(df.columns)]),
                    df.columns, ["count", "nulos"], {"count": "BIGINT", "nulos": "BIGINT"})
    out = column_types(df).select("columna", "tipo").join(counts, "columna", "left")
    numbers = numeric_columns(df)
    if numbers:
        out = out.join(numeric_profile(df, numbers, digits).drop("count"), "columna", "left")
        out = out.join(numeric_quantiles(df, numbers), "columna", "left")
    words = text_columns(df) + flags
    if words:
        text = df.select(*[qcol(c).cast("string").alias(c) for c in words])
        out = out.join(text_profile(text, words).drop("count"), "columna", "left")
    if dates:
        limits = df.agg(*[f(qcol(c)).cast("string").alias(f"__{n}{i}") for i, c in enumerate(dates)
                          for n, f in (("desde", F.min), ("hasta", F.max))])
        out = out.join(_stack(limits, dates, ["desde", "hasta"], {"desde": "STRING", "hasta": "STRING"}), "columna", "left")
    return out


def text_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, unique, top, freq per text column (nulls excluded, ties -> smallest value)."""
    cols = columns or text_columns(df)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("columna"), qcol(c).alias("valor")) for c in cols]))
    freq = (df.select(pairs.alias("p")).select("p.columna", "p.valor")
            .groupBy("columna", "valor").agg(F.count(F.lit(1)).alias("n")))
    nn = freq.where(F.col("valor").isNotNull())
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("valor").alias("v")))
    return nn.groupBy("columna").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        best.getField("v").alias("top"), (-best.getField("neg")).alias("freq"))


def propose_rules(df: DataFrame, domain: str = "", null_ratio_below: float = 0.05,
                  distinct_ratio_at_least: float = 0.98) -> dict:
    """Q20: a rule document from a profile (thresholds are ours; the original asked a model).

    nulls under 5% -> `nulo`; distinct ratio >= 0.98 -> `duplicado_multicampo`;
    numeric minimum > 0 -> `mayor_a` 0; constant text length -> `longitud_exacta`.
    One aggregate row per statistic is brought to the driver (bounded by the column count).
    """
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        x = qcol(c)
        aggs.append(F.count(x).alias(f"__nn{i}"))
        if c in numeric_columns(df):
            aggs.append(F.min(x.cast("double")).alias(f"__min{i}"))
        if c in text_columns(df):
            aggs += [F.min(F.char_length(x)).alias(f"__lmin{i}"), F.max(F.char_length(x)).alias(f"__lmax{i}")]
    row = df.agg(*aggs).first().asDict()
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), qcol(c).cast("string").alias("v")) for i, c in enumerate(cols)]))
    exact = (df.select(pairs.alias("p")).select("p.i", "p.v").where(F.col("v").isNotNull()).distinct()
             .groupBy("i").agg(F.count(F.lit(1)).alias("d")))
    row |= {f"__d{r['i']}": r["d"] for r in exact.collect()}       # one row per column
    n = row["__n"] or 0
    block = {K.WEIGHTS_KEY: {d: K.DEFAULT_WEIGHT for d in K.DIMENSIONS},
             "Completitud": {}, "Unicidad": {}, "Validez": {}, "Consistencia": {}}
    if n == 0:
        return {K.DIRECTORY_BLOCK if K.DIRECTORY_MARKER in domain else K.DEFAULT_BLOCK: block}
    for i, c in enumerate(cols):
        nulls = n - row[f"__nn{i}"]
        if 0 < nulls / n < null_ratio_below or nulls == 0:
            block["Completitud"][c] = {"regla": K.RULE_BLANK, "penalizacion": 100.0,
                                       "mensaje": f"Falta {c}"}
        if row.get(f"__d{i}", 0) / n >= distinct_ratio_at_least:
            block["Unicidad"][c] = {"regla": K.RULE_DUPLICATE, "penalizacion": 100.0,
                                    "mensaje": f"{c} duplicado"}
        mn = row.get(f"__min{i}")
        if mn is not None and mn > 0:
            block["Validez"][c] = {"regla": K.RULE_GREATER_THAN, "valor": 0, "penalizacion": 50.0,
                                   "mensaje": f"{c} no positivo"}
        lmin, lmax = row.get(f"__lmin{i}"), row.get(f"__lmax{i}")
        if lmin is not None and lmin == lmax and lmin > 0 and c not in block["Validez"]:
            block["Validez"][c] = {"regla": K.RULE_LENGTH, "valor": int(lmin), "penalizacion": 50.0,
                                   "mensaje": f"{c} con longitud invalida"}
    return {K.DIRECTORY_BLOCK if K.DIRECTORY_MARKER in domain else K.DEFAULT_BLOCK: block}


def proposed_rules(df: DataFrame, domain: str = "", **limits) -> DataFrame:
    """Q20 as a table: dimension, columna, regla, valor, penalizacion of every proposed rule."""
    (block,) = propose_rules(df, domain, **limits).values()
    rows = [(d, c, r["regla"], None if r.get("valor") is None else float(r["valor"]), r["penalizacion"])
            for d in K.DIMENSIONS for c, r in block[d].items()]
    return df.sparkSession.createDataFrame(
        rows, "dimension string, columna string, regla string, valor double, penalizacion double")
