"""Term search over master tables (Q21) and over reference tables (Q22)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions.text import qcol


def search_rows(tables: Mapping[str, DataFrame], term: str, regex: bool = True) -> DataFrame:
    """Q21: rows of any table where some column, as text, contains the term.

    Case-insensitive; the term is a regular expression unless `regex=False`.
    Tables are unioned by name (missing columns null); every value becomes text and
    a `fuente` column names the table.
    """
    pattern = "(?iu)" + (term if regex else _quote(term))
    out = None
    for name, df in tables.items():
        cond = F.lit(False)
        for c in df.columns:
            cond = cond | F.coalesce(qcol(c).cast("string").rlike(pattern), F.lit(False))
        hit = df.where(cond).select(F.lit(name).alias("fuente"),
                                    *[qcol(c).cast("string").alias(c) for c in df.columns])
        out = hit if out is None else out.unionByName(hit, allowMissingColumns=True)
    return out


def _quote(term: str) -> str:
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def reference_long(nation: DataFrame, region: DataFrame) -> DataFrame:
    """A reference table in long form (hoja, categoria, fila, orden, etiqueta, valor).

    Built from nation and region: the category is the region, one row per nation,
    cells in a fixed order.  Any reference sheet can be brought to this shape.
    """
    j = nation.join(region, nation["n_regionkey"] == region["r_regionkey"], "left")
    cells = F.explode(F.array(
        F.struct(F.lit(1).alias("orden"), F.lit("Nacion").alias("etiqueta"), F.col("n_name").cast("string").alias("valor")),
        F.struct(F.lit(2).alias("orden"), F.lit("Clave").alias("etiqueta"), F.col("n_nationkey").cast("string").alias("valor")),
        F.struct(F.lit(3).alias("orden"), F.lit("Region").alias("etiqueta"), F.col("r_regionkey").cast("string").alias("valor")),
    ))
    return j.select(F.lit("naciones").alias("hoja"), F.col("r_name").alias("categoria"),
                    F.col("n_nationkey").alias("fila"), cells.alias("c")).select(
        "hoja", "categoria", "fila", "c.orden", "c.etiqueta", "c.valor")


def sheet_long(sheet: DataFrame, name: str, row_col: str = "fila") -> DataFrame:
    """A reference sheet as it is kept (first row: categories, each filled rightwards over
    the blanks after it; second row: labels; then data) in long form.

    `row_col` numbers the rows from 0; the other columns are the sheet's, in order.
    Columns before the first category have none and are left out.
    """
    cells = F.posexplode(F.array(*[qcol(c).cast("string") for c in sheet.columns if c != row_col]))
    long = sheet.select(qcol(row_col).alias("fila"), cells.alias("orden", "valor"))
    # one row per sheet column
    rightwards = Window.partitionBy(F.lit(1)).orderBy("orden").rowsBetween(Window.unboundedPreceding, 0)
    heads = long.where("fila = 0").select("orden", F.trim(F.last("valor", ignorenulls=True).over(rightwards)).alias("categoria"))
    labels = long.where("fila = 1").select("orden", F.trim("valor").alias("etiqueta"))
    heads = heads.join(labels, "orden", "left").where(F.col("categoria").isNotNull())
    return long.where("fila > 1").join(F.broadcast(heads), "orden").select(
        F.lit(name).alias("hoja"), "categoria", "fila", "orden", "etiqueta", "valor")


def search_reference(ref_long: DataFrame, term: str) -> DataFrame:
    """Q22: literal, case-insensitive match on the category or on any value of a row.

    A matching row becomes `etiqueta: valor | ...` over its non-empty cells in
    order; rows whose cells are all empty are skipped; lines are de-duplicated.
    A group is one row of a reference table (a few cells), never a large set.
    """
    t = term.lower()
    nonempty = F.col("valor").isNotNull() & (F.trim(F.col("valor")) != F.lit(""))
    per_row = ref_long.groupBy("hoja", "categoria", "fila").agg(
        F.max(F.coalesce(F.instr(F.lower(F.col("valor")), F.lit(t)) > 0, F.lit(False))).alias("mv"),
        F.max(nonempty).alias("any_value"),
        F.sort_array(F.collect_list(F.when(nonempty, F.struct("orden", F.concat_ws(": ", "etiqueta", "valor").alias("par"))))).alias("pares"))
    mc = F.instr(F.lower(F.coalesce(F.col("categoria").cast("string"), F.lit(""))), F.lit(t)) > 0
    hits = per_row.where(F.col("any_value") & (mc | F.col("mv")))
    return hits.select("hoja", F.col("categoria").cast("string").alias("categoria"),
                       F.array_join(F.transform("pares", lambda p: p["par"]), " | ").alias("linea")).distinct()
