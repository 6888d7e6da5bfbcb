"""The audit (A1-A10): one narrow projection plus one aggregate-join per uniqueness key set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra import constants as K
from calibra.functions.text import qcol
from calibra.operators import shaping
from calibra.operators.skew import HOT_KEY_ROWS
from calibra.operators.uniqueness import add_duplicate_markers
from calibra.plans.compiler import CompiledAudit, catalog_marker, compile_document, dup_marker
from calibra.plans.ruledoc import load_document


@dataclass
class AuditResult:
    frame: DataFrame
    plan: CompiledAudit


def prepare(df: DataFrame, domain: str) -> DataFrame:
    """Header trim, domain adapter, shadow drop."""
    df = shaping.trim_headers(df)
    df = shaping.adapt_domain(df, domain)
    return shaping.drop_shadow(df)


def add_catalog_markers(df: DataFrame, columns, codes: DataFrame, hot_key_rows: int) -> DataFrame:
    """One boolean per catalogue column: upper-cased text of the value is a code.

    The code table is reduced to distinct upper-cased codes; the lookup is balanced
    for hot values (a unit used by a third of the rows) like the uniqueness join.
    """
    from calibra.operators.skew import flag_by_key, key_counts
    code = codes.select(F.upper(F.col("code").cast("string")).alias("__calibra_code"))
    for i, col in enumerate(columns):
        name = f"__calibra_cv{i}"
        keyed = df.withColumn(name, F.upper(qcol(col).cast("string")))
        lookup = code.where(F.col("__calibra_code").isNotNull()).distinct().withColumnRenamed("__calibra_code", name)
        counts = key_counts(keyed.select(name), [name])
        df = flag_by_key(keyed, [name], lookup, counts, catalog_marker(i), hot_key_rows).drop(name)
    return df


def _dimension_score(checks, names, dim: str) -> Column:
    """A1 + A2: 100 minus the penalties of failed rules, in rule order, floored at 0."""
    expr = F.lit(100.0)
    for c, n in zip(checks, names):
        if c.dimension == dim:
            expr = expr - F.when(qcol(n), F.lit(c.penalty)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), expr)


def audit(df: DataFrame, rules=None, units=(), domain: str = "Maestro de Materiales",
          user: str | None = None, reference: DataFrame | None = None,
          return_plan: bool = False, hot_key_rows: int = HOT_KEY_ROWS):
    """Score every row of `df` against a rule document.

    Output: input columns (shadow columns dropped) + Score_Unicidad, Score_Completitud,
    Score_Validez, Score_Consistencia, Score_Calidad, Hallazgos_Detallados, one
    `<col>_nulo` flag per completeness rule, Estado_Gestion, Estado_Gestion_Desc,
    Usuario_Auditor.  Row count never changes.

    `reference`: optional frame whose keys also count in uniqueness (quirk Q-8).
    `hot_key_rows`: keys with more rows than this are spread over several tasks.
    Flag columns are a function of the rule document, not of which types the data
    holds, so the schema is stable from run to run.
    """
    doc = load_document(rules)
    base = prepare(df, domain)
    plan = compile_document(doc, base.schema, units)
    input_cols = base.columns

    work = add_duplicate_markers(base, plan.key_sets, dup_marker, reference, hot_key_rows)
    if plan.catalog_columns:
        work = add_catalog_markers(work, plan.catalog_columns, units, hot_key_rows)

    checks = plan.checks
    names = [f"__calibra_f{i}" for i in range(len(checks))]
    work = work.select(*[qcol(c) for c in input_cols], *[c.fail.alias(n) for c, n in zip(checks, names)])

    # A1/A2: dimension scores (masks are mutually exclusive, so one flat chain per dimension)
    dims = {d: _dimension_score(checks, names, d) for d in K.DIMENSIONS}

    # A3/A5: weighted score C, V, U, K with the weights of the row's block.  Rows
    # outside every block have all dimensions at 100 and weights 0.25, so they score
    # exactly 100.  Selecting weights (not whole formulas) per block keeps each
    # dimension -- and so each rule flag -- once in the score expression, which
    # matters when a filter on the score is pushed below this projection.
    def weight(dim: str) -> Column:
        w = None
        for b in plan.blocks:
            w = (F.when(b.mask, F.lit(b.weight(dim))) if w is None
                 else w.when(b.mask, F.lit(b.weight(dim))))
        return F.lit(K.DEFAULT_WEIGHT) if w is None else w.otherwise(F.lit(K.DEFAULT_WEIGHT))

    score = (qcol("__d_Completitud") * weight("Completitud")
             + qcol("__d_Validez") * weight("Validez")
             + qcol("__d_Unicidad") * weight("Unicidad")
             + qcol("__d_Consistencia") * weight("Consistencia"))

    # A4: dimensions of weight 0 (or missing) shown as null for the block's rows
    def shown(dim: str) -> Column:
        nulled = [b.mask for b in plan.blocks if b.nulled(dim)]
        col = qcol(f"__d_{dim}")
        if not nulled:
            return col
        cond = nulled[0]
        for m in nulled[1:]:
            cond = cond | m
        return F.when(F.coalesce(cond, F.lit(False)), F.lit(None).cast("double")).otherwise(col)

    # Findings text, uniqueness -> completeness -> validity -> consistency per block
    parts = [F.when(qcol(n), F.lit(c.message + K.FINDING_SEPARATOR)).otherwise(F.lit(""))
             for c, n in zip(checks, names)]
    findings = F.concat(*parts) if parts else F.lit("")

    # One check flag per completeness rule; an input column of that name is the base
    flags = {}
    for name in plan.flag_names():
        failed = [qcol(n) for c, n in zip(checks, names) if c.flag == name]
        any_fail = failed[0]
        for f in failed[1:]:
            any_fail = any_fail | f
        base_val = qcol(name) if name in input_cols else F.lit(True)
        flags[name] = F.when(any_fail, F.lit(False)).otherwise(base_val)

    scored = work.select("*", *[dims[d].alias(f"__d_{d}") for d in K.DIMENSIONS])
    scored = scored.select("*", score.alias("__score"))

    out_cols = []
    for c in input_cols:
        out_cols.append(flags.pop(c).alias(c) if c in flags else qcol(c))
    out_cols += [
        shown("Unicidad").alias(K.SCORE_UNIQUENESS),
        shown("Completitud").alias(K.SCORE_COMPLETENESS),
        shown("Validez").alias(K.SCORE_VALIDITY),
        shown("Consistencia").alias(K.SCORE_CONSISTENCY),
        qcol("__score").alias(K.SCORE),
        findings.alias(K.FINDINGS),
    ]
    out_cols += [e.alias(n) for n, e in flags.items()]
    good = qcol("__score") >= F.lit(K.GOOD_THRESHOLD)
    out_cols += [
        F.when(good, F.lit(1)).otherwise(F.lit(0)).alias(K.STATUS),
        F.when(good, F.lit(K.STATUS_GOOD_LABEL)).otherwise(F.lit(K.STATUS_BAD_LABEL)).alias(K.STATUS_DESC),
        F.lit(str(user).strip() if user else "").alias(K.AUDITOR),
    ]
    result = scored.select(*out_cols)
    return AuditResult(result, plan) if return_plan else result


def restate(df: DataFrame) -> DataFrame:
    """A10: re-derive status from a stored score (non-numeric or missing -> 100).

    Without a score column every row is 0 / `Malo`.  Duplicate names keep the last.
    """
    df = shaping.dedupe_columns(df)
    if K.SCORE not in df.columns:
        status = F.lit(0)
    else:
        s = F.coalesce(qcol(K.SCORE).try_cast("double"), F.lit(100.0))
        status = F.when(s >= F.lit(K.GOOD_THRESHOLD), F.lit(1)).otherwise(F.lit(0))
    desc = F.when(status == 1, F.lit(K.STATUS_GOOD_LABEL)).otherwise(F.lit(K.STATUS_BAD_LABEL))
    return shaping._set_column(shaping._set_column(df, K.STATUS, status.cast("bigint")), K.STATUS_DESC, desc)
