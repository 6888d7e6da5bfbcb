"""Compile a rule document into column expressions.

The original engine loops types x rules and rewrites whole columns on every step.
Here every block (type) becomes one boolean mask, every rule one boolean failure
flag, and the audit is a single projection over those flags.  Uniqueness rules
need a group count; the compiler only names the key sets, the audit operator
materialises one marker column per distinct key set.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra import constants as K
from calibra.functions import predicates as P
from calibra.functions.text import not_empty_text, qcol
from calibra.plans.ruledoc import validate_document

DIM_ORDER = ("Unicidad", "Completitud", "Validez", "Consistencia")


@dataclass
class Check:
    block: str
    dimension: str
    column: str
    rule: str
    penalty: float
    message: str
    fail: Column               # true when the rule fails for the row (block mask applied)
    flag: str | None = None    # name of the `<col>_nulo` check flag, completeness only


@dataclass
class Block:
    name: str
    mask: Column
    weights: dict              # resolved weights as given (missing dimension -> absent)
    checks: list = field(default_factory=list)

    def weight(self, dim: str) -> float:
        return float(self.weights.get(dim, K.DEFAULT_WEIGHT))

    def nulled(self, dim: str) -> bool:
        """Dimensions shown as null: weight 0 or missing (quirk Q-4)."""
        return float(self.weights.get(dim, 0)) == 0.0


@dataclass
class CompiledAudit:
    blocks: list
    key_sets: list             # distinct tuples of uniqueness key columns
    skipped: list              # (block, dimension, column, reason)
    catalog_columns: list = field(default_factory=list)   # columns checked against a code table

    @property
    def checks(self) -> list:
        return [c for b in self.blocks for c in b.checks]

    def flag_names(self) -> list:
        out = []
        for c in self.checks:
            if c.flag and c.flag not in out:
                out.append(c.flag)
        return out

    def messages(self) -> list:
        return [c.message for c in self.checks]


def dup_marker(i: int) -> str:
    return f"__calibra_dup{i}"


def catalog_marker(i: int) -> str:
    return f"__calibra_cat{i}"


def _truthy_condition(cfg: dict, columns: set):
    col, val = cfg.get("condicion_columna"), cfg.get("condicion_valor")
    if col in columns and val:
        return P.condition(qcol(col), val)
    return None


def _resolve_weights(doc: dict, body: dict) -> dict:
    if K.WEIGHTS_KEY in body:
        return dict(body[K.WEIGHTS_KEY])
    default = doc.get(K.DEFAULT_BLOCK, {})
    if isinstance(default, dict) and K.WEIGHTS_KEY in default:
        return dict(default[K.WEIGHTS_KEY])
    return {d: K.DEFAULT_WEIGHT for d in K.DIMENSIONS}


def block_masks(doc: dict, type_col: Column, type_is_text: bool) -> dict:
    """Mask per block. Named blocks match their type; DEFAULT takes any other
    non-null type.  A non-text type column never matches a named block."""
    named = [k for k in doc if k != K.DEFAULT_BLOCK]
    masks = {}
    for k in named:
        masks[k] = (type_col == F.lit(k)) if type_is_text else F.lit(False)
    if K.DEFAULT_BLOCK in doc:
        m = type_col.isNotNull()
        if type_is_text and named:
            m = m & ~type_col.isin(*named)
        masks[K.DEFAULT_BLOCK] = m
    return masks


def compile_document(doc: dict, schema: T.StructType, units=(),
                     type_column: str = K.COL_TYPE) -> CompiledAudit:
    """`units`: a list of codes (`isin` literals) or a DataFrame with a `code` column
    (large catalogues: the audit adds one balanced lookup per catalogue column)."""
    validate_document(doc)
    columns = {f.name for f in schema.fields}
    types = {f.name: f.dataType for f in schema.fields}
    type_is_text = isinstance(types.get(type_column), T.StringType)
    masks = block_masks(doc, qcol(type_column), type_is_text)
    key_sets: list = []
    skipped: list = []
    blocks: list = []
    catalog_columns: list = []
    units_is_table = hasattr(units, "columns") and hasattr(units, "select")

    for name, body in doc.items():
        if name not in masks:
            continue
        mask = masks[name]
        block = Block(name, mask, _resolve_weights(doc, body))

        def add(dim, col, cfg, fail, flag=None):
            cond = _truthy_condition(cfg, columns)
            if cond is not None:
                fail = fail & cond
            msg = str(cfg.get("mensaje", "") or "")
            block.checks.append(Check(name, dim, col, cfg["regla"], float(cfg["penalizacion"]),
                                      msg, F.coalesce(fail, F.lit(False)), flag))

        for dim in DIM_ORDER:
            for col, cfg in body.get(dim, {}).items():
                if col not in columns:
                    skipped.append((name, dim, col, "column absent"))
                    continue
                rule = cfg["regla"]
                c = qcol(col)
                if dim == "Unicidad":
                    if rule != K.RULE_DUPLICATE:
                        skipped.append((name, dim, col, f"rule {rule} not run"))
                        continue
                    keys = tuple(k for k in cfg.get("columnas", [col]) if k in columns)
                    if not keys:
                        skipped.append((name, dim, col, "no key column present"))
                        continue
                    if keys not in key_sets:
                        key_sets.append(keys)
                    dup = F.coalesce(qcol(dup_marker(key_sets.index(keys))), F.lit(False))
                    fail = mask & dup & not_empty_text(c)
                    if cfg.get("whitelist"):
                        fail = fail & ~P.in_list(c, cfg["whitelist"])
                    if cfg.get("blacklist"):
                        fail = fail | (mask & P.in_list(c, cfg["blacklist"]))
                    add(dim, col, cfg, fail)
                elif dim == "Completitud":
                    if rule != K.RULE_BLANK:
                        skipped.append((name, dim, col, f"rule {rule} not run"))
                        continue
                    add(dim, col, cfg, mask & P.is_blank(c), flag=f"{col}_{rule}")
                elif dim == "Validez":
                    if rule == K.RULE_GREATER_THAN:
                        fail = P.not_greater_than(c, cfg.get("valor", 0))
                    elif rule == K.RULE_CATALOG and cfg.get("catalogo_ref") == K.CATALOG_UNITS:
                        if units_is_table:
                            if col not in catalog_columns:
                                catalog_columns.append(col)
                            found = qcol(catalog_marker(catalog_columns.index(col)))
                            fail = P.not_in_catalog_column(c, F.when(found, F.lit(True)))
                        else:
                            fail = P.not_in_catalog(c, list(units))
                    elif rule == K.RULE_EMAIL:
                        fail = P.bad_email(c)
                    elif rule == K.RULE_REGEX:
                        fail = P.not_matching(c, cfg.get("patron_regex", ""))
                    elif rule == K.RULE_PHONE:
                        country = cfg.get("columna_pais", K.DEFAULT_PHONE_COUNTRY_COLUMN)
                        fail = P.bad_phone(c, qcol(country) if country in columns else None)
                    elif rule == K.RULE_LENGTH:
                        fail = P.bad_length(c, cfg.get("valor", 0))
                    else:
                        skipped.append((name, dim, col, f"rule {rule} not run"))
                        continue
                    add(dim, col, cfg, mask & fail)
                else:
                    ref = cfg.get("columna_ref")
                    if rule != K.RULE_GTE_COLUMN or not ref or ref not in columns:
                        skipped.append((name, dim, col, f"rule {rule} not run"))
                        continue
                    add(dim, col, cfg, mask & P.less_than_column(c, qcol(ref)))
        blocks.append(block)
    return CompiledAudit(blocks, key_sets, skipped, catalog_columns)
