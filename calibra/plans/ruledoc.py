"""Rule documents: load, validate, adapt generated rules, merge.

A rule document is a driver-side dict (a few KB); nothing here touches data.

    { "<type>" | "DEFAULT" | "Directorio_Comercial": {
        "pesos_dimensiones": {"Completitud": w, "Unicidad": w, "Validez": w, "Consistencia": w},
        "<Dimension>": { "<column>": {"regla": ..., "penalizacion": ..., "mensaje": ..., ...} } } }
"""

from __future__ import annotations

import copy
import json
import re
from numbers import Number

from calibra import constants as K

KNOWN_RULES = {
    "Unicidad": (K.RULE_DUPLICATE,),
    "Completitud": (K.RULE_BLANK,),
    "Validez": (K.RULE_GREATER_THAN, K.RULE_CATALOG, K.RULE_EMAIL, K.RULE_REGEX,
                K.RULE_PHONE, K.RULE_LENGTH),
    "Consistencia": (K.RULE_GTE_COLUMN,),
}


class RuleError(ValueError):
    """A rule document that cannot be compiled."""


def default_document() -> dict:
    """What an audit uses when no rule file exists: weights and no rules."""
    return {K.DEFAULT_BLOCK: {K.WEIGHTS_KEY: {d: K.DEFAULT_WEIGHT for d in K.DIMENSIONS}}}


def load_document(source, spark=None) -> dict:
    """A rule document from a dict, a JSON text or the path of a JSON file (read through
    Spark, so from any store).  None gives the default; a path that can't be read raises."""
    if source is None:
        return default_document()
    if isinstance(source, dict):
        doc = copy.deepcopy(source)
    elif str(source).lstrip().startswith("{"):
        doc = json.loads(str(source))
    else:
        from pyspark.sql import SparkSession

        from calibra.sources.io import read_text
        doc = json.loads(read_text(spark or SparkSession.active(), str(source)))
    validate_document(doc)
    return doc


def rule_path(folder: str, domain: str) -> str:
    """Where the rule document of a domain is kept."""
    return f"{folder.rstrip('/')}/reglas_{re.sub(r'[^0-9A-Za-z]+', '_', domain).strip('_').lower()}.json"


def save_document(spark, doc: dict, folder: str, domain: str) -> str:
    """Keep the (valid) rule document of a domain; the previous one is replaced."""
    from calibra.sources.io import write_text
    validate_document(doc)
    path = rule_path(folder, domain)
    write_text(spark, path, json.dumps(doc, ensure_ascii=False, indent=1))
    return path


def saved_document(spark, folder: str, domain: str) -> dict | None:
    """The kept rule document of a domain, None when there is none."""
    from calibra.sources.io import exists
    path = rule_path(folder, domain)
    return load_document(path, spark) if exists(spark, path) else None


def validate_document(doc: dict) -> list[str]:
    """Raise RuleError on a document the engine could not run; return warnings.

    Mirrors where the original engine would fail: blocks must be dicts, weights
    numbers, and every rule must name `regla` and `penalizacion`.
    """
    if not isinstance(doc, dict):
        raise RuleError("rule document must be a JSON object")
    warnings: list[str] = []
    for block, body in doc.items():
        if not isinstance(body, dict):
            raise RuleError(f"block {block!r} must be an object")
        weights = body.get(K.WEIGHTS_KEY)
        if weights is not None:
            if not isinstance(weights, dict):
                raise RuleError(f"{block}.{K.WEIGHTS_KEY} must be an object")
            for dim, w in weights.items():
                if not isinstance(w, Number) or isinstance(w, bool):
                    raise RuleError(f"{block}.{K.WEIGHTS_KEY}.{dim} must be a number")
        for dim in K.DIMENSIONS:
            rules = body.get(dim, {})
            if not isinstance(rules, dict):
                raise RuleError(f"{block}.{dim} must be an object")
            for col, cfg in rules.items():
                where = f"{block}.{dim}.{col}"
                if not isinstance(cfg, dict):
                    raise RuleError(f"{where} must be an object")
                if "regla" not in cfg:
                    raise RuleError(f"{where} has no 'regla'")
                if "penalizacion" not in cfg:
                    raise RuleError(f"{where} has no 'penalizacion'")
                p = cfg["penalizacion"]
                if not isinstance(p, Number) or isinstance(p, bool):
                    raise RuleError(f"{where}.penalizacion must be a number")
                if cfg["regla"] not in KNOWN_RULES[dim]:
                    warnings.append(f"{where}: rule {cfg['regla']!r} is not run under {dim}")
    return warnings


#: First match wins; anything else is validity.
_DIMENSION_STEMS = (("complet", "Completitud"), ("unic", "Unicidad"), ("consist", "Consistencia"))

#: (field of a rule record, names it has in a generated rule, default) for the two formats:
#: rules nested under their dimension, and flat items whose rule follows from the dimension.
_NESTED_FIELDS = (("column", K.GENERATED_NESTED_COLUMN, ""), ("rule", K.GENERATED_NESTED_RULE, K.RULE_BLANK),
                  ("penalty", K.GENERATED_NESTED_PENALTY, 50), ("message", K.GENERATED_NESTED_MESSAGE, None))
_FLAT_FIELDS = (("column", K.GENERATED_FLAT_COLUMN, ""), ("penalty", K.GENERATED_FLAT_PENALTY, 50),
                ("message", K.GENERATED_FLAT_MESSAGE, None))


def dimension_named(text) -> str:
    """Quality dimension that a free text names."""
    lowered = str(text).strip().lower()
    return next((name for stem, name in _DIMENSION_STEMS if stem in lowered), "Validez")


def _parsed(rules):
    """Generated rules as data; from a text, what stands between its outer braces."""
    if isinstance(rules, (dict, list)):
        return rules
    text = str(rules)
    first, last = text.find("{"), text.rfind("}")
    return json.loads(text[first:last + 1] if 0 <= first < last else text)


def rule_records(rules) -> list[dict] | None:
    """Generated rules as flat records (dimension, column, rule, penalty, message, extra);
    None when the document holds no list of rules."""
    data = _parsed(rules)
    items = data if isinstance(data, list) else data.get(K.GENERATED_LIST)
    if not items:
        return None
    records = []
    for item in items:
        named = [item[k] for k in K.GENERATED_DIMENSION_FIELDS if k in item]
        dimension = dimension_named(named[0] if named else "")
        nested = item.get(K.GENERATED_NESTED_LIST)
        sources = [(item, _FLAT_FIELDS)] if nested is None else [(r, _NESTED_FIELDS) for r in nested]
        for source, fields in sources:
            record = {"dimension": dimension,
                      "rule": K.RULE_DUPLICATE if dimension == "Unicidad" else K.RULE_BLANK,
                      "extra": {k: source[k] for k in K.GENERATED_PARAMETERS if k in source} if nested is not None else {}}
            record |= {field: source.get(name, default) for field, name, default in fields}
            records.append(record)
    return records


def adapt_generated(rules, domain: str, carry_parameters: bool = True) -> dict | None:
    """Turn generated rules (data or text holding JSON) into a rule document.

    `carry_parameters=False` keeps rule, penalty and message only, like the original
    adapter (quirk Q-2).  Records without a column are left out.
    """
    records = rule_records(rules)
    if records is None:
        return None
    block: dict = {K.WEIGHTS_KEY: dict.fromkeys(K.DIMENSIONS, K.DEFAULT_WEIGHT)} | {d: {} for d in K.DIMENSIONS}
    for r in records:
        column = str(r["column"]).strip()
        if column:
            message = f"Error en {column}" if r["message"] is None else str(r["message"])
            block[r["dimension"]][column] = {
                "regla": str(r["rule"]).strip(), "penalizacion": float(r["penalty"]), "mensaje": message,
                **(r["extra"] if carry_parameters else {})}
    return {K.DIRECTORY_BLOCK if K.DIRECTORY_MARKER in str(domain) else K.DEFAULT_BLOCK: block}


#: Levels at which two documents are merged key by key before the overlay's value wins.
_MERGE_DEPTH = {"replace_dimension": 2, "extend": 3}


def _overlaid(base, overlay, depth: int):
    if depth == 0 or not (isinstance(base, dict) and isinstance(overlay, dict)):
        return copy.deepcopy(overlay)
    return {k: _overlaid(base.get(k), overlay[k], depth - 1) if overlay.get(k) is not None else copy.deepcopy(base[k])
            for k in dict.fromkeys([*base, *overlay]) if k in base or overlay.get(k) is not None}


def merge_documents(base: dict, overlay: dict, mode: str = "replace_dimension") -> dict:
    """Overlay rules on a base document, neither is changed.

    `replace_dimension` (as the original engine does): a dimension of the overlay block
    replaces the base dimension whole.  `extend`: dimensions merge column by column,
    weights key by key.
    """
    if mode not in _MERGE_DEPTH:
        raise ValueError(f"unknown merge mode {mode!r}")
    return _overlaid(base, overlay, _MERGE_DEPTH[mode])


def with_generated(base: dict, generated, domain: str, mode: str = "replace_dimension") -> dict:
    """Base document plus generated rules (a rule document already, or rules to adapt)."""
    ready = isinstance(generated, dict) and bool({K.DEFAULT_BLOCK, K.DIRECTORY_BLOCK} & generated.keys())
    overlay = generated if ready else adapt_generated(generated, domain) if generated else None
    return merge_documents(base, overlay, mode) if overlay else base
