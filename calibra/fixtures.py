"""Deterministic master-data views over the driver tables, plus the rule documents
the registered queries use.

Each view is one SQL text with `{table}` placeholders.  Spark fills them with
DataFrames (`spark.sql(text, part=df)`, no temp views left behind); the DuckDB
oracles fill them with the pre-registered table names.  The texts use only syntax
both engines accept (`STRING`, `%`, `concat`, `CASE`).  No view samples rows:
every view but `audit_target` (which lacks the SKUs that are new by design) covers its
whole source table.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# Audits written before this instant form the existing audit target; SKUs of the
# master with no audit before it are "new" (I1).
AUDIT_CUTOFF = "1995-03-01 00:00:00"

_TARGET = """
SELECT v.l_partkey AS SKU,
       CASE WHEN v.l_linenumber % 2 = 0 THEN 0 ELSE 1 END AS Estado_Gestion,
       CASE WHEN v.l_linenumber % 2 = 1 THEN n.newest ELSE v.l_shipdate END AS Fecha_Actualizacion,
       v.l_orderkey, v.l_linenumber
FROM {lineitem} v JOIN (SELECT l_partkey AS pk, max(l_shipdate) AS newest FROM {lineitem} GROUP BY l_partkey) n
  ON v.l_partkey = n.pk
"""

VIEWS = {
    # product master (from part). Null-like text, duplicate keys, bad numbers,
    # unknown units, wrong lengths, '.0' suffixes, gross < net.
    "materials": """
SELECT p_partkey AS SKU,
       CAST(p_partkey AS STRING) AS SKU_num,
       p_type AS tipo_mat,
       p_name AS Desc_Material,
       p_brand AS grupo_material,
       CASE p_partkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' NaN ' WHEN 3 THEN 'null' ELSE p_brand END AS marca,
       CASE WHEN p_size % 7 = 0 THEN 'xx' WHEN p_size % 2 = 0 THEN 'kg' ELSE 'UN' END AS UoM,
       CASE WHEN p_partkey % 13 = 0 THEN 'n/a' WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_size - 3 AS STRING) END AS peso_neto,
       CAST(p_size % 29 AS STRING) AS peso_bruto,
       CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 9 = 0 THEN CAST(99 + p_partkey AS STRING)
            WHEN p_partkey % 2 = 0 THEN concat(CAST(7700000000000 + p_partkey AS STRING), '.0')
            ELSE CAST(7700000000000 + p_partkey AS STRING) END AS EAN13
FROM {part}""",
    # commercial directory (from customer).
    "directory": """
SELECT c_custkey AS Cliente,
       CASE WHEN c_custkey % 8 = 0 THEN concat(' customer#', CAST(c_custkey % 40 AS STRING), ' ') ELSE c_name END AS Nombre,
       CASE WHEN c_custkey % 6 = 0 THEN 'sin-correo' WHEN c_custkey % 15 = 1 THEN '' WHEN c_custkey % 15 = 2 THEN NULL
            ELSE concat('c', CAST(c_custkey AS STRING), '@mail.example.co') END AS email,
       CASE WHEN c_nationkey % 3 = 0 THEN 'CO' WHEN c_nationkey % 3 = 1 THEN 'PE' ELSE NULL END AS pais,
       CASE c_custkey % 4 WHEN 0 THEN concat('+57 3', CAST(100000000 + c_custkey AS STRING))
            WHEN 1 THEN concat('60', CAST(10000000 + c_custkey AS STRING))
            WHEN 2 THEN concat('+', CAST(51900000000 + c_custkey AS STRING)) ELSE 'tel?' END AS telefono,
       c_mktsegment AS segmento
FROM {customer}""",
    # audit target (from lineitem): the audits written before the cutoff,
    # several rows per SKU, both states; odd line numbers already carry the
    # newest source date of their SKU (so a date sync leaves them unchanged).
    "audit_target": _TARGET + "WHERE v.l_shipdate < TIMESTAMP '" + AUDIT_CUTOFF + "'",
    # the same without the cutoff: every audit
    "audit_target_all": _TARGET,
    # F1e: the master with awkward values: a line break after an id, Java number
    # literals, null types, a column that an audit writes itself.
    "materials_edge": """
SELECT p_partkey AS SKU,
       CASE WHEN p_partkey % 3 = 0 THEN concat(CAST(p_partkey AS STRING), chr(10)) ELSE CAST(p_partkey AS STRING) END AS SKU_num,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS tipo_mat,
       p_name AS Desc_Material, p_brand AS grupo_material,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS marca,
       'KG' AS UoM,
       CASE p_partkey % 4 WHEN 0 THEN concat(CAST(p_size AS STRING), 'd') WHEN 1 THEN concat(CAST(p_size AS STRING), 'f')
            ELSE CAST(p_size AS STRING) END AS peso_neto,
       CAST(p_size AS STRING) AS peso_bruto, CAST(p_partkey AS STRING) AS EAN13,
       CAST(7 AS DOUBLE) AS score_calidad
FROM {part}""",
    # F2n: the directory with a numeric country.
    "directory_numeric": """
SELECT c_custkey AS Cliente, CAST(c_nationkey AS BIGINT) AS pais,
       CASE c_custkey % 3 WHEN 0 THEN concat('+57 3', CAST(100000000 + c_custkey AS STRING)) WHEN 1 THEN '12' ELSE NULL END AS telefono
FROM {customer}""",
    # Two custodians for a type, and a default entry.
    "custodians_twice": """
SELECT DISTINCT p_type AS tipo_mat, concat('b-', lower(p_type), '@example.com') AS custodio FROM {part} WHERE p_type <> 'ECONOMY'
UNION ALL SELECT DISTINCT p_type, concat('a-', lower(p_type), '@example.com') FROM {part} WHERE p_type = 'PROMO'
UNION ALL SELECT 'DEFAULT', 'z@example.com'""",
    # F8: orders with a flag, for the profile.
    "orders_profile": "SELECT *, o_totalprice > 150000 AS alto FROM {orders}",
    # origin versions (from lineitem): many versions per SKU.
    "origin_dates": """
SELECT l_partkey AS SKU, l_shipdate AS fecha_actualiza, l_orderkey, l_linenumber
FROM {lineitem}""",
    # type names and custodians (ECONOMY deliberately missing).
    "type_catalog": """
SELECT DISTINCT p_type AS tipo_mat, concat('Tipo ', p_type) AS nombre,
       concat(lower(p_type), '@example.com') AS custodio
FROM {part} WHERE p_type <> 'ECONOMY'""",
    # F4r: audit runs: when each record's order was audited.
    "audit_runs": """
SELECT l_partkey AS SKU, l_orderkey, l_linenumber, o_orderdate AS fecha_auditoria
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # F4v: origin versions with their identity.
    "origin_versions": """
SELECT l_partkey AS SKU, l_shipdate AS fecha_actualiza, l_orderkey AS origen, l_linenumber AS linea
FROM {lineitem}""",
    # F6d: audit history of several domains, one of them with most of the runs.
    "domain_history": """
SELECT o_orderkey AS id_ejecucion, o_orderdate AS fecha,
       CASE WHEN o_custkey % 9 = 0 THEN 'Directorio' WHEN o_custkey % 17 = 1 THEN NULL ELSE 'Materiales' END AS dominio,
       CAST(o_custkey % 101 AS DOUBLE) AS score_global
FROM {orders}""",
    # audit history (from orders): one run per order.
    "audit_history": """
SELECT concat('AUD_', CAST(o_orderkey AS STRING)) AS id_ejecucion, o_orderdate AS fecha,
       concat('u', CAST(o_custkey % 7 AS STRING)) AS usuario, 'Materials' AS dominio,
       CAST(floor(o_totalprice) AS BIGINT) AS total_registros, CAST(o_custkey % 101 AS DOUBLE) AS score_global
FROM {orders}""",
}

SOURCES = {
    "materials": ("part",),
    "directory": ("customer",),
    "audit_target": ("lineitem",),
    "audit_target_all": ("lineitem",),
    "materials_edge": ("part",),
    "directory_numeric": ("customer",),
    "custodians_twice": ("part",),
    "orders_profile": ("orders",),
    "origin_dates": ("lineitem",),
    "type_catalog": ("part",),
    "audit_history": ("orders",),
    "audit_runs": ("lineitem", "orders"),
    "origin_versions": ("lineitem",),
    "domain_history": ("orders",),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a Spark DataFrame over the parquet tables of `sf_dir`."""
    args = {t: table(spark, sf_dir, t) for t in SOURCES[name]}
    return spark.sql(VIEWS[name], **args)


def view_sql(name: str) -> str:
    """The same view as SQL over the pre-registered oracle tables."""
    return VIEWS[name].format(**{t: t for t in SOURCES[name]})


# ---------------------------------------------------------------------------
# Rule documents and catalogues used by the registered queries
# ---------------------------------------------------------------------------

UNITS = ["KG", "UN"]

# Flagship: five rules, equal weights, one DEFAULT block for every type.
FLAGSHIP_RULES = {
    "DEFAULT": {
        "pesos_dimensiones": {"Completitud": 0.25, "Unicidad": 0.25, "Validez": 0.25, "Consistencia": 0.25},
        "Unicidad": {"Desc_Material": {"regla": "duplicado_multicampo", "penalizacion": 60,
                                       "columnas": ["Desc_Material", "grupo_material", "tipo_mat"],
                                       "mensaje": "Material duplicado"}},
        "Completitud": {"marca": {"regla": "nulo", "penalizacion": 100, "mensaje": "Falta marca"}},
        "Validez": {"peso_neto": {"regla": "mayor_a", "valor": 0, "penalizacion": 50,
                                  "mensaje": "Peso neto no positivo"},
                    "UoM": {"regla": "catalogo", "catalogo_ref": "unidades", "penalizacion": 70,
                            "mensaje": "Unidad fuera de catalogo"}},
        "Consistencia": {"peso_bruto": {"regla": "mayor_o_igual_columna", "columna_ref": "peso_neto",
                                        "penalizacion": 40, "mensaje": "Peso bruto menor que neto"}},
    }
}

# Per-type blocks: a named block replaces DEFAULT; PROMO zero-weights consistency;
# SMALL omits a weight (scored 0.25, shown null); a condition, lists, length and regex.
TYPED_RULES = {
    "DEFAULT": FLAGSHIP_RULES["DEFAULT"],
    "PROMO": {
        "pesos_dimensiones": {"Completitud": 0.4, "Unicidad": 0.2, "Validez": 0.4, "Consistencia": 0.0},
        "Unicidad": {"Desc_Material": {"regla": "duplicado_multicampo", "penalizacion": 30,
                                       "columnas": ["Desc_Material", "grupo_material"],
                                       "whitelist": ["red widget"], "blacklist": ["small ring"],
                                       "mensaje": "Descripcion repetida en el grupo"}},
        "Completitud": {"marca": {"regla": "nulo", "penalizacion": 100, "mensaje": "Falta marca"},
                        "peso_neto": {"regla": "nulo", "penalizacion": 60, "mensaje": "Falta peso neto"}},
        "Validez": {"EAN13": {"regla": "longitud_exacta", "valor": 13, "penalizacion": 45,
                              "mensaje": "EAN13 con longitud invalida"},
                    "UoM": {"regla": "catalogo", "catalogo_ref": "unidades", "penalizacion": 70,
                            "condicion_columna": "grupo_material", "condicion_valor": "Brand#7",
                            "mensaje": "Unidad fuera de catalogo"}},
        "Consistencia": {"peso_bruto": {"regla": "mayor_o_igual_columna", "columna_ref": "peso_neto",
                                        "penalizacion": 40, "mensaje": "Peso bruto menor que neto"}},
    },
    "SMALL": {
        "pesos_dimensiones": {"Completitud": 0.5, "Validez": 0.5},
        "Completitud": {"marca": {"regla": "nulo", "penalizacion": 80, "mensaje": "Falta marca"}},
        "Validez": {"SKU_num": {"regla": "regex_custom", "patron_regex": "^[0-9]*[02468]$",
                                "penalizacion": 150, "mensaje": "SKU impar"},
                    "peso_neto": {"regla": "mayor_a", "valor": 5, "penalizacion": 20,
                                  "mensaje": "Peso neto bajo"}},
    },
}

# Directory domain: e-mail, phone with country, duplicate names.
DIRECTORY_RULES = {
    "Directorio_Comercial": {
        "pesos_dimensiones": {"Completitud": 0.3, "Unicidad": 0.3, "Validez": 0.4, "Consistencia": 0.0},
        "Unicidad": {"Nombre": {"regla": "duplicado_multicampo", "penalizacion": 100,
                                "mensaje": "Nombre duplicado"}},
        "Completitud": {"email": {"regla": "nulo", "penalizacion": 50, "mensaje": "Falta correo"}},
        "Validez": {"email": {"regla": "formato_correo", "penalizacion": 50, "mensaje": "Correo invalido"},
                    "telefono": {"regla": "telefono_colombia", "columna_pais": "pais", "penalizacion": 50,
                                 "mensaje": "Telefono invalido"}},
    }
}

# F7 master changes (from events): rules of the streaming audit.
EVENT_RULES = {
    "DEFAULT": {
        "Unicidad": {"SKU": {"regla": "duplicado_multicampo", "penalizacion": 50, "columnas": ["SKU", "tipo_mat"],
                             "mensaje": "Evento repetido"}},
        "Completitud": {"props": {"regla": "nulo", "penalizacion": 20, "mensaje": "Sin props"}},
        "Validez": {"valor": {"regla": "mayor_a", "valor": 10, "penalizacion": 100, "mensaje": "Valor bajo"}},
    }
}

# The same without uniqueness: judged row by row.
EVENT_ROW_RULES = {"DEFAULT": {k: v for k, v in EVENT_RULES["DEFAULT"].items() if k != "Unicidad"}}


def master_changes(events: DataFrame) -> DataFrame:
    """events as master changes (user_id is the record key, event_type the type)."""
    from pyspark.sql import functions as F
    return events.select("event_id", "ts", F.col("user_id").alias("SKU"), F.col("event_type").alias("tipo_mat"),
                         F.col("value").alias("valor"), "props")
