"""Names and values the audit must reproduce exactly.

Everything below the FIXED VALUES marker is part of the observable contract of an
audit (column names, labels, thresholds, patterns, word lists).  Change none of it
without changing every consumer and test.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must stay equal to the behaviour being reproduced)
# ---------------------------------------------------------------------------

# Rule-document vocabulary.
DIMENSIONS = ("Completitud", "Unicidad", "Validez", "Consistencia")
WEIGHTS_KEY = "pesos_dimensiones"
DEFAULT_BLOCK = "DEFAULT"
DIRECTORY_BLOCK = "Directorio_Comercial"
DEFAULT_WEIGHT = 0.25
RULE_BLANK = "nulo"
RULE_DUPLICATE = "duplicado_multicampo"
RULE_GREATER_THAN = "mayor_a"
RULE_CATALOG = "catalogo"
RULE_EMAIL = "formato_correo"
RULE_REGEX = "regex_custom"
RULE_PHONE = "telefono_colombia"
RULE_LENGTH = "longitud_exacta"
RULE_GTE_COLUMN = "mayor_o_igual_columna"
CATALOG_UNITS = "unidades"
DEFAULT_PHONE_COUNTRY_COLUMN = "Clave de país/región"
PHONE_HOME_COUNTRY = "CO"
PHONE_HOME_PREFIX = "+57"

# Output columns of an audit, in the order they are appended.
SCORE_UNIQUENESS = "Score_Unicidad"
SCORE_COMPLETENESS = "Score_Completitud"
SCORE_VALIDITY = "Score_Validez"
SCORE_CONSISTENCY = "Score_Consistencia"
SCORE = "Score_Calidad"
FINDINGS = "Hallazgos_Detallados"
STATUS = "Estado_Gestion"
STATUS_DESC = "Estado_Gestion_Desc"
AUDITOR = "Usuario_Auditor"
FLAG_SUFFIX = "_nulo"

# Columns dropped from the input before an audit (matched trimmed, case-insensitive).
SHADOW_COLUMNS = (
    "Estado_Gestion",
    "Estado_Gestion_Desc",
    "Score_Calidad",
    "Score_Unicidad",
    "Score_Completitud",
    "Score_Validez",
    "Score_Consistencia",
    "Hallazgos_Detallados",
    "Usuario_Auditor",
)

# Master-data column names the domain adapter and the reports use.
COL_TYPE = "tipo_mat"
COL_DESC = "Desc_Material"
COL_ID_NUM = "SKU_num"
COL_SKU = "SKU"
DIRECTORY_ID_COLUMNS = ("ID DATO", "Cliente", "Proveedor")
DIRECTORY_NAME_COLUMN = "Nombre"
DIRECTORY_MARKER = "Directorio"
DIRECTORY_REPORT_COLUMNS = (
    "SKU_num", "Desc_Material", "Dirección", "Correo electrónico", "Teléfono",
    "Clave de país/región", "Score_Calidad",
)
MATERIAL_REPORT_COLUMNS = ("SKU", "SKU_num", "tipo_mat", "Desc_Material", "Score_Calidad")
EXPLORER_CORE_COLUMNS = ("SKU", "Desc_Material", "Estado_Gestion", "tipo_mat")

# Field names of generated rules.
GENERATED_LIST = "diccionario_reglas"
GENERATED_DIMENSION_FIELDS = ("dimension_dama", "dimension")
GENERATED_NESTED_LIST = "reglas_aplicadas"
GENERATED_NESTED_COLUMN = "nombre_columna"
GENERATED_NESTED_RULE = "regla"
GENERATED_NESTED_PENALTY = "penalizacion"
GENERATED_NESTED_MESSAGE = "mensaje"
GENERATED_FLAT_COLUMN = "columna"
GENERATED_FLAT_PENALTY = "penalizacion_negocio"
GENERATED_FLAT_MESSAGE = "descripcion"
GENERATED_PARAMETERS = ("columnas", "whitelist", "blacklist", "valor", "catalogo_ref", "patron_regex",
                        "columna_pais", "columna_ref", "condicion_columna", "condicion_valor")

# Status.
GOOD_THRESHOLD = 99.99
STATUS_GOOD_LABEL = "Bueno"
STATUS_BAD_LABEL = "Malo"
REMEDIATION_CEILING = 100.0

# Text tokens a completeness check treats as empty (after lower-case and trim).
BLANK_TOKENS = ("", "nan", "nat", "null")

# Findings text.
FINDING_SEPARATOR = ", "
FINDING_MARK = "X"

# Explorer marks and status labels.
MARK_PASS = "✓"
MARK_FAIL = "✗"
MARK_NA = "—"
STATUS_OPEN_LABEL = "Pendiente"
STATUS_DONE_LABEL = "Gestionado"

# Patterns (written for Java regex: (?U) = Unicode classes, \z = end of text).
EMAIL_PATTERN = r"(?U)^[\w.-]+@[\w.-]+\.\w+\z"
PHONE_HOME_PATTERN = r"(?U)^(3\d{9}|60\d{8})\z"
PHONE_OTHER_PATTERN = r"(?U)^\+?[0-9]{7,15}\z"
LENGTH_STRIP_PATTERN = r"\.0\z"

# Health bands of a score (critical below the first, warning below the second).
BAND_CRITICAL_BELOW = 50.0
BAND_WARNING_BELOW = 85.0
BAND_LABELS = ("critical", "warning", "healthy")

# Audit history table.
HISTORY_ID_PREFIX = "AUD_"
HISTORY_ALL_TYPES = "Todos"
HISTORY_COLUMNS = (
    ("id_ejecucion", "string"),
    ("fecha", "timestamp"),
    ("usuario", "string"),
    ("dominio", "string"),
    ("materiales_auditados", "string"),
    ("total_registros", "bigint"),
    ("score_global", "double"),
    ("completitud", "double"),
    ("validez", "double"),
    ("unicidad", "double"),
    ("consistencia", "double"),
)
HISTORY_DISPLAY_COLUMNS = ("fecha", "usuario", "dominio", "score_global", "total_registros")

# Audit-target columns that are always stored as nullable text.
TEXT_TARGET_COLUMNS = ("SKU_MPT", "SKU", "Usuario_Auditor")

# Date used in place of a missing date when dates are compared as text.
MISSING_DATE_TEXT = "1900-01-01"

# Fallback contact when a type has no custodian.
FALLBACK_CUSTODIAN = "sin-custodio@example.com"

# Unicode White_Space property (what a whitespace strip removes), as code points.
UNICODE_WHITESPACE = (
    0x0009, 0x000A, 0x000B, 0x000C, 0x000D, 0x0020, 0x0085, 0x00A0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008,
    0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)

# ---------------------------------------------------------------------------
# end of FIXED VALUES
# ---------------------------------------------------------------------------

WHITESPACE_CHARS = "".join(chr(c) for c in UNICODE_WHITESPACE)
