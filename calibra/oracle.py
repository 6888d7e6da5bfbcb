"""Oracle SQL (DuckDB) for the registered queries.

Written by hand from the rule semantics, independently of the Spark compiler: each
audit below spells out its rules, masks, penalties and weights as plain SQL.  The
fixture views come from `calibra.fixtures` (the inputs are shared, the logic is not).
"""

from __future__ import annotations

from calibra.fixtures import view_sql


def _trim(x: str) -> str:
    """Strip leading/trailing whitespace."""
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _key(x: str) -> str:
    return f"upper({_trim(f'coalesce(CAST({x} AS STRING), {chr(39)}{chr(39)})')})"


def _blank(x: str) -> str:
    return f"({x} IS NULL OR {_trim(f'lower(CAST({x} AS STRING))')} IN ('', 'nan', 'nat', 'null'))"


def _num(x: str) -> str:
    return f"coalesce(TRY_CAST({x} AS DOUBLE), CAST(0 AS DOUBLE))"


def _ne(x: str) -> str:
    return f"({x} IS NOT NULL AND CAST({x} AS STRING) <> '')"


def _pen(flag: str, p: int) -> str:
    return f"CASE WHEN {flag} THEN {p} ELSE 0 END"


def _msg(flag: str, m: str) -> str:
    return f"CASE WHEN {flag} THEN '{m}, ' ELSE '' END"


def _d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


MATERIAL_COLS = "SKU, SKU_num, tipo_mat, Desc_Material, grupo_material, marca, UoM, peso_neto, peso_bruto, EAN13"


def flagship_audit(src: str) -> str:
    """CTE body list ending in `audited`: FLAGSHIP rules over relation `src`."""
    return f"""
mk AS (SELECT *, {_key('Desc_Material')} AS k1, {_key('grupo_material')} AS k2, {_key('tipo_mat')} AS k3 FROM {src}),
dup3 AS (SELECT k1, k2, k3 FROM mk GROUP BY k1, k2, k3 HAVING count(*) > 1),
fl AS (
  SELECT mk.*,
    coalesce(mk.tipo_mat IS NOT NULL AND d.k1 IS NOT NULL AND {_ne('mk.Desc_Material')}, false) AS f_dup,
    coalesce(mk.tipo_mat IS NOT NULL AND {_blank('mk.marca')}, false) AS f_marca,
    coalesce(mk.tipo_mat IS NOT NULL AND mk.peso_neto IS NOT NULL AND {_num('mk.peso_neto')} <= 0, false) AS f_neto,
    coalesce(mk.tipo_mat IS NOT NULL AND {_ne('mk.UoM')} AND upper(mk.UoM) NOT IN ('KG', 'UN'), false) AS f_uom,
    coalesce(mk.tipo_mat IS NOT NULL AND mk.peso_bruto IS NOT NULL AND {_num('mk.peso_bruto')} < {_num('mk.peso_neto')}, false) AS f_bruto
  FROM mk LEFT JOIN dup3 d ON mk.k1 = d.k1 AND mk.k2 = d.k2 AND mk.k3 = d.k3),
sc AS (
  SELECT *,
    greatest({_d(0)}, {_d(100)} - {_pen('f_dup', 60)}) AS su,
    greatest({_d(0)}, {_d(100)} - {_pen('f_marca', 100)}) AS sc_,
    greatest({_d(0)}, {_d(100)} - {_pen('f_neto', 50)} - {_pen('f_uom', 70)}) AS sv,
    greatest({_d(0)}, {_d(100)} - {_pen('f_bruto', 40)}) AS sk
  FROM fl),
sq AS (
  SELECT *, CASE WHEN tipo_mat IS NOT NULL
                 THEN sc_ * {_d(0.25)} + sv * {_d(0.25)} + su * {_d(0.25)} + sk * {_d(0.25)}
                 ELSE {_d(100)} END AS score
  FROM sc),
audited AS (
  SELECT {MATERIAL_COLS},
    su AS Score_Unicidad, sc_ AS Score_Completitud, sv AS Score_Validez, sk AS Score_Consistencia,
    score AS Score_Calidad,
    concat({_msg('f_dup', 'Material duplicado')}, {_msg('f_marca', 'Falta marca')},
           {_msg('f_neto', 'Peso neto no positivo')}, {_msg('f_uom', 'Unidad fuera de catalogo')},
           {_msg('f_bruto', 'Peso bruto menor que neto')}) AS Hallazgos_Detallados,
    NOT f_marca AS marca_nulo,
    CASE WHEN score >= 99.99 THEN 1 ELSE 0 END AS Estado_Gestion,
    CASE WHEN score >= 99.99 THEN 'Bueno' ELSE 'Malo' END AS Estado_Gestion_Desc,
    'auditor@example.com' AS Usuario_Auditor
  FROM sq)"""


def typed_audit(src: str = "materials") -> str:
    """CTE body list ending in `audited`: TYPED rules (DEFAULT, PROMO, SMALL blocks)."""
    md = "(mk.tipo_mat IS NOT NULL AND mk.tipo_mat NOT IN ('PROMO', 'SMALL'))"
    mp = "(mk.tipo_mat = 'PROMO')"
    ms = "(mk.tipo_mat = 'SMALL')"
    desc_norm = f"upper({_trim('CAST(mk.Desc_Material AS STRING)')})"
    ean = "regexp_replace(CAST(mk.EAN13 AS STRING), '\\.0$', '')"
    return f"""
mk AS (SELECT *, {_key('Desc_Material')} AS k1, {_key('grupo_material')} AS k2, {_key('tipo_mat')} AS k3 FROM {src}),
dup3 AS (SELECT k1, k2, k3 FROM mk GROUP BY k1, k2, k3 HAVING count(*) > 1),
dup2 AS (SELECT k1, k2 FROM mk GROUP BY k1, k2 HAVING count(*) > 1),
fl AS (
  SELECT mk.*,
    {md} AS is_d, {mp} AS is_p, {ms} AS is_s,
    coalesce({md} AND d3.k1 IS NOT NULL AND {_ne('mk.Desc_Material')}, false) AS d_u,
    coalesce({md} AND {_blank('mk.marca')}, false) AS d_c,
    coalesce({md} AND mk.peso_neto IS NOT NULL AND {_num('mk.peso_neto')} <= 0, false) AS d_v1,
    coalesce({md} AND {_ne('mk.UoM')} AND upper(mk.UoM) NOT IN ('KG', 'UN'), false) AS d_v2,
    coalesce({md} AND mk.peso_bruto IS NOT NULL AND {_num('mk.peso_bruto')} < {_num('mk.peso_neto')}, false) AS d_k,
    coalesce((({mp} AND d2.k1 IS NOT NULL AND {_ne('mk.Desc_Material')}) AND NOT ({desc_norm} IN ('RED WIDGET')))
             OR ({mp} AND {desc_norm} IN ('SMALL RING')), false) AS p_u,
    coalesce({mp} AND {_blank('mk.marca')}, false) AS p_c1,
    coalesce({mp} AND {_blank('mk.peso_neto')}, false) AS p_c2,
    coalesce({mp} AND {ean} <> 'nan' AND {ean} <> '' AND length({ean}) <> 13, false) AS p_v1,
    coalesce({mp} AND {_ne('mk.UoM')} AND upper(mk.UoM) NOT IN ('KG', 'UN')
             AND CAST(mk.grupo_material AS STRING) = 'Brand#7', false) AS p_v2,
    coalesce({mp} AND mk.peso_bruto IS NOT NULL AND {_num('mk.peso_bruto')} < {_num('mk.peso_neto')}, false) AS p_k,
    coalesce({ms} AND {_blank('mk.marca')}, false) AS s_c,
    coalesce({ms} AND {_ne('mk.SKU_num')} AND NOT regexp_matches(CAST(mk.SKU_num AS STRING), '^[0-9]*[02468]$'), false) AS s_v1,
    coalesce({ms} AND mk.peso_neto IS NOT NULL AND {_num('mk.peso_neto')} <= 5, false) AS s_v2
  FROM mk
  LEFT JOIN dup3 d3 ON mk.k1 = d3.k1 AND mk.k2 = d3.k2 AND mk.k3 = d3.k3
  LEFT JOIN dup2 d2 ON mk.k1 = d2.k1 AND mk.k2 = d2.k2),
sc AS (
  SELECT *,
    CASE WHEN is_d THEN greatest({_d(0)}, {_d(100)} - {_pen('d_u', 60)})
         WHEN is_p THEN greatest({_d(0)}, {_d(100)} - {_pen('p_u', 30)})
         ELSE {_d(100)} END AS ru,
    CASE WHEN is_d THEN greatest({_d(0)}, {_d(100)} - {_pen('d_c', 100)})
         WHEN is_p THEN greatest({_d(0)}, {_d(100)} - {_pen('p_c1', 100)} - {_pen('p_c2', 60)})
         WHEN is_s THEN greatest({_d(0)}, {_d(100)} - {_pen('s_c', 80)})
         ELSE {_d(100)} END AS rc,
    CASE WHEN is_d THEN greatest({_d(0)}, {_d(100)} - {_pen('d_v1', 50)} - {_pen('d_v2', 70)})
         WHEN is_p THEN greatest({_d(0)}, {_d(100)} - {_pen('p_v1', 45)} - {_pen('p_v2', 70)})
         WHEN is_s THEN greatest({_d(0)}, {_d(100)} - {_pen('s_v1', 150)} - {_pen('s_v2', 20)})
         ELSE {_d(100)} END AS rv,
    CASE WHEN is_d THEN greatest({_d(0)}, {_d(100)} - {_pen('d_k', 40)})
         WHEN is_p THEN greatest({_d(0)}, {_d(100)} - {_pen('p_k', 40)})
         ELSE {_d(100)} END AS rk
  FROM fl),
sq AS (
  SELECT *,
    CASE WHEN is_d THEN rc * {_d(0.25)} + rv * {_d(0.25)} + ru * {_d(0.25)} + rk * {_d(0.25)}
         WHEN is_p THEN rc * {_d(0.4)} + rv * {_d(0.4)} + ru * {_d(0.2)} + rk * {_d(0.0)}
         WHEN is_s THEN rc * {_d(0.5)} + rv * {_d(0.5)} + ru * {_d(0.25)} + rk * {_d(0.25)}
         ELSE {_d(100)} END AS score
  FROM sc),
audited AS (
  SELECT {MATERIAL_COLS},
    CASE WHEN is_s THEN NULL ELSE ru END AS Score_Unicidad,
    rc AS Score_Completitud, rv AS Score_Validez,
    CASE WHEN is_p OR is_s THEN NULL ELSE rk END AS Score_Consistencia,
    score AS Score_Calidad,
    concat({_msg('d_u', 'Material duplicado')}, {_msg('d_c', 'Falta marca')},
           {_msg('d_v1', 'Peso neto no positivo')}, {_msg('d_v2', 'Unidad fuera de catalogo')},
           {_msg('d_k', 'Peso bruto menor que neto')},
           {_msg('p_u', 'Descripcion repetida en el grupo')}, {_msg('p_c1', 'Falta marca')},
           {_msg('p_c2', 'Falta peso neto')}, {_msg('p_v1', 'EAN13 con longitud invalida')},
           {_msg('p_v2', 'Unidad fuera de catalogo')}, {_msg('p_k', 'Peso bruto menor que neto')},
           {_msg('s_c', 'Falta marca')}, {_msg('s_v1', 'SKU impar')}, {_msg('s_v2', 'Peso neto bajo')}
    ) AS Hallazgos_Detallados,
    NOT (d_c OR p_c1 OR s_c) AS marca_nulo,
    NOT p_c2 AS peso_neto_nulo,
    CASE WHEN score >= 99.99 THEN 1 ELSE 0 END AS Estado_Gestion,
    CASE WHEN score >= 99.99 THEN 'Bueno' ELSE 'Malo' END AS Estado_Gestion_Desc,
    'auditor@example.com' AS Usuario_Auditor
  FROM sq)"""


def directory_audit() -> str:
    tel = "replace(replace(CAST(telefono AS STRING), ' ', ''), '+57', '')"
    return f"""
ad AS (SELECT Cliente, Nombre, email, pais, telefono, segmento,
              CAST(Cliente AS STRING) AS SKU_num, Nombre AS Desc_Material,
              'Directorio_Comercial' AS tipo_mat, {_key('Nombre')} AS kn
       FROM directory),
dupn AS (SELECT kn FROM ad GROUP BY kn HAVING count(*) > 1),
fl AS (
  SELECT ad.*,
    coalesce(dn.kn IS NOT NULL AND {_ne('ad.Nombre')}, false) AS f_u,
    coalesce({_blank('ad.email')}, false) AS f_c,
    coalesce({_ne('ad.email')} AND NOT regexp_matches(CAST(ad.email AS STRING), '^[\\w\\.-]+@[\\w\\.-]+\\.\\w+$'), false) AS f_v1,
    coalesce({_ne('ad.telefono')} AND (
        (ad.pais = 'CO' AND NOT regexp_matches({tel}, '^(3\\d{{9}}|60\\d{{8}})$'))
        OR (ad.pais <> 'CO' AND NOT regexp_matches({tel}, '^\\+?[0-9]{{7,15}}$'))), false) AS f_v2
  FROM ad LEFT JOIN dupn dn ON ad.kn = dn.kn),
sc AS (
  SELECT *,
    greatest({_d(0)}, {_d(100)} - {_pen('f_u', 100)}) AS ru,
    greatest({_d(0)}, {_d(100)} - {_pen('f_c', 50)}) AS rc,
    greatest({_d(0)}, {_d(100)} - {_pen('f_v1', 50)} - {_pen('f_v2', 50)}) AS rv,
    {_d(100)} AS rk
  FROM fl),
sq AS (SELECT *, rc * {_d(0.3)} + rv * {_d(0.4)} + ru * {_d(0.3)} + rk * {_d(0.0)} AS score FROM sc),
audited AS (
  SELECT Cliente, Nombre, email, pais, telefono, segmento, SKU_num, Desc_Material, tipo_mat,
    ru AS Score_Unicidad, rc AS Score_Completitud, rv AS Score_Validez,
    CAST(NULL AS DOUBLE) AS Score_Consistencia, score AS Score_Calidad,
    concat({_msg('f_u', 'Nombre duplicado')}, {_msg('f_c', 'Falta correo')},
           {_msg('f_v1', 'Correo invalido')}, {_msg('f_v2', 'Telefono invalido')}) AS Hallazgos_Detallados,
    NOT f_c AS email_nulo,
    CASE WHEN score >= 99.99 THEN 1 ELSE 0 END AS Estado_Gestion,
    CASE WHEN score >= 99.99 THEN 'Bueno' ELSE 'Malo' END AS Estado_Gestion_Desc,
    'auditor@example.com' AS Usuario_Auditor
  FROM sq)"""


def _with(*views: str) -> str:
    return "WITH " + ",\n".join(f"{v} AS ({view_sql(v)})" for v in views)


FLAG = _with("materials") + "," + flagship_audit("materials")
TYPED = _with("materials") + "," + typed_audit("materials")
TYPED_CAT = _with("materials", "type_catalog") + "," + typed_audit("materials")
DIRA = _with("directory") + "," + directory_audit()


def _band(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 'critical' WHEN {x} < 50 THEN 'critical' "
            f"WHEN {x} < 85 THEN 'warning' ELSE 'healthy' END")


def _clamp(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN {_d(0)} ELSE least({_d(100)}, greatest({_d(0)}, {x})) END"


def _pieces(src: str) -> str:
    """Distinct trimmed findings of relation `src` (split on ', ', drop blank/ignored)."""
    return f"""SELECT DISTINCT {_trim('p')} AS falla FROM (
      SELECT unnest(string_split(coalesce(Hallazgos_Detallados, ''), ', ')) AS p FROM {src}) x
    WHERE p <> '' AND p <> 'nan' AND {_trim('p')} <> 'Sin Errores'"""


def _rule(view: str, key: str, col: str, fail: str) -> str:
    return f"{_with(view)} SELECT {key}, {col}, coalesce({fail}, false) AS falla FROM {view}"


def _ean_canon() -> str:
    s = _trim("CAST(EAN13 AS STRING)")
    cut = f"regexp_replace({s}, '\\.0$', '')"
    return (f"CASE WHEN EAN13 IS NULL THEN '' WHEN length({s}) > 2 AND ends_with({s}, '.0') "
            f"AND regexp_matches(replace({cut}, '-', ''), '^[0-9]+$') THEN {cut} ELSE {s} END")


_PROFILE_NUM = " UNION ALL ".join(
    f"SELECT '{c}' AS columna, count({c}) AS count, round_even(avg(CAST({c} AS DOUBLE)), 6) AS mean, "
    f"round_even(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, "
    f"CAST(max({c}) AS DOUBLE) AS max FROM lineitem"
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax"))

_PROFILE_TXT = " UNION ALL ".join(
    f"SELECT '{c}' AS columna, CAST(sum(n) AS BIGINT) AS count, count(*) AS unique, "
    f"first(v ORDER BY n DESC, v ASC) AS top, max(n) AS freq "
    f"FROM (SELECT {c} AS v, count(*) AS n FROM materials WHERE {c} IS NOT NULL GROUP BY {c}) g"
    for c in ("SKU_num", "tipo_mat", "Desc_Material", "grupo_material", "marca", "UoM", "peso_neto",
              "peso_bruto", "EAN13"))

_TYPED_MESSAGES = ("Descripcion repetida en el grupo", "EAN13 con longitud invalida", "Falta marca", "Falta peso neto",
                   "Material duplicado", "Peso bruto menor que neto", "Peso neto bajo", "Peso neto no positivo",
                   "SKU impar", "Unidad fuera de catalogo")
_WIDE = "SKU, SKU_num, tipo_mat, Desc_Material, round_even(Score_Calidad, 1) AS Score_Calidad, " + ", ".join(
    f"CASE WHEN contains(Hallazgos_Detallados, '{m}') THEN 'X' ELSE '' END AS \"{m}\"" for m in _TYPED_MESSAGES)

_QUANTILES = " UNION ALL ".join(
    f"SELECT '{c}' AS columna, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS p25, "
    f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS p50, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS p75 FROM lineitem"
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax"))


_ORDER_COLUMNS = (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
                  ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"), ("alto", "boolean"))


def _profile_row(column: str, kind: str, source: str) -> str:
    number, word, date = (kind in k for k in (("bigint", "int", "double"), ("string", "boolean"), ("timestamp_ntz",)))
    x, t = f"CAST({column} AS DOUBLE)", f"CAST({column} AS STRING)"
    top = f"(SELECT {{}} FROM (SELECT {t} AS v, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1) g)"

    def when(ok: bool, sql: str, null: str) -> str:
        return sql if ok else f"CAST(NULL AS {null})"
    return f"""SELECT '{column}' AS columna, '{kind}' AS tipo, count({column}) AS count, count(*) - count({column}) AS nulos,
  {when(number, f'round_even(avg({x}), 6)', 'DOUBLE')} AS mean, {when(number, f'round_even(stddev_samp({x}), 6)', 'DOUBLE')} AS std,
  {when(number, f'min({x})', 'DOUBLE')} AS min, {when(number, f'max({x})', 'DOUBLE')} AS max,
  {when(number, f'quantile_cont({x}, 0.25)', 'DOUBLE')} AS p25, {when(number, f'quantile_cont({x}, 0.5)', 'DOUBLE')} AS p50,
  {when(number, f'quantile_cont({x}, 0.75)', 'DOUBLE')} AS p75,
  {when(word, top.format('count(*)'), 'BIGINT')} AS unique, {when(word, top.format('first(v ORDER BY n DESC, v ASC)'), 'STRING')} AS top,
  {when(word, top.format('max(n)'), 'BIGINT')} AS freq,
  {when(date, f'CAST(min({column}) AS STRING)', 'STRING')} AS desde, {when(date, f'CAST(max({column}) AS STRING)', 'STRING')} AS hasta
FROM {source}"""


def _proposed() -> str:
    """Proposed rules of the master: every statistic and threshold spelled out."""
    words = [c.strip() for c in MATERIAL_COLS.split(",")]
    rows = []
    for c in words:
        rows.append(f"""SELECT 'Completitud', '{c}', 'nulo', NULL, 100.0 FROM materials
  HAVING count(*) > 0 AND (count(*) - count({c})) * 1.0 / count(*) < 0.05""")
        rows.append(f"""SELECT 'Unicidad', '{c}', 'duplicado_multicampo', NULL, 100.0 FROM materials
  HAVING count(DISTINCT {c}) * 1.0 / count(*) >= 0.98""")
        if c == "SKU":
            rows.append(f"SELECT 'Validez', '{c}', 'mayor_a', 0.0, 50.0 FROM materials HAVING min({c}) > 0")
        else:
            rows.append(f"""SELECT 'Validez', '{c}', 'longitud_exacta', min(length({c})), 50.0 FROM materials
  HAVING min(length({c})) = max(length({c})) AND min(length({c})) > 0""")
    union = " UNION ALL ".join(f"SELECT * FROM ({r}) x(dimension, columna, regla, valor, penalizacion)" for r in rows)
    return (f"{_with('materials')} SELECT dimension, columna, regla, CAST(valor AS DOUBLE) AS valor, "
            f"CAST(penalizacion AS DOUBLE) AS penalizacion FROM ({union}) u")


_SEARCH_PATTERN = "(?i)brand#1[0-3]\\b|customer#00000001"


def _search_side(view: str, cols: list[str]) -> str:
    cond = " OR ".join(f"coalesce(regexp_matches(CAST({c} AS STRING), '{_SEARCH_PATTERN}'), false)" for c in cols)
    sel = ", ".join(f"CAST({c} AS STRING) AS {c}" for c in cols)
    return f"SELECT '{view}' AS fuente, {sel} FROM {view} WHERE {cond}"


def _reference(term: str) -> str:
    t = term.lower()
    return f"""WITH cells AS (
  SELECT 'naciones' AS hoja, r.r_name AS categoria,
         CAST(n.n_name AS STRING) AS a, CAST(n.n_nationkey AS STRING) AS b, CAST(r.r_regionkey AS STRING) AS c
  FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)
SELECT DISTINCT hoja, CAST(categoria AS STRING) AS categoria,
  concat_ws(' | ', CASE WHEN a IS NOT NULL AND trim(a) <> '' THEN 'Nacion: ' || a END,
                   CASE WHEN b IS NOT NULL AND trim(b) <> '' THEN 'Clave: ' || b END,
                   CASE WHEN c IS NOT NULL AND trim(c) <> '' THEN 'Region: ' || c END) AS linea
FROM cells
WHERE (coalesce(a, '') <> '' OR coalesce(b, '') <> '' OR coalesce(c, '') <> '')
  AND (contains(lower(coalesce(CAST(categoria AS STRING), '')), '{t}')
       OR contains(lower(coalesce(a, '')), '{t}') OR contains(lower(coalesce(b, '')), '{t}')
       OR contains(lower(coalesce(c, '')), '{t}'))"""


_NEW = f"""{_with('materials', 'audit_target')},
newr AS (SELECT m.* FROM materials m WHERE NOT EXISTS (
  SELECT 1 FROM audit_target t WHERE CAST(t.SKU AS STRING) = CAST(m.SKU AS STRING)))"""


ORACLE: dict[str, str] = {
    "audit_flagship": f"{FLAG} SELECT * FROM audited",
    "rule_blank": _rule("materials", "SKU", "marca", _blank("marca")),
    "rule_duplicate": f"""{_with('materials')},
mk AS (SELECT *, {_key('Desc_Material')} AS k1, {_key('grupo_material')} AS k2, {_key('tipo_mat')} AS k3 FROM materials),
d AS (SELECT k1, k2, k3 FROM mk GROUP BY k1, k2, k3 HAVING count(*) > 1)
SELECT mk.SKU, mk.Desc_Material, mk.grupo_material, mk.tipo_mat, d.k1 IS NOT NULL AS is_duplicate
FROM mk LEFT JOIN d ON mk.k1 = d.k1 AND mk.k2 = d.k2 AND mk.k3 = d.k3""",
    "rule_duplicate_lists": f"""{_with('materials')},
mk AS (SELECT *, {_key('Desc_Material')} AS k1, {_key('grupo_material')} AS k2 FROM materials),
d AS (SELECT k1, k2 FROM mk GROUP BY k1, k2 HAVING count(*) > 1),
fl AS (SELECT mk.*, coalesce(((mk.tipo_mat = 'PROMO' AND d.k1 IS NOT NULL AND {_ne('mk.Desc_Material')})
          AND NOT (upper({_trim('mk.Desc_Material')}) IN ('RED WIDGET')))
          OR (mk.tipo_mat = 'PROMO' AND upper({_trim('mk.Desc_Material')}) IN ('SMALL RING')), false) AS f
       FROM mk LEFT JOIN d ON mk.k1 = d.k1 AND mk.k2 = d.k2),
s AS (SELECT *, CASE WHEN tipo_mat = 'PROMO' THEN greatest({_d(0)}, {_d(100)} - {_pen('f', 30)}) ELSE {_d(100)} END AS u FROM fl)
SELECT SKU, tipo_mat, u AS Score_Unicidad,
  CASE WHEN tipo_mat = 'PROMO' THEN {_d(100)} * {_d(0.25)} + {_d(100)} * {_d(0.25)} + u * {_d(0.25)} + {_d(100)} * {_d(0.25)}
       ELSE {_d(100)} END AS Score_Calidad,
  {_msg('f', 'Descripcion repetida en el grupo')} AS Hallazgos_Detallados
FROM s""",
    "rule_greater_than": _rule("materials", "SKU", "peso_neto", f"{_num('peso_neto')} <= 0 AND peso_neto IS NOT NULL"),
    "rule_catalog": _rule("materials", "SKU", "UoM", f"upper(UoM) NOT IN ('KG', 'UN') AND {_ne('UoM')}"),
    "rule_regex": _rule("materials", "SKU", "SKU_num",
                        f"{_ne('SKU_num')} AND NOT regexp_matches(SKU_num, '^[0-9]*[02468]$')"),
    "rule_length": _rule("materials", "SKU", "EAN13",
                         "regexp_replace(EAN13, '\\.0$', '') <> 'nan' AND regexp_replace(EAN13, '\\.0$', '') <> '' "
                         "AND length(regexp_replace(EAN13, '\\.0$', '')) <> 13"),
    "rule_column_compare": f"""{_with('materials')} SELECT SKU, peso_bruto, peso_neto,
  coalesce({_num('peso_bruto')} < {_num('peso_neto')} AND peso_bruto IS NOT NULL, false) AS falla FROM materials""",
    "rule_conditional": f"""{_with('materials')},
fl AS (SELECT *, coalesce(tipo_mat IS NOT NULL AND {_ne('UoM')} AND upper(UoM) NOT IN ('KG', 'UN')
                          AND CAST(grupo_material AS STRING) = 'Brand#7', false) AS f FROM materials),
s AS (SELECT *, CASE WHEN tipo_mat IS NOT NULL THEN greatest({_d(0)}, {_d(100)} - {_pen('f', 70)}) ELSE {_d(100)} END AS v FROM fl)
SELECT SKU, grupo_material, UoM, v AS Score_Validez,
  CASE WHEN tipo_mat IS NOT NULL THEN {_d(100)} * {_d(0.25)} + v * {_d(0.25)} + {_d(100)} * {_d(0.25)} + {_d(100)} * {_d(0.25)}
       ELSE {_d(100)} END AS Score_Calidad,
  {_msg('f', 'Unidad fuera de catalogo')} AS Hallazgos_Detallados FROM s""",
    "blocks_by_type": f"{TYPED} SELECT * FROM audited",
    "zero_weight": f"""{TYPED} SELECT tipo_mat, count(*) AS filas, count(Score_Unicidad) AS con_unicidad,
  count(Score_Consistencia) AS con_consistencia, max(Score_Calidad) AS score_max, min(Score_Calidad) AS score_min
FROM audited GROUP BY tipo_mat""",
    "check_flags": f"{TYPED} SELECT SKU, tipo_mat, marca_nulo, peso_neto_nulo FROM audited",
    "restate_status": f"""{TYPED} SELECT SKU,
  CAST(CASE WHEN coalesce(TRY_CAST(Score_Calidad AS DOUBLE), {_d(100)}) >= 99.99 THEN 1 ELSE 0 END AS BIGINT) AS Estado_Gestion,
  CASE WHEN coalesce(TRY_CAST(Score_Calidad AS DOUBLE), {_d(100)}) >= 99.99 THEN 'Bueno' ELSE 'Malo' END AS Estado_Gestion_Desc
FROM audited""",
    "summary_global": f"""{FLAG} SELECT round_even(avg(Score_Calidad), 6) AS score_global,
  round_even(avg(Score_Completitud), 6) AS completitud, round_even(avg(Score_Validez), 6) AS validez,
  round_even(avg(Score_Unicidad), 6) AS unicidad, round_even(avg(Score_Consistencia), 6) AS consistencia
FROM audited""",
    "summary_filtered": f"""{TYPED} SELECT
  round_even(CASE WHEN count(*) = 0 THEN 0 ELSE avg(Score_Calidad) END, 6) AS score_global,
  round_even(CASE WHEN count(*) = 0 THEN 0 ELSE avg(Score_Completitud) END, 6) AS completitud,
  round_even(CASE WHEN count(*) = 0 THEN 0 ELSE avg(Score_Validez) END, 6) AS validez,
  round_even(CASE WHEN count(*) = 0 THEN 0 ELSE avg(Score_Unicidad) END, 6) AS unicidad,
  round_even(CASE WHEN count(*) = 0 THEN 0 ELSE avg(Score_Consistencia) END, 6) AS consistencia
FROM audited WHERE tipo_mat IN ('PROMO', 'SMALL')""",
    "present_types": f"""{TYPED_CAT} SELECT DISTINCT tipo_mat FROM audited
WHERE tipo_mat IS NOT NULL AND tipo_mat IN (SELECT tipo_mat FROM type_catalog) ORDER BY tipo_mat""",
    "distinct_findings": f"""{TYPED}, lite AS (SELECT * FROM audited WHERE Score_Calidad < 100)
{_pieces('lite')} ORDER BY falla""",
    "remediation_matrix": f"""{TYPED}, lite AS (SELECT * FROM audited WHERE Score_Calidad < 100),
present AS ({_pieces('lite')})
SELECT p.falla, l.SKU, l.SKU_num, l.tipo_mat, l.Desc_Material, round_even(l.Score_Calidad, 1) AS Score_Calidad
FROM lite l JOIN present p ON contains(l.Hallazgos_Detallados, p.falla)""",
    "remediation_wide": f"""{TYPED} SELECT {_WIDE} FROM audited WHERE Score_Calidad < 100""",
    "finding_matrix": f"""{TYPED}, op AS (SELECT * FROM audited WHERE Estado_Gestion = 0),
present AS ({_pieces('op')}),
ranked AS (SELECT falla, row_number() OVER (ORDER BY falla) - 1 AS idx FROM present)
SELECT o.SKU, 'err_' || CAST(r.idx AS STRING) AS err_key, r.falla, '✗' AS mark
FROM op o JOIN ranked r ON contains(o.Hallazgos_Detallados, r.falla)""",
    "finding_counts": f"""{TYPED}, lite AS (SELECT * FROM audited WHERE Score_Calidad < 100),
present AS ({_pieces('lite')})
SELECT p.falla, count(*) AS registros FROM lite l JOIN present p ON contains(l.Hallazgos_Detallados, p.falla)
GROUP BY p.falla""",
    "open_rows": f"{TYPED} SELECT SKU, tipo_mat, Score_Calidad, Hallazgos_Detallados FROM audited WHERE Estado_Gestion = 0",
    "top_failures": f"""{TYPED}, op AS (SELECT * FROM audited WHERE Estado_Gestion = 0),
c AS (SELECT count(*) AS total,
        CAST(sum(CASE WHEN marca_nulo = false THEN 1 ELSE 0 END) AS BIGINT) AS a,
        CAST(sum(CASE WHEN peso_neto_nulo = false THEN 1 ELSE 0 END) AS BIGINT) AS b FROM op),
l AS (SELECT 'marca' AS tipo_falla, a AS registros, total FROM c
      UNION ALL SELECT 'peso neto', b, total FROM c)
SELECT tipo_falla, registros, round_even(registros / greatest(total, 1) * 100.0, 1) AS pct
FROM l WHERE registros > 0 ORDER BY registros DESC, tipo_falla""",
    "score_by_type": f"""{TYPED}, g AS (
  SELECT tipo_mat, round_even({_clamp('avg(Score_Calidad)')}, 6) AS score FROM audited
  WHERE Estado_Gestion = 0 AND tipo_mat IS NOT NULL GROUP BY tipo_mat)
SELECT tipo_mat, score, {_band('score')} AS banda FROM g ORDER BY score DESC, tipo_mat""",
    "rank_dimensions": f"""{TYPED}, m AS (SELECT avg(Score_Completitud) AS c, avg(Score_Consistencia) AS k,
  avg(Score_Unicidad) AS u, avg(Score_Validez) AS v FROM audited),
l AS (SELECT 'Completitud' AS dimension, 0 AS pos, round_even({_clamp('c')}, 6) AS score FROM m
      UNION ALL SELECT 'Consistencia', 1, round_even({_clamp('k')}, 6) FROM m
      UNION ALL SELECT 'Unicidad', 2, round_even({_clamp('u')}, 6) FROM m
      UNION ALL SELECT 'Validez', 3, round_even({_clamp('v')}, 6) FROM m)
SELECT dimension, score, {_band('score')} AS banda FROM l ORDER BY score DESC, pos""",
    "bands": f"{TYPED} SELECT {_band('Score_Calidad')} AS banda, count(*) AS registros FROM audited GROUP BY 1",
    "explorer": f"""{TYPED} SELECT CAST(SKU AS STRING) AS SKU, Desc_Material,
  CASE WHEN Estado_Gestion = 0 THEN 'Pendiente' WHEN Estado_Gestion = 1 THEN 'Gestionado'
       ELSE CAST(Estado_Gestion AS STRING) END AS Estado_Gestion, tipo_mat,
  CASE WHEN marca_nulo IS NULL THEN '—' WHEN NOT marca_nulo THEN '✗' ELSE '✓' END AS marca,
  CASE WHEN peso_neto_nulo IS NULL THEN '—' WHEN NOT peso_neto_nulo THEN '✗' ELSE '✓' END AS "peso neto"
FROM audited WHERE Estado_Gestion = 0 AND (marca_nulo = false OR peso_neto_nulo = false)""",
    "to_remediate": f"{TYPED} SELECT count(*) AS registros_a_sanear FROM audited WHERE Score_Calidad < 100",
    "custodian_queue": f"""{TYPED_CAT}, g AS (
  SELECT tipo_mat, CAST(sum(CASE WHEN Score_Calidad < 100 THEN 1 ELSE 0 END) AS BIGINT) AS registros_a_sanear,
         round_even(avg(Score_Calidad), 6) AS score FROM audited GROUP BY tipo_mat)
SELECT g.tipo_mat, g.registros_a_sanear, g.score,
  coalesce(c.custodio, (SELECT min(custodio) FROM type_catalog WHERE tipo_mat = 'DEFAULT'), 'sin-custodio@example.com') AS custodio
FROM g LEFT JOIN type_catalog c ON g.tipo_mat = c.tipo_mat""",
    "sample_rows": f"""{TYPED} SELECT SKU, tipo_mat, Score_Calidad, Hallazgos_Detallados FROM audited
ORDER BY Score_Calidad, SKU LIMIT 5""",
    "canonical_id": f"""{_with('materials')} SELECT m.SKU, CAST(m.SKU AS STRING) AS sku_texto,
  {_ean_canon()} AS ean_texto,
  CASE WHEN p.p_retailprice IS NULL THEN ''
       WHEN NOT isnan(p.p_retailprice) AND p.p_retailprice = floor(p.p_retailprice)
       THEN CAST(CAST(floor(p.p_retailprice) AS BIGINT) AS STRING)
       ELSE CAST(p.p_retailprice AS STRING) END AS precio_texto
FROM materials m JOIN part p ON m.SKU = p.p_partkey""",
    "profile_numeric": _PROFILE_NUM,
    "profile_text": f"{_with('materials')} {_PROFILE_TXT}",
    "search_rows": f"""{_with('materials', 'directory')}
{_search_side('materials', ['SKU', 'SKU_num', 'tipo_mat', 'Desc_Material', 'grupo_material', 'marca', 'UoM', 'peso_neto', 'peso_bruto', 'EAN13'])}
UNION ALL BY NAME
{_search_side('directory', ['Cliente', 'Nombre', 'email', 'pais', 'telefono', 'segmento'])}""",
    "search_reference": _reference("1"),
    "search_reference_category": _reference("ICA"),
    "rule_email": _rule("directory", "Cliente", "email",
                        f"{_ne('email')} AND NOT regexp_matches(email, '^[\\w\\.-]+@[\\w\\.-]+\\.\\w+$')"),
    "rule_phone_country": f"""{_with('directory')} SELECT Cliente, telefono, pais, coalesce({_ne('telefono')} AND (
   (pais = 'CO' AND NOT regexp_matches(replace(replace(telefono, ' ', ''), '+57', ''), '^(3\\d{{9}}|60\\d{{8}})$'))
   OR (pais <> 'CO' AND NOT regexp_matches(replace(replace(telefono, ' ', ''), '+57', ''), '^\\+?[0-9]{{7,15}}$'))), false) AS falla
FROM directory""".replace("{{", "{").replace("}}", "}"),
    "rule_phone_plain": _rule("directory", "Cliente", "telefono",
                              f"{_ne('telefono')} AND NOT regexp_matches(replace(telefono, ' ', ''), '^\\+?[0-9]{{7,15}}$')"
                              .replace("{{", "{").replace("}}", "}")),
    "directory_adapter": f"""{_with('directory')} SELECT Cliente, CAST(Cliente AS STRING) AS SKU_num,
  Nombre AS Desc_Material, 'Directorio_Comercial' AS tipo_mat FROM directory""",
    "audit_directory": f"{DIRA} SELECT * FROM audited",
    "new_records": f"{_NEW} SELECT * FROM newr",
    "sync_new_audit": f"""{_NEW},{flagship_audit('newr')}
SELECT {MATERIAL_COLS}, Score_Unicidad, Score_Completitud, Score_Validez, Score_Consistencia, Score_Calidad,
  Hallazgos_Detallados, marca_nulo,
  CAST(CASE WHEN coalesce(TRY_CAST(Score_Calidad AS DOUBLE), {_d(100)}) >= 99.99 THEN 1 ELSE 0 END AS BIGINT) AS Estado_Gestion,
  CASE WHEN coalesce(TRY_CAST(Score_Calidad AS DOUBLE), {_d(100)}) >= 99.99 THEN 'Bueno' ELSE 'Malo' END AS Estado_Gestion_Desc,
  Usuario_Auditor
FROM audited""",
    "latest_per_key": f"""{_with('origin_dates')} SELECT SKU, fecha_actualiza, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY SKU ORDER BY fecha_actualiza DESC, l_orderkey DESC, l_linenumber DESC) AS rn
  FROM origin_dates) x WHERE rn = 1""",
    "sync_dates": f"""{_with('audit_target_all', 'origin_dates')},
latest AS (SELECT CAST(SKU AS STRING) AS sk, max(fecha_actualiza) AS nueva FROM origin_dates GROUP BY SKU),
j AS (SELECT t.*, l.sk, l.nueva,
        coalesce(l.sk IS NOT NULL AND coalesce(CAST(l.nueva AS STRING), '1900-01-01')
                 <> coalesce(CAST(t.Fecha_Actualizacion AS STRING), '1900-01-01'), false) AS cambiado
      FROM audit_target_all t LEFT JOIN latest l ON CAST(t.SKU AS STRING) = l.sk)
SELECT SKU, Estado_Gestion, CASE WHEN cambiado THEN nueva ELSE Fecha_Actualizacion END AS Fecha_Actualizacion,
  l_orderkey, l_linenumber, cambiado FROM j""",
    "open_anomalies": f"""{_with('materials', 'audit_target_all')} SELECT m.* FROM materials m WHERE EXISTS (
  SELECT 1 FROM audit_target_all t WHERE CAST(t.SKU AS STRING) = CAST(m.SKU AS STRING) AND t.Estado_Gestion = 0)""",
    "stream_audit": f"""WITH ev AS (SELECT event_id, ts, user_id AS SKU, event_type AS tipo_mat, value AS valor, props,
                     '' AS Desc_Material FROM events),
k AS (SELECT *, {_key('SKU')} AS k1, {_key('tipo_mat')} AS k2 FROM ev),
d AS (SELECT k1, k2 FROM k GROUP BY k1, k2 HAVING count(*) > 1),
fl AS (SELECT k.*,
         coalesce(k.tipo_mat IS NOT NULL AND d.k1 IS NOT NULL AND {_ne('k.SKU')}, false) AS f_u,
         coalesce(k.tipo_mat IS NOT NULL AND {_blank('k.props')}, false) AS f_c,
         coalesce(k.tipo_mat IS NOT NULL AND k.valor IS NOT NULL AND {_num('k.valor')} <= 10, false) AS f_v
       FROM k LEFT JOIN d ON k.k1 = d.k1 AND k.k2 = d.k2),
sc AS (SELECT *,
         CASE WHEN tipo_mat IS NOT NULL THEN greatest({_d(0)}, {_d(100)} - {_pen('f_u', 50)}) ELSE {_d(100)} END AS ru,
         CASE WHEN tipo_mat IS NOT NULL THEN greatest({_d(0)}, {_d(100)} - {_pen('f_c', 20)}) ELSE {_d(100)} END AS rc,
         CASE WHEN tipo_mat IS NOT NULL THEN greatest({_d(0)}, {_d(100)} - {_pen('f_v', 100)}) ELSE {_d(100)} END AS rv,
         {_d(100)} AS rk FROM fl),
sq AS (SELECT *, CASE WHEN tipo_mat IS NOT NULL
                      THEN rc * {_d(0.25)} + rv * {_d(0.25)} + ru * {_d(0.25)} + rk * {_d(0.25)}
                      ELSE {_d(100)} END AS score FROM sc)
SELECT event_id, ts, SKU, tipo_mat, valor, props, Desc_Material,
  ru AS Score_Unicidad, rc AS Score_Completitud, rv AS Score_Validez, rk AS Score_Consistencia,
  score AS Score_Calidad,
  concat({_msg('f_u', 'Evento repetido')}, {_msg('f_c', 'Sin props')}, {_msg('f_v', 'Valor bajo')}) AS Hallazgos_Detallados,
  NOT f_c AS props_nulo,
  CAST(CASE WHEN score >= 99.99 THEN 1 ELSE 0 END AS BIGINT) AS Estado_Gestion,
  CASE WHEN score >= 99.99 THEN 'Bueno' ELSE 'Malo' END AS Estado_Gestion_Desc,
  '' AS Usuario_Auditor
FROM sq""",
    "profile_quantiles": _QUANTILES,
    "profile_all": _with("orders_profile") + " " + " UNION ALL ".join(
        _profile_row(c, k, "orders_profile") for c, k in _ORDER_COLUMNS),
    "propose_rules": _proposed(),
    "audit_edge": _with("materials_edge") + "," + flagship_audit("materials_edge") + " SELECT * FROM audited",
    "rule_regex_edge": f"""{_with('materials_edge')} SELECT SKU, NOT regexp_matches(SKU_num, '^[0-9]*[02468]$') AS falla
FROM materials_edge""",
    "rule_greater_than_edge": f"""{_with('materials_edge')} SELECT SKU, peso_neto, {_num('peso_neto')} <= 0 AS falla
FROM materials_edge""",
    "rule_phone_numeric_country": f"""{_with('directory_numeric')} SELECT Cliente, coalesce(telefono IS NOT NULL
  AND NOT regexp_matches(replace(replace(telefono, ' ', ''), '+57', ''), '^\\+?[0-9]{{7,15}}$'), false) AS falla
FROM directory_numeric""",
    "custodian_twice": f"""{_with('materials', 'custodians_twice')},{typed_audit('materials')}, g AS (
  SELECT tipo_mat, CAST(sum(CASE WHEN Score_Calidad < 100 THEN 1 ELSE 0 END) AS BIGINT) AS registros_a_sanear,
         round_even(avg(Score_Calidad), 6) AS score FROM audited GROUP BY tipo_mat)
SELECT tipo_mat, registros_a_sanear, score, coalesce(
  (SELECT min(custodio) FROM custodians_twice c WHERE c.tipo_mat = g.tipo_mat), 'z@example.com') AS custodio FROM g""",
    "catalog_table": f"""{FLAG} SELECT SKU, UoM, Score_Validez, Hallazgos_Detallados FROM audited""",
    "shape_headers": "SELECT p_name AS SKU, p_brand AS marca FROM part",
    "missing_columns": """SELECT orden, columna, (SELECT count(*) FROM part) AS filas
FROM (VALUES (0, 'color'), (1, 'talla')) v(orden, columna)""",
    "stream_batches": f"""WITH k AS (SELECT event_id, event_id % 3 AS b, user_id, event_type,
  {_key('user_id')} AS k1, {_key('event_type')} AS k2 FROM events),
c AS (SELECT k1, k2, b, count(*) AS n FROM k GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY k1, k2 ORDER BY b) AS seen FROM c)
SELECT k.event_id, CAST(k.b AS INTEGER) AS batch,
  CASE WHEN k.event_type IS NOT NULL AND s.seen > 1 AND {_ne('k.user_id')} THEN {_d(50)} ELSE {_d(100)} END AS Score_Unicidad
FROM k JOIN s ON k.k1 = s.k1 AND k.k2 = s.k2 AND k.b = s.b""",
    "search_sheet": """WITH s AS (
  SELECT 'Nacion' AS categoria, n_name AS a, CAST(n_nationkey AS STRING) AS b FROM nation
  UNION ALL SELECT 'Region', r_name, CAST(r_regionkey AS STRING) FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT DISTINCT 'naciones' AS hoja, categoria, concat('Nombre: ', a, ' | Clave: ', b) AS linea
FROM s WHERE contains(lower(categoria), 'ame') OR contains(lower(a), 'ame')""",
    "skipped_rules": """SELECT bloque, dimension, columna, motivo, (SELECT count(*) FROM part) AS filas
FROM (VALUES ('DEFAULT', 'Validez', 'marca', 'rule nulo not run'), ('DEFAULT', 'Validez', 'no_existe', 'column absent'))
  v(bloque, dimension, columna, motivo)""",
    "finding_subset": f"""{TYPED} SELECT SKU, SKU_num, tipo_mat, Desc_Material, Score_Calidad FROM audited
WHERE Score_Calidad < 100 AND contains(Hallazgos_Detallados, 'Falta marca')""",
    "explorer_clash": f"""{TYPED} SELECT CAST(SKU AS STRING) AS SKU, Desc_Material,
  CASE WHEN Estado_Gestion = 0 THEN 'Pendiente' ELSE 'Gestionado' END AS Estado_Gestion, tipo_mat,
  CASE WHEN marca_nulo IS NULL THEN '—' WHEN NOT marca_nulo THEN '✗' ELSE '✓' END AS "SKU · marca",
  CASE WHEN peso_neto_nulo IS NULL THEN '—' WHEN NOT peso_neto_nulo THEN '✗' ELSE '✓' END AS "peso neto"
FROM audited WHERE Estado_Gestion = 0 AND (marca_nulo = false OR peso_neto_nulo = false)""",
    "read_codes": "SELECT DISTINCT upper(trim(p_brand)) AS code FROM part WHERE trim(p_brand) <> ''",
    "append_results": f"{FLAG} SELECT CAST(SKU AS STRING) AS SKU, tipo_mat, Score_Calidad FROM audited",
    "export_matrix": f"{TYPED} SELECT {_WIDE} FROM audited WHERE Score_Calidad < 100",
    "export_findings": f"""{TYPED}, f AS (SELECT unnest({list(_TYPED_MESSAGES)}) AS falla)
SELECT SKU, SKU_num, tipo_mat, Desc_Material, round_even(Score_Calidad, 1) AS Score_Calidad, falla
FROM audited JOIN f ON contains(Hallazgos_Detallados, falla) WHERE Score_Calidad < 100""",
    "extract_text": f"{_with('materials')} SELECT CAST(SKU AS STRING) AS SKU, UoM FROM materials",
    "history_append": f"""{TYPED} SELECT 'AUD_1' AS id_ejecucion, 'auditor@example.com' AS usuario,
  'PROMO' AS materiales_auditados, count(*) AS total_registros FROM audited WHERE tipo_mat = 'PROMO'
UNION ALL SELECT 'AUD_1', 'auditor@example.com', 'Todos', count(*) FROM audited""",
    "sync_pipeline": f"""{_with('materials', 'origin_dates')}, n AS (
  SELECT SKU, max(fecha_actualiza) AS nueva FROM origin_dates GROUP BY SKU)
SELECT m.SKU, m.tipo_mat, coalesce(n.nueva, CASE WHEN m.SKU % 2 = 0 THEN CAST('1990-01-01' AS TIMESTAMP) END) AS Fecha_Actualizacion
FROM materials m LEFT JOIN n ON m.SKU = n.SKU""",
    "history_record": f"""{TYPED}, a AS (SELECT * FROM audited WHERE tipo_mat IN ('PROMO', 'SMALL'))
SELECT 'auditor@example.com' AS usuario, 'Maestro de Materiales' AS dominio, 'PROMO, SMALL' AS materiales_auditados,
  count(*) AS total_registros,
  round_even(coalesce(avg(Score_Calidad), 0), 6) AS score_global,
  round_even(coalesce(avg(Score_Completitud), 0), 6) AS completitud,
  round_even(coalesce(avg(Score_Validez), 0), 6) AS validez,
  round_even(coalesce(avg(Score_Unicidad), 0), 6) AS unicidad,
  round_even(coalesce(avg(Score_Consistencia), 0), 6) AS consistencia
FROM a""",
    "history_listing": f"""{_with('audit_history')} SELECT fecha, usuario, dominio, score_global, total_registros
FROM audit_history ORDER BY fecha DESC""",
    "sync_overlay": f"""{_with('audit_target_all', 'origin_dates')},
early AS (SELECT SKU, max(fecha_actualiza) AS f FROM origin_dates WHERE fecha_actualiza < TIMESTAMP '1997-01-01' GROUP BY SKU),
late AS (SELECT SKU, max(fecha_actualiza) AS f FROM origin_dates WHERE SKU % 2 = 0 GROUP BY SKU)
SELECT t.SKU, t.Estado_Gestion, t.l_orderkey, t.l_linenumber,
  coalesce(l.f, CASE WHEN t.l_orderkey % 2 = 0 THEN e.f END, t.Fecha_Actualizacion) AS Fecha_Actualizacion
FROM audit_target_all t LEFT JOIN early e ON t.SKU = e.SKU LEFT JOIN late l ON t.SKU = l.SKU""",
    "uniqueness_loads": f"""{_with('materials')},
k AS (SELECT *, SKU % 3 AS carga, {_key('Desc_Material')} AS k1, {_key('grupo_material')} AS k2, {_key('tipo_mat')} AS k3 FROM materials),
c AS (SELECT k1, k2, k3, carga, count(*) AS n FROM k GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY k1, k2, k3 ORDER BY carga) AS seen FROM c)
SELECT k.SKU, CAST(k.carga AS INTEGER) AS carga,
  CASE WHEN k.tipo_mat IS NOT NULL AND s.seen > 1 AND {_ne('k.Desc_Material')} THEN {_d(40)} ELSE {_d(100)} END AS Score_Unicidad
FROM k JOIN s USING (k1, k2, k3, carga)""",
    "asof_versions": f"""{_with('audit_runs', 'origin_versions')},
v AS (SELECT SKU, fecha_actualiza, max((origen, linea)) AS m FROM origin_versions GROUP BY SKU, fecha_actualiza)
SELECT a.SKU, a.l_orderkey, a.l_linenumber, a.fecha_auditoria, v.fecha_actualiza AS fecha_actualiza_vigente,
  v.m[1] AS origen_vigente, v.m[2] AS linea_vigente
FROM audit_runs a ASOF LEFT JOIN v ON a.SKU = v.SKU AND a.fecha_auditoria >= v.fecha_actualiza""",
    "score_trend": f"""{_with('domain_history')} SELECT *, lag(score_global) OVER w AS anterior,
  score_global - lag(score_global) OVER w AS cambio,
  round_even(avg(score_global) OVER (PARTITION BY dominio ORDER BY fecha, id_ejecucion ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS media_movil
FROM domain_history WINDOW w AS (PARTITION BY dominio ORDER BY fecha, id_ejecucion)""",
    "score_cube": f"""{_with('materials', 'directory')}, m AS (WITH {typed_audit().lstrip().lstrip(',')} SELECT * FROM audited),
d AS (WITH {directory_audit().lstrip().lstrip(',')} SELECT * FROM audited),
b AS (SELECT 'Materiales' AS dominio, tipo_mat, Score_Calidad FROM m UNION ALL SELECT 'Directorio', tipo_mat, Score_Calidad FROM d),
x AS (SELECT *, {_band('Score_Calidad')} AS banda FROM b)
SELECT dominio, tipo_mat, banda, CAST(grouping(dominio, tipo_mat, banda) AS INTEGER) AS nivel, count(*) AS filas,
  round_even(avg(Score_Calidad), 6) AS score FROM x GROUP BY CUBE (dominio, tipo_mat, banda)""",
    "finding_changes": f"""{_with('materials')}, a AS (WITH {flagship_audit('materials').lstrip().lstrip(',')} SELECT * FROM audited),
b AS (WITH {typed_audit().lstrip().lstrip(',')} SELECT * FROM audited),
fa AS (SELECT Desc_Material, grupo_material, {_trim('p')} AS falla FROM (SELECT *, unnest(string_split(Hallazgos_Detallados, ', ')) AS p FROM a) WHERE {_trim('p')} <> ''),
fb AS (SELECT Desc_Material, grupo_material, {_trim('p')} AS falla FROM (SELECT *, unnest(string_split(Hallazgos_Detallados, ', ')) AS p FROM b) WHERE {_trim('p')} <> ''),
came AS (SELECT *, count(*) AS n FROM (SELECT * FROM fb EXCEPT ALL SELECT * FROM fa) GROUP BY ALL),
went AS (SELECT *, count(*) AS n FROM (SELECT * FROM fa EXCEPT ALL SELECT * FROM fb) GROUP BY ALL),
stay AS (SELECT *, count(*) AS n FROM (SELECT * FROM fa INTERSECT ALL SELECT * FROM fb) GROUP BY ALL),
k AS (SELECT * FROM fa UNION SELECT * FROM fb)
SELECT k.*, coalesce(s.n, 0) + coalesce(w.n, 0) AS antes, coalesce(s.n, 0) + coalesce(c.n, 0) AS despues,
  coalesce(c.n, 0) AS aparecen, coalesce(s.n, 0) AS siguen, coalesce(w.n, 0) AS desaparecen
FROM k LEFT JOIN came c USING (Desc_Material, grupo_material, falla) LEFT JOIN went w USING (Desc_Material, grupo_material, falla)
LEFT JOIN stay s USING (Desc_Material, grupo_material, falla)""",
    "stream_repeats": f"""SELECT make_timestamp(CAST(floor(epoch_us(ts) / 864000000000) AS BIGINT) * 864000000000) AS periodo, {_key('user_id')} AS SKU,
  {_key('event_type')} AS tipo_mat, count(*) AS veces, first(event_id ORDER BY ts, event_id) AS primero
FROM events WHERE ts IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
    "stream_first_records": "SELECT DISTINCT user_id AS SKU, event_type AS tipo_mat FROM events WHERE ts IS NOT NULL",
    "stream_windows": """WITH e AS (SELECT *, CASE WHEN event_id % 101 = 0 THEN 2 ELSE least(2, CASE WHEN ts < '2024-01-11' THEN 0
    WHEN ts < '2024-01-21' THEN 1 ELSE 2 END + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) END AS paso,
  coalesce(props IS NULL OR trim(lower(props)) IN ('', 'nan', 'nat', 'null'), false) AS f1, value IS NOT NULL AND value <= 10 AS f2 FROM events WHERE ts IS NOT NULL),
agua AS (SELECT p.paso, (SELECT max(ts) FROM e WHERE e.paso < p.paso) - INTERVAL 10 DAY AS marca FROM (SELECT DISTINCT paso FROM e) p),
w AS (SELECT e.*, make_timestamp(CAST(floor(epoch_us(ts) / 43200000000) AS BIGINT) * 43200000000 - k * 43200000000) AS inicio
      FROM e, (SELECT unnest([0, 1]) AS k))
SELECT inicio, inicio + INTERVAL 1 DAY AS fin, event_type AS tipo_mat, count(*) AS filas,
  count(*) FILTER (WHERE event_type IS NOT NULL AND (f1 OR f2)) AS fallidas
FROM w JOIN agua USING (paso) WHERE marca IS NULL OR inicio + INTERVAL 1 DAY > marca GROUP BY ALL""",
    "search_indexed": f"{_with('materials')} " + _search_side("materials", [c.strip() for c in MATERIAL_COLS.split(",")]).replace(
        _SEARCH_PATTERN, "(?i)brand#13"),
    "normalize_nested": """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, CAST(embedding[1] AS DOUBLE) AS directo,
  CAST(embedding[1] AS DOUBLE) AS en_struct, CAST(embedding[1] AS DOUBLE) AS en_lista, CAST(embedding[1] AS DOUBLE) AS en_mapa,
  true AS nulo FROM embeddings WHERE embedding IS NOT NULL""",
    "history_last_source": f"""{TYPED}, n AS (SELECT count(*) AS total_registros FROM audited)
SELECT unnest(['AUD_0', 'AUD_2', 'AUD_3']) AS id_ejecucion, total_registros FROM n""",
}
