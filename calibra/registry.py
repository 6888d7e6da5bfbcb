"""Registered queries: one per operator of the inventory, each over whole tables.

Every callable takes (spark, sf_dir) and returns a DataFrame built only from the
parquet tables in `sf_dir` (through the fixture views).  Names of computed columns
match the oracle SQL in `calibra.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra import constants as K
from calibra import fixtures as FX
from calibra.functions import predicates as P
from calibra.functions.text import canonical_id, column_type, qcol
from calibra.operators import incremental, profile, reports, search, shaping
from calibra.operators.audit import audit, restate
from calibra.operators.uniqueness import duplicate_rows

ROUND = 6   # digits kept on means so both engines agree on the last bits


def _materials(spark, sf):
    return FX.view(spark, sf, "materials")


def _directory(spark, sf):
    return FX.view(spark, sf, "directory")


def _flagship(spark, sf) -> DataFrame:
    return audit(_materials(spark, sf), FX.FLAGSHIP_RULES, FX.UNITS, user="auditor@example.com")


def _typed(spark, sf) -> DataFrame:
    return audit(_materials(spark, sf), FX.TYPED_RULES, FX.UNITS, user="auditor@example.com")


def _typed_messages():
    return [c["mensaje"] for b in FX.TYPED_RULES.values() for d in K.DIMENSIONS
            for c in b.get(d, {}).values()]


def _dir_audit(spark, sf) -> DataFrame:
    return audit(_directory(spark, sf), FX.DIRECTORY_RULES, domain="Directorio Comercial",
                 user="auditor@example.com")


def _rule(df: DataFrame, key: str, col: str, fail) -> DataFrame:
    return df.select(qcol(key), qcol(col), F.coalesce(fail, F.lit(False)).alias("falla"))


# -- audits and rules ---------------------------------------------------------

def q_audit_flagship(spark, sf):
    return _flagship(spark, sf)


def q_rule_blank(spark, sf):
    m = _materials(spark, sf)
    return _rule(m, "SKU", "marca", P.is_blank(qcol("marca")))


def q_rule_duplicate(spark, sf):
    m = _materials(spark, sf)
    d = duplicate_rows(m, ["Desc_Material", "grupo_material", "tipo_mat"])
    return d.select("SKU", "Desc_Material", "grupo_material", "tipo_mat", "is_duplicate")


def q_rule_duplicate_lists(spark, sf):
    doc = {"PROMO": {"Unicidad": FX.TYPED_RULES["PROMO"]["Unicidad"]}}
    a = audit(_materials(spark, sf), doc, FX.UNITS)
    return a.select("SKU", "tipo_mat", K.SCORE_UNIQUENESS, K.SCORE, K.FINDINGS)


def q_rule_greater_than(spark, sf):
    return _rule(_materials(spark, sf), "SKU", "peso_neto", P.not_greater_than(qcol("peso_neto"), 0))


def q_rule_catalog(spark, sf):
    return _rule(_materials(spark, sf), "SKU", "UoM", P.not_in_catalog(qcol("UoM"), FX.UNITS))


def q_rule_regex(spark, sf):
    return _rule(_materials(spark, sf), "SKU", "SKU_num", P.not_matching(qcol("SKU_num"), "^[0-9]*[02468]$"))


def q_rule_length(spark, sf):
    return _rule(_materials(spark, sf), "SKU", "EAN13", P.bad_length(qcol("EAN13"), 13))


def q_rule_column_compare(spark, sf):
    m = _materials(spark, sf)
    return m.select("SKU", "peso_bruto", "peso_neto",
                    F.coalesce(P.less_than_column(qcol("peso_bruto"), qcol("peso_neto")), F.lit(False)).alias("falla"))


def q_rule_conditional(spark, sf):
    doc = {"DEFAULT": {"Validez": {"UoM": FX.TYPED_RULES["PROMO"]["Validez"]["UoM"]}}}
    a = audit(_materials(spark, sf), doc, FX.UNITS)
    return a.select("SKU", "grupo_material", "UoM", K.SCORE_VALIDITY, K.SCORE, K.FINDINGS)


def q_blocks_by_type(spark, sf):
    return _typed(spark, sf)


def q_zero_weight(spark, sf):
    a = _typed(spark, sf)
    return a.groupBy("tipo_mat").agg(
        F.count(F.lit(1)).alias("filas"),
        F.count(qcol(K.SCORE_UNIQUENESS)).alias("con_unicidad"),
        F.count(qcol(K.SCORE_CONSISTENCY)).alias("con_consistencia"),
        F.max(qcol(K.SCORE)).alias("score_max"),
        F.min(qcol(K.SCORE)).alias("score_min"))


def q_check_flags(spark, sf):
    return _typed(spark, sf).select("SKU", "tipo_mat", "marca_nulo", "peso_neto_nulo")


def q_restate_status(spark, sf):
    a = _typed(spark, sf).select("SKU", K.SCORE)
    return restate(a).select("SKU", K.STATUS, K.STATUS_DESC)


# -- reports ------------------------------------------------------------------

def q_summary_global(spark, sf):
    return reports.summary(_flagship(spark, sf), digits=ROUND)


def q_summary_filtered(spark, sf):
    return reports.summary(_typed(spark, sf), types=["PROMO", "SMALL"], digits=ROUND)


def q_present_types(spark, sf):
    return reports.present_types(_typed(spark, sf), FX.view(spark, sf, "type_catalog"))


def q_distinct_findings(spark, sf):
    return reports.distinct_findings(_typed(spark, sf))


def q_remediation_matrix(spark, sf):
    return reports.remediation_long(_typed(spark, sf), _typed_messages())


def q_remediation_wide(spark, sf):
    return reports.remediation_matrix(_typed(spark, sf), _typed_messages())


def q_profile_quantiles(spark, sf):
    return profile.numeric_quantiles(FX.table(spark, sf, "lineitem"))


def q_finding_matrix(spark, sf):
    marks, _ = reports.finding_matrix(reports.open_rows(_typed(spark, sf)), _typed_messages())
    return marks.select("SKU", "err_key", "falla", "mark")


def q_finding_counts(spark, sf):
    return reports.finding_counts(_typed(spark, sf), _typed_messages())


def q_open_rows(spark, sf):
    return reports.open_rows(_typed(spark, sf)).select("SKU", "tipo_mat", K.SCORE, K.FINDINGS)


def q_top_failures(spark, sf):
    return reports.top_failures(_typed(spark, sf))


def q_score_by_type(spark, sf):
    return reports.score_by_type(_typed(spark, sf), digits=ROUND)


def q_rank_dimensions(spark, sf):
    return reports.rank_dimensions(_typed(spark, sf), digits=ROUND)


def q_bands(spark, sf):
    return reports.band_counts(_typed(spark, sf))


def q_explorer(spark, sf):
    return reports.explorer(_typed(spark, sf))


def q_to_remediate(spark, sf):
    return reports.to_remediate(_typed(spark, sf))


def q_custodian_queue(spark, sf):
    return reports.custodian_queue(_typed(spark, sf), FX.view(spark, sf, "type_catalog"), digits=ROUND)


def q_sample_rows(spark, sf):
    a = _typed(spark, sf).select("SKU", "tipo_mat", K.SCORE, K.FINDINGS)
    return reports.sample(a, 5, order=[K.SCORE, "SKU"])


def q_canonical_id(spark, sf):
    p = FX.table(spark, sf, "part")
    m = _materials(spark, sf).join(p.select(F.col("p_partkey").alias("SKU"), "p_retailprice"), "SKU")
    return m.select("SKU",
                    canonical_id(qcol("SKU"), column_type(m, "SKU")).alias("sku_texto"),
                    canonical_id(qcol("EAN13"), column_type(m, "EAN13")).alias("ean_texto"),
                    canonical_id(qcol("p_retailprice"), column_type(m, "p_retailprice")).alias("precio_texto"))


def q_profile_numeric(spark, sf):
    return profile.numeric_profile(FX.table(spark, sf, "lineitem"), digits=ROUND)


def q_profile_text(spark, sf):
    return profile.text_profile(_materials(spark, sf))


def q_search_rows(spark, sf):
    return search.search_rows({"materials": _materials(spark, sf), "directory": _directory(spark, sf)},
                              "brand#1[0-3]\\b|customer#00000001")


def q_search_reference(spark, sf):
    return search.search_reference(search.reference_long(FX.table(spark, sf, "nation"),
                                                         FX.table(spark, sf, "region")), "1")


def q_search_reference_category(spark, sf):
    return search.search_reference(search.reference_long(FX.table(spark, sf, "nation"),
                                                         FX.table(spark, sf, "region")), "ICA")


def q_search_sheet(spark, sf):
    """Q22 over a sheet as kept: a category row, a label row, then data."""
    n, r = FX.table(spark, sf, "nation"), FX.table(spark, sf, "region")
    data = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        (F.col("n_nationkey") + 2).alias("fila"), F.col("n_name").alias("a"), F.col("n_nationkey").cast("string").alias("b"),
        F.col("r_name").alias("c"), F.col("r_regionkey").cast("string").alias("d"))
    head = spark.createDataFrame([(0, "Nacion", None, " Region ", None), (1, "Nombre", "Clave", "Nombre ", "Clave")],
                                 "fila long, a string, b string, c string, d string")
    return search.search_reference(search.sheet_long(head.unionByName(data), "naciones"), "ame")


# -- directory domain ---------------------------------------------------------

def q_rule_email(spark, sf):
    return _rule(_directory(spark, sf), "Cliente", "email", P.bad_email(qcol("email")))


def q_rule_phone_country(spark, sf):
    d = _directory(spark, sf)
    return d.select("Cliente", "telefono", "pais",
                    F.coalesce(P.bad_phone(qcol("telefono"), qcol("pais")), F.lit(False)).alias("falla"))


def q_rule_phone_plain(spark, sf):
    return _rule(_directory(spark, sf), "Cliente", "telefono", P.bad_phone(qcol("telefono")))


def q_directory_adapter(spark, sf):
    d = shaping.adapt_domain(_directory(spark, sf), "Directorio Comercial")
    return d.select("Cliente", "SKU_num", "Desc_Material", "tipo_mat")


def q_audit_directory(spark, sf):
    return _dir_audit(spark, sf)


# -- incremental and history --------------------------------------------------

def q_new_records(spark, sf):
    return incremental.new_records(_materials(spark, sf), FX.view(spark, sf, "audit_target"))


def q_sync_new_audit(spark, sf):
    new = incremental.new_records(_materials(spark, sf), FX.view(spark, sf, "audit_target"))
    a = audit(new, FX.FLAGSHIP_RULES, FX.UNITS, user="auditor@example.com")
    return restate(a)


def q_latest_per_key(spark, sf):
    return incremental.latest_per_key(FX.view(spark, sf, "origin_dates"), "SKU",
                                      ["fecha_actualiza", "l_orderkey", "l_linenumber"])


def q_sync_dates(spark, sf):
    t = FX.view(spark, sf, "audit_target_all")
    s = FX.view(spark, sf, "origin_dates")
    return incremental.sync_dates(t, s).withColumnRenamed("__changed", "cambiado")


def q_open_anomalies(spark, sf):
    return incremental.open_anomalies(_materials(spark, sf), FX.view(spark, sf, "audit_target_all"))


def _streamed(spark, sf, batches: int, **options) -> DataFrame:
    """The events table, dealt to `batches` files by id, audited as a stream."""
    import os

    from calibra.streaming.stream_audit import stream_audit
    run = _run_folder(spark, "stream_audit")
    events = FX.table(spark, sf, "events")
    source = os.path.join(run, "in")
    for b in range(batches):
        part = events.where(F.col("event_id") % batches == b).coalesce(1) if batches > 1 else events
        part.write.mode("append").parquet(source)
    stream_audit(spark, source, events.schema, os.path.join(run, "out"), FX.EVENT_RULES,
                 checkpoint=os.path.join(run, "checkpoint"), prepare=FX.master_changes, **options)
    return spark.read.parquet(os.path.join(run, "out"))


def q_stream_audit(spark, sf):
    """The events table read as a stream (availableNow), audited by foreachBatch into a
    folder under the session's checkpoint dir; returns what was written."""
    return _streamed(spark, sf, 1).drop("batch")


def q_stream_batches(spark, sf):
    """I6 in three micro-batches: a key repeats when it was seen in its batch or an earlier one."""
    out = _streamed(spark, sf, 3, widen_uniqueness=True, max_files_per_trigger=1)
    return out.select("event_id", "batch", K.SCORE_UNIQUENESS)


def q_history_record(spark, sf):
    """The history row of an audit of the PROMO and SMALL records (run id and
    timestamp depend on the clock and are left out; means rounded for comparison)."""
    from calibra.sources.history import history_record
    a = _typed(spark, sf).where(F.col("tipo_mat").isin("PROMO", "SMALL"))
    r = history_record(a, "auditor@example.com", "Maestro de Materiales", ["PROMO", "SMALL"], run_id="AUD_0")
    return r.select("usuario", "dominio", "materiales_auditados", "total_registros",
                    *[F.bround(c, ROUND).alias(c) for c in ("score_global", "completitud", "validez",
                                                            "unicidad", "consistencia")])


def q_profile_all(spark, sf):
    return profile.profile(FX.view(spark, sf, "orders_profile"), digits=ROUND)


def q_propose_rules(spark, sf):
    return profile.proposed_rules(_materials(spark, sf))


def q_audit_edge(spark, sf):
    """Null types, Java number literals, a shadowed output column."""
    return audit(FX.view(spark, sf, "materials_edge"), FX.FLAGSHIP_RULES, FX.UNITS, user="auditor@example.com")


def q_rule_regex_edge(spark, sf):
    m = FX.view(spark, sf, "materials_edge")
    return m.select("SKU", F.coalesce(P.not_matching(qcol("SKU_num"), "^[0-9]*[02468]$"), F.lit(False)).alias("falla"))


def q_rule_greater_than_edge(spark, sf):
    m = FX.view(spark, sf, "materials_edge")
    return m.select("SKU", "peso_neto", F.coalesce(P.not_greater_than(qcol("peso_neto"), 0), F.lit(False)).alias("falla"))


def q_rule_phone_numeric_country(spark, sf):
    d = FX.view(spark, sf, "directory_numeric")
    return d.select("Cliente", F.coalesce(P.bad_phone(qcol("telefono"), qcol("pais")), F.lit(False)).alias("falla"))


def q_custodian_twice(spark, sf):
    return reports.custodian_queue(_typed(spark, sf), FX.view(spark, sf, "custodians_twice"), digits=ROUND)


def q_catalog_table(spark, sf):
    """R4 against a table of codes: units of the master that are a brand's or a unit's code."""
    codes = _materials(spark, sf).select(qcol("UoM").alias("code")).where("code <> 'xx'").distinct()
    a = audit(_materials(spark, sf), FX.FLAGSHIP_RULES, codes)
    return a.select("SKU", "UoM", K.SCORE_VALIDITY, K.FINDINGS)


def q_shape_headers(spark, sf):
    """Padded, doubled and shadow headers, target columns, text ids."""
    p = FX.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    df = p.toDF(" SKU ", "SKU", "marca ", " Score_Calidad")
    df = shaping.drop_shadow(shaping.dedupe_columns(shaping.trim_headers(df)))
    return shaping.normalize_types(shaping.as_text_columns(shaping.project_to(df, ["SKU", "marca", "otra"])))


def q_missing_columns(spark, sf):
    """Required columns that the master lacks, in the required order."""
    lacking = shaping.missing_columns(_materials(spark, sf).columns, ["SKU", "color", "marca", "talla"])
    n = _materials(spark, sf).agg(F.count(F.lit(1)).alias("filas"))
    return n.select(F.posexplode(F.array(*[F.lit(c) for c in lacking])).alias("orden", "columna"), "filas")


def q_skipped_rules(spark, sf):
    """Rules of a document that the audit does not run, and rows it audited."""
    doc = {"DEFAULT": {"Validez": {"marca": {"regla": "nulo", "penalizacion": 5, "mensaje": "a"},
                                   "no_existe": {"regla": "mayor_a", "penalizacion": 5, "mensaje": "b"}}}}
    result = audit(_materials(spark, sf), doc, FX.UNITS, return_plan=True)
    names = ("bloque", "dimension", "columna", "motivo")
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, s)]) for s in result.plan.skipped]
    return result.frame.agg(F.count(F.lit(1)).alias("filas")).select(
        F.explode(F.array(*rows)).alias("s"), "filas").select("s.*", "filas")


def q_finding_subset(spark, sf):
    """Q7: rows to fix marked with one finding."""
    return reports.by_finding(_typed(spark, sf), _typed_messages(), "Falta marca")


def q_explorer_clash(spark, sf):
    """Q14: a check whose label is a core column's name."""
    return reports.explorer(_typed(spark, sf), {"marca": "SKU"}, failing=["marca_nulo", "peso_neto_nulo"])


def _run_folder(spark, name: str) -> str:
    import uuid

    from calibra.session import scratch_path
    return scratch_path(spark, f"{name}_{uuid.uuid4().hex[:12]}")


def q_read_codes(spark, sf):
    """A code list written as text and read back."""
    from calibra.sources.io import load_units
    path = _run_folder(spark, "codes")
    _materials(spark, sf).select(F.concat(F.lit(" "), F.lower("grupo_material"), F.lit("\tmarca"))).write.text(path)
    return load_units(spark, path)


def q_append_results(spark, sf):
    """S3: results appended to a target in two steps and read back."""
    from calibra.sources.io import append_results, read_master
    import os
    path = os.path.join(_run_folder(spark, "target"), "t.parquet")
    a = _flagship(spark, sf).select("SKU", "tipo_mat", K.SCORE)
    append_results(a.where(F.col("SKU") % 2 == 0), path)
    append_results(a.where(F.col("SKU") % 2 == 1).withColumn("extra", F.lit(1)), path)
    return read_master(spark, path)


def q_export_matrix(spark, sf):
    """The exported matrix with its mark columns."""
    from calibra.sources.io import export_remediation
    import os
    path = export_remediation(_typed(spark, sf), _typed_messages(), _run_folder(spark, "export"))
    return spark.read.parquet(os.path.join(path, "matriz"))


def q_export_findings(spark, sf):
    """The exported subsets, one folder per finding."""
    from calibra.sources.io import export_remediation
    import os
    path = export_remediation(_typed(spark, sf), _typed_messages(), _run_folder(spark, "export"))
    return spark.read.parquet(os.path.join(path, "por_falla")).drop("clave")


def q_extract_text(spark, sf):
    """An extract written as CSV with padded headers and read back as text."""
    from calibra.sources.io import read_extract
    path = _run_folder(spark, "extract")
    m = _materials(spark, sf).select("SKU", "marca", "UoM").toDF(" SKU", "marca ", "UoM")
    m.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)
    return read_extract(spark, path).select("SKU", "UoM")


def q_history_append(spark, sf):
    """The history created, two sources recorded, one of them twice."""
    from calibra.sources.history import append_history, read_history
    path = _run_folder(spark, "history")
    a = _typed(spark, sf)
    for source, types in (("a", ["PROMO"]), ("b", None), ("a", ["PROMO"])):
        part = a.where(F.col("tipo_mat").isin(types)) if types else a
        append_history(part, path, "auditor@example.com", "Maestro", types, run_id="AUD_1", strict=True,
                       source_name=f"{path}/{source}")
    return read_history(spark, path).select("id_ejecucion", "usuario", "materiales_auditados", "total_registros")


def q_sync_pipeline(spark, sf):
    """A first load of half the master, then a synchronisation of all of it; the
    current version of the target afterwards."""
    from calibra.sources.io import read_version
    path = _run_folder(spark, "sync")
    newest = incremental.latest_value(FX.view(spark, sf, "origin_dates"), "SKU", "fecha_actualiza")
    master = _materials(spark, sf).join(newest, "SKU", "left")
    first = master.where(F.col("SKU") % 2 == 0).withColumn("Fecha_Actualizacion", F.lit("1990-01-01").cast("timestamp_ntz"))
    for step in (first, master.withColumn("Fecha_Actualizacion", F.col("fecha_actualiza"))):
        incremental.sync(spark, step, path, FX.FLAGSHIP_RULES, FX.UNITS)
    return read_version(spark, path).select(F.col("SKU").cast("bigint").alias("SKU"), "tipo_mat", "Fecha_Actualizacion")


def q_history_listing(spark, sf):
    from calibra.sources.history import list_history_frame
    return list_history_frame(FX.view(spark, sf, "audit_history"))


# -- deltas, ordered operators, stateful streams --------------------------------

def q_sync_overlay(spark, sf):
    """I3 merge on read: half the target, dates up to 1997, the other half added, buckets
    compacted, then all dates of the even SKUs; the table as read."""
    from calibra.sources.deltas import DatedTable
    target, origin = FX.view(spark, sf, "audit_target_all"), FX.view(spark, sf, "origin_dates")
    table = DatedTable(spark, _run_folder(spark, "overlay"), buckets=16)
    table.create(target.where("l_orderkey % 2 = 0"))
    table.sync_dates(origin.where("fecha_actualiza < TIMESTAMP '1997-01-01 00:00:00'"))
    table.append(target.where("l_orderkey % 2 = 1"))
    table.compact()
    table.sync_dates(origin.where("SKU % 2 = 0"))
    return table.read()


def q_uniqueness_loads(spark, sf):
    """R2 over three loads (Q-8): a key repeats when its load or an earlier one holds it."""
    from calibra.sources.deltas import KeyCounts
    rule = FX.FLAGSHIP_RULES["DEFAULT"]["Unicidad"]
    store = KeyCounts(spark, _run_folder(spark, "keys"), rule["Desc_Material"]["columnas"], buckets=16)
    out = None
    for n in range(3):
        load = _materials(spark, sf).where(F.col("SKU") % 3 == n)
        audited = audit(load, {"DEFAULT": {"Unicidad": rule}}, reference=store.known(load))
        part = audited.select("SKU", F.lit(n).alias("carga"), K.SCORE_UNIQUENESS)
        out = part if out is None else out.unionByName(part)
        store.add(load, n)
        if n == 1:
            store.compact()
    return out


def q_asof_versions(spark, sf):
    """The origin version that was valid when each audit ran."""
    from calibra.operators.ordered import asof_join
    return asof_join(FX.view(spark, sf, "audit_runs"), FX.view(spark, sf, "origin_versions"), "SKU", "fecha_auditoria",
                     "fecha_actualiza", ["origen", "linea"], ties=["origen", "linea"])


def q_score_trend(spark, sf):
    """Change against the previous run and moving mean over the history (frames over S6)."""
    from calibra.sources.history import score_trend
    return score_trend(FX.view(spark, sf, "domain_history"), runs=3, digits=ROUND)


def q_score_cube(spark, sf):
    """Scores by domain, type and band with all subtotals in one pass."""
    both = _typed(spark, sf).select(F.lit("Materiales").alias("dominio"), "tipo_mat", K.SCORE).unionByName(
        _dir_audit(spark, sf).select(F.lit("Directorio").alias("dominio"), "tipo_mat", K.SCORE))
    return reports.score_cube(both, ["dominio", "tipo_mat"], digits=ROUND)


def q_finding_changes(spark, sf):
    """Findings that appeared, stayed or went between two audits of the master."""
    from calibra.operators.changes import finding_changes
    return finding_changes(_flagship(spark, sf), _typed(spark, sf), ["Desc_Material", "grupo_material"])


def q_search_indexed(spark, sf):
    """Q21 through the n-gram index: the master in ranges of its key, a literal term."""
    import os

    from calibra.sources import text_index
    run = _run_folder(spark, "search")
    table, index = os.path.join(run, "table"), os.path.join(run, "index")
    _materials(spark, sf).repartitionByRange(16, "SKU").write.parquet(table)
    text_index.update_index(spark, table, index)
    return text_index.search_indexed(spark, table, index, "BRAND#13", "materials")


def q_normalize_nested(spark, sf):
    """Vectors as a column, in a struct, in an array and as map values, unwrapped to storage."""
    from pyspark.ml.functions import array_to_vector
    e = FX.table(spark, sf, "embeddings")
    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    df = e.where("embedding IS NOT NULL").select("vec_id", vector.alias("v")).select(
        "vec_id", "v", F.struct("v", F.lit(1).alias("uno")).alias("s"), F.array("v", F.lit(None).cast("void")).alias("l"),
        F.create_map(F.lit("k"), F.col("v")).alias("m"))
    plain = shaping.normalize_types(df)
    first = lambda c: F.get(c["values"], 0)
    return plain.select("vec_id", F.size(F.col("v.values")).alias("n"), first(F.col("v")).alias("directo"),
                        first(F.col("s.v")).alias("en_struct"), first(F.col("l")[0]).alias("en_lista"),
                        first(F.col("m")["k"]).alias("en_mapa"), F.col("l")[1].isNull().alias("nulo"))


def q_history_last_source(spark, sf):
    """S5 as the original guards it: a source again after another one is another record."""
    from calibra.sources.history import append_history, read_history
    path = _run_folder(spark, "history")
    a = _typed(spark, sf)
    for n, source in enumerate(("a", "a", "b", "a")):
        append_history(a, path, "auditor@example.com", "Maestro", run_id=f"AUD_{n}", strict=True, source_name=source, once="last")
    return read_history(spark, path).select("id_ejecucion", "total_registros")


def _fed(parts, source: str, run) -> None:
    """Write each part to the stream's source and let the stream consume it."""
    for part in parts:
        part.write.mode("append").parquet(source)
        run()


def q_stream_repeats(spark, sf):
    """Uniqueness over a stream in three steps: keys that repeat within ten days."""
    import os

    from calibra.streaming import stream_state as S
    run, events = _run_folder(spark, "stream_repeats"), FX.table(spark, sf, "events")
    source, out = os.path.join(run, "in"), os.path.join(run, "out")
    _fed([events.where(F.col("event_id") % 3 == b) for b in range(3)], source, lambda: S.stream_repeats(
        spark, source, events.schema, out, ["SKU", "tipo_mat"], "event_id", "ts", "10 days", "60 days",
        os.path.join(run, "checkpoint"), FX.master_changes))
    return S.read_repeats(spark, out, ["SKU", "tipo_mat"])


def q_stream_first_records(spark, sf):
    """The stream without repeated keys, in three steps: the keys of the records kept."""
    import os

    from calibra.streaming import stream_state as S
    run, events = _run_folder(spark, "stream_first"), FX.table(spark, sf, "events")
    source, out = os.path.join(run, "in"), os.path.join(run, "out")
    _fed([events.where(F.col("event_id") % 3 == b) for b in range(3)], source, lambda: S.stream_first_records(
        spark, source, events.schema, out, ["SKU", "tipo_mat"], "event_id", "ts", "60 days",
        os.path.join(run, "checkpoint"), FX.master_changes))
    return spark.read.parquet(out).select("SKU", "tipo_mat")


def q_stream_windows(spark, sf):
    """Failed rows per type in sliding windows, in three steps of ten days; a seventh of the
    rows comes a step late, and one row in 101 comes last: too late where its window has
    been closed by the watermark."""
    import os

    from calibra.streaming import stream_state as S
    run, events = _run_folder(spark, "stream_windows"), FX.table(spark, sf, "events")
    source, out = os.path.join(run, "in"), os.path.join(run, "out")
    step = F.expr("CASE WHEN event_id % 101 = 0 THEN 2 ELSE least(2, CASE WHEN ts < '2024-01-11' THEN 0 "
                  "WHEN ts < '2024-01-21' THEN 1 ELSE 2 END + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) END")
    _fed([events.where(step == b) for b in range(3)], source, lambda: S.stream_failures(
        spark, source, events.schema, out, FX.EVENT_ROW_RULES, "ts", "1 day", "10 days", os.path.join(run, "checkpoint"),
        slide="12 hours", prepare=FX.master_changes))
    return S.read_failures(spark, out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
