"""Readers, writers, history, versioned snapshots, sync pipeline and streaming audit."""

import os

import pytest

from pyspark.sql import functions as F

from calibra import constants as K
from calibra import fixtures as FX
from calibra.operators.audit import audit
from calibra.operators.incremental import sync
from calibra.sources import history, io
from calibra.streaming.stream_audit import stream_audit

from conftest import SF001


def test_read_codes(spark, tmp_path):
    p = tmp_path / "units.txt"
    p.write_text("kg\tkilogram\n\n un \tunit\nKG\tdup\n  \t blank code\nL\n", encoding="utf-8")
    # the line is stripped before the tab split, so a leading tab leaves the description
    assert [r[0] for r in io.read_codes(spark, str(p)).collect()] == ["BLANK CODE", "KG", "L", "UN"]


def test_read_extract_is_all_text_with_trimmed_headers(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text(" SKU ,peso\n001,2.50\n", encoding="utf-8")
    df = io.read_extract(spark, str(p))
    assert df.columns == ["SKU", "peso"]
    assert df.first()["SKU"] == "001" and dict(df.dtypes)["peso"] == "string"


def test_history_create_append_list(spark, tmp_path):
    path = str(tmp_path / "hist")
    history.ensure_history(spark, path)
    assert history.read_history(spark, path).count() == 0
    audited = audit(FX.view(spark, SF001, "materials"), FX.FLAGSHIP_RULES, FX.UNITS)
    rid = history.append_history(audited, path, "qa@example.com", "Maestro de Materiales", ["PROMO", "SMALL"],
                                 run_id="AUD_1", strict=True)
    history.append_history(audited.limit(0), path, "qa", "x", None, run_id="AUD_2", strict=True)
    rows = {r["id_ejecucion"]: r for r in history.read_history(spark, path).collect()}
    assert rid == "AUD_1" and rows["AUD_1"]["materiales_auditados"] == "PROMO, SMALL"
    assert rows["AUD_1"]["total_registros"] == 200
    assert rows["AUD_2"]["materiales_auditados"] == "Todos"
    assert rows["AUD_2"]["score_global"] == 0.0            # empty -> NaN/None stored as 0.0
    listing = history.list_history(spark, path)
    assert listing.columns == list(K.HISTORY_DISPLAY_COLUMNS)
    assert [f.name for f in history.read_history(spark, path).schema] == [n for n, _ in K.HISTORY_COLUMNS]


def test_append_results_projects_to_target(spark, tmp_path):
    path = str(tmp_path / "target")
    spark.createDataFrame([("1", 1, "u")], "SKU string, Estado_Gestion bigint, Usuario_Auditor string") \
        .write.parquet(path)
    audited = audit(FX.view(spark, SF001, "materials"), FX.FLAGSHIP_RULES, FX.UNITS, user="me")
    n = io.append_results(audited, path)
    t = spark.read.parquet(path)
    assert n == 200 and t.count() == 201
    assert sorted(t.columns) == ["Estado_Gestion", "SKU", "Usuario_Auditor"]


def test_versions_never_overwrite_what_is_read(spark, tmp_path):
    d = str(tmp_path / "snap")
    v1 = io.write_version(spark.range(3), d)
    v2 = io.write_version(io.read_version(spark, d).withColumn("id", F.col("id") + 10), d)
    assert v1 != v2 and io.current_version(spark, d) == v2
    assert sorted(r[0] for r in io.read_version(spark, d).collect()) == [10, 11, 12]
    assert spark.read.parquet(v1).count() == 3


def test_a_failed_version_leaves_the_old_one_current(spark, tmp_path):
    d = str(tmp_path / "snap")
    v1 = io.write_version(spark.range(3), d)
    fails = spark.range(3).select(F.raise_error(F.lit("lost")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        io.write_version(fails, d)
    os.makedirs(os.path.join(d, "v999999999999_half"))          # a write that never committed
    assert io.current_version(spark, d) == v1 and io.read_version(spark, d).count() == 3
    assert io.write_version(spark.range(4), d) > v1


def test_dates_without_a_created_column_leave_the_entry_date(spark):
    from calibra.operators.incremental import sync_dates
    target = spark.createDataFrame([("a", "2019-01-01", "2020-01-01")], "SKU string, Fecha_Ingreso string, Fecha_Actualizacion string")
    source = spark.createDataFrame([("a", "2024-01-01")], "SKU string, fecha_actualiza string")
    row = sync_dates(target, source).first()
    assert (row["Fecha_Ingreso"], row["Fecha_Actualizacion"]) == ("2019-01-01", "2024-01-01")


def test_rule_documents_are_kept_by_domain(spark, tmp_path):
    from calibra.plans.ruledoc import save_document, saved_document
    assert saved_document(spark, str(tmp_path), "Maestro de Materiales") is None
    for doc in (FX.FLAGSHIP_RULES, FX.TYPED_RULES):              # the second replaces the first
        save_document(spark, doc, str(tmp_path), "Maestro de Materiales")
        assert saved_document(spark, str(tmp_path), "Maestro de Materiales") == doc
    assert saved_document(spark, str(tmp_path), "Directorio") is None


def test_export_remediation(spark, tmp_path):
    audited = audit(FX.view(spark, SF001, "materials"), FX.TYPED_RULES, FX.UNITS)
    msgs = [c["mensaje"] for b in FX.TYPED_RULES.values() for dd in K.DIMENSIONS for c in b.get(dd, {}).values()]
    out = io.export_remediation(audited, msgs, str(tmp_path / "exp"))
    matriz = spark.read.parquet(os.path.join(out, "matriz"))
    assert matriz.count() == audited.where(F.col(K.SCORE) < 100).count()
    parts = spark.read.parquet(os.path.join(out, "por_falla"))
    assert parts.select("falla").distinct().count() >= 3
    marked = [c for c in matriz.columns if c in msgs]
    assert len(marked) == len(set(msgs)) and matriz.where(F.col("Falta marca") == "X").count() > 0


def test_export_keeps_long_and_bracketed_findings(spark, tmp_path):
    long = "Una falla muy larga que pasa de treinta y un caracteres (detalle)"
    df = spark.createDataFrame([(1, 50.0, f"{long}, (solo), ")], f"SKU int, {K.SCORE} double, {K.FINDINGS} string")
    out = io.export_remediation(df, [long, "(solo)"], str(tmp_path / "exp"))
    texts = {r["falla"] for r in spark.read.parquet(os.path.join(out, "por_falla")).collect()}
    assert texts == {long, "(solo)"}


def test_sync_pipeline(spark, tmp_path):
    d = str(tmp_path / "target")
    master = FX.view(spark, SF001, "materials").withColumn("fecha_actualiza", F.to_timestamp(F.lit("2024-01-01")))
    first = sync(spark, master.where("SKU < 100"), d, FX.FLAGSHIP_RULES, FX.UNITS, user="qa")
    assert first["inserted"] == 100
    t = spark.read.parquet(first["version"]).withColumn("Fecha_Actualizacion", F.col("fecha_actualiza"))
    io.write_version(t, d)
    second = sync(spark, master, d, FX.FLAGSHIP_RULES, FX.UNITS, user="qa")
    assert second["inserted"] == 100                    # only the SKUs not audited before
    final = spark.read.parquet(second["version"])
    assert final.count() == 200
    assert second["updated"] == 100                     # new rows had no date yet
    third = sync(spark, master, d, FX.FLAGSHIP_RULES, FX.UNITS, user="qa")
    assert third["inserted"] == 0 and third["updated"] == 0
    assert second["anomalies"].count() == final.where(F.col(K.STATUS) == 0).select("SKU").distinct().count()


def test_stream_audit_is_incremental_and_idempotent(spark, tmp_path):
    src = str(tmp_path / "changes")
    ev = FX.table(spark, SF001, "events").select(
        F.col("user_id").alias("SKU"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("tipo_mat"), F.col("value").cast("string").alias("valor"))
    ev.where("event_id < 500").repartition(2).write.parquet(os.path.join(src, "part1"))
    schema = ev.schema
    rules = {"DEFAULT": {"Validez": {"valor": {"regla": "mayor_a", "valor": 10, "penalizacion": 100,
                                               "mensaje": "valor bajo"}},
                         "Unicidad": {"SKU": {"regla": "duplicado_multicampo", "penalizacion": 50,
                                              "mensaje": "repetido"}}}}
    target = str(tmp_path / "audited")
    ckpt = str(tmp_path / "ckpt")
    flat = os.path.join(src, "*")
    stream_audit(spark, flat, schema, target, rules, checkpoint=ckpt)
    n1 = spark.read.parquet(target).count()
    assert n1 == 500
    ev.where("event_id >= 500").repartition(2).write.parquet(os.path.join(src, "part2"))
    stream_audit(spark, flat, schema, target, rules, checkpoint=ckpt, widen_uniqueness=True)
    n2 = spark.read.parquet(target).count()
    assert n2 == 1000
    stream_audit(spark, flat, schema, target, rules, checkpoint=ckpt)
    assert spark.read.parquet(target).count() == 1000  # nothing new: nothing appended


def test_materialize_cuts_lineage(spark):
    from calibra.session import materialize
    a = audit(FX.view(spark, SF001, "materials"), FX.FLAGSHIP_RULES, FX.UNITS)
    m = materialize(a)
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "Join" not in plan
    assert m.count() == a.count()


def test_catalogs_and_units_precedence(spark, tmp_path):
    import json
    cat = tmp_path / "catalogos.json"
    cat.write_text(json.dumps({"unidades_medida": ["KG"], "custodios_por_tipo": {"DEFAULT": "d@x.co", "PROMO": "p@x.co"},
                               "mapeo_nombres_material": {"PROMO": "Promocional"}}), encoding="utf-8")
    c = io.read_catalogs(spark, str(cat))
    assert c["units"] == ["KG"] and c["custodians"].count() == 2 and c["type_names"].count() == 1
    txt = tmp_path / "units.txt"
    txt.write_text("un\tunidad\n", encoding="utf-8")
    units = [[r[0] for r in io.load_units(spark, str(tmp_path / n), {"unidades_medida": ["KG"]}).collect()]
             for n in ("units.txt", "none.txt")]
    assert units == [["UN"], ["KG"]]                                                       # text wins
    assert io.read_catalogs(spark, None)["units"] == []
    with pytest.raises(Exception):
        io.read_catalogs(spark, str(tmp_path / "missing.json"))
    # the custodian queue falls back to the DEFAULT entry of the catalogue
    audited = audit(FX.view(spark, SF001, "materials"), FX.FLAGSHIP_RULES, FX.UNITS)
    from calibra.operators import reports
    q = {r["tipo_mat"]: r["custodio"] for r in reports.custodian_queue(audited, c["custodians"]).collect()}
    assert q["PROMO"] == "p@x.co" and q["SMALL"] == "d@x.co"
