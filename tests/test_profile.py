"""Profile, rule proposal, and small operators without a registered query."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from calibra import constants as K
from calibra import fixtures as FX
from calibra.operators import profile, reports, shaping
from calibra.operators.audit import audit
from calibra.registry import QUERIES

from conftest import SF001


def test_quartiles_are_exact(spark):
    li = FX.table(spark, SF001, "lineitem")
    pdf = li.select("l_quantity", "l_extendedprice", "l_discount").toPandas()
    got = {r["columna"]: r for r in profile.numeric_quantiles(li, list(pdf.columns)).collect()}
    for c in pdf.columns:
        for q, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")):
            assert abs(got[c][name] - pdf[c].quantile(q)) < 1e-9          # linear interpolation
    few = spark.createDataFrame([(1.0,), (None,), (4.0,)], "x double")
    assert profile.numeric_quantiles(few).first()[1:] == (1.75, 2.5, 3.25)


def test_profile_has_a_row_for_every_column(spark):
    df = spark.createDataFrame([(1, "a", True, None), (2, "a", None, None)], "n int, t string, b boolean, d date")
    rows = {r["columna"]: r for r in profile.profile(df).collect()}
    assert set(rows) == {"n", "t", "b", "d"}
    assert (rows["t"]["top"], rows["t"]["freq"], rows["t"]["unique"]) == ("a", 2, 1)
    assert (rows["b"]["count"], rows["b"]["nulos"], rows["n"]["p50"]) == (1, 1, 1.5)
    assert rows["d"]["nulos"] == 2 and rows["d"]["desde"] is None


def test_text_profile_matches_pandas_describe(spark):
    m = FX.view(spark, SF001, "materials")
    pdf = m.toPandas()
    got = {r["columna"]: r for r in profile.text_profile(m, ["tipo_mat", "marca"]).collect()}
    for c in ("tipo_mat", "marca"):
        s = pdf[c].dropna()
        vc = s.value_counts()
        assert got[c]["count"] == len(s) and got[c]["unique"] == s.nunique()
        assert got[c]["freq"] == vc.iloc[0]
        assert got[c]["top"] == sorted(vc[vc == vc.iloc[0]].index)[0]


def test_propose_rules_builds_a_runnable_document(spark):
    m = FX.view(spark, SF001, "materials")
    doc = profile.propose_rules(m, "Maestro de Materiales")
    block = doc["DEFAULT"]
    assert "SKU" in block["Unicidad"] and "SKU" in block["Completitud"]
    assert "marca" not in block["Completitud"]            # 40% blank-ish: no completeness rule
    out = audit(m, doc, FX.UNITS)
    assert out.count() == m.count()
    directory = profile.propose_rules(FX.view(spark, SF001, "directory"), "Directorio Comercial")
    assert list(directory) == ["Directorio_Comercial"]


def test_summary_filtered_to_nothing_gives_zeros(spark):
    a = audit(FX.view(spark, SF001, "materials"), FX.FLAGSHIP_RULES, FX.UNITS)
    row = reports.summary(a, types=["NOPE"]).first()
    assert tuple(row) == (0.0, 0.0, 0.0, 0.0, 0.0)


def test_reference_widens_uniqueness(spark):
    rows = [(1, "a"), (2, "b")]
    df = spark.createDataFrame(rows, "id int, k string")
    ref = spark.createDataFrame([(9, "A ")], "id int, k string")
    doc = {"DEFAULT": {"Unicidad": {"k": {"regla": "duplicado_multicampo", "penalizacion": 100, "mensaje": "d"}}}}
    alone = {r["id"]: r[K.SCORE_UNIQUENESS] for r in audit(df, doc).collect()}
    widened = {r["id"]: r[K.SCORE_UNIQUENESS] for r in audit(df, doc, reference=ref).collect()}
    assert alone == {1: 100.0, 2: 100.0} and widened == {1: 0.0, 2: 100.0}


def test_missing_columns_mark_names_and_types(spark):
    assert shaping.missing_columns(["a", "b"], ["b", "c", "a", "d"]) == ["c", "d"]
    names = reports.mark_names(["SKU_nulo", "marca_nulo", "mar_ca_nulo"], {"SKU"})
    assert names == [("SKU_nulo", "SKU · marca"), ("marca_nulo", "marca"), ("mar_ca_nulo", "mar ca")]
    twice = reports.mark_names(["a_b_nulo", "a b_nulo"], set())
    assert twice == [("a_b_nulo", "a b"), ("a b_nulo", "a b · marca (2)")]
    df = spark.createDataFrame([(1,)], "a int")
    assert shaping.normalize_types(df).dtypes == df.dtypes
    stamped = shaping.stamp_auditor(df, "  me@x.co ")
    assert stamped.first()[K.AUDITOR] == "me@x.co"


def test_finding_matrix_keeps_every_finding(spark):
    messages = [f"falla {i:02d}" for i in range(40)]
    df = spark.createDataFrame([(1, ", ".join(messages[:35]) + ", "), (2, messages[39] + ", ")],
                               f"SKU int, {K.FINDINGS} string")
    marks, keys = reports.finding_matrix(df, messages)
    assert marks.count() == 36 and keys.count() == 36 and not keys.first()["truncated"]
    shown, keys = reports.finding_matrix(df, messages, limit=30)
    assert shown.count() == 30 and keys.first()["truncated"]
    assert reports.finding_matrix(df, [])[0].count() == 0


def test_wide_matrix_sorted_and_marked(spark):
    a = audit(FX.view(spark, SF001, "materials"), FX.TYPED_RULES, FX.UNITS)
    msgs = [c["mensaje"] for b in FX.TYPED_RULES.values() for d in K.DIMENSIONS for c in b.get(d, {}).values()]
    wide = reports.remediation_matrix(a, msgs)
    rows = wide.collect()
    scores = [r[K.SCORE] for r in rows]
    assert scores == sorted(scores) and all(s < 100 for s in scores)
    marks = set(wide.columns) - set(reports.report_columns(a))
    assert marks == set(reports.candidate_findings(msgs))
    assert marks and all(r[m] in ("X", "") for r in rows for m in marks)
    # every row to fix carries at least one mark
    assert all(any(r[m] == "X" for m in marks) for r in rows)


def test_search_literal_and_regex(spark):
    from calibra.operators.search import search_rows
    df = spark.createDataFrame([(1, "a.b"), (2, "axb"), (3, None)], "id int, s string")
    rx = sorted(r["id"] for r in search_rows({"t": df}, "A.B").collect())
    lit = sorted(r["id"] for r in search_rows({"t": df}, "A.B", regex=False).collect())
    assert rx == ["1", "2"] and lit == ["1"]          # case-insensitive; values come back as text


def test_read_master_path_and_table(spark, tmp_path):
    from calibra.sources.io import read_master
    p = str(tmp_path / "m")
    spark.range(3).write.parquet(p)
    assert read_master(spark, p).count() == 3
    spark.range(2).createOrReplaceTempView("calibra_master_tmp")
    assert read_master(spark, "calibra_master_tmp").count() == 2


def test_skipped_rules_are_listed(spark):
    from calibra.operators.audit import audit
    df = spark.createDataFrame([(1, "x")], "id int, a string")
    doc = {"DEFAULT": {"Completitud": {"a": {"regla": "nulo", "penalizacion": 1},
                                       "missing": {"regla": "nulo", "penalizacion": 1}},
                       "Validez": {"a": {"regla": "nulo", "penalizacion": 1}},
                       "Consistencia": {"a": {"regla": "mayor_o_igual_columna", "columna_ref": "nope",
                                              "penalizacion": 1}}}}
    res = audit(df, doc, return_plan=True)
    reasons = {(b, d, c): r for b, d, c, r in res.plan.skipped}
    assert reasons[("DEFAULT", "Completitud", "missing")] == "column absent"
    assert ("DEFAULT", "Validez", "a") in reasons and ("DEFAULT", "Consistencia", "a") in reasons
    assert res.frame.first()[K.SCORE] == 100.0


def test_dashboard_reports_from_one_materialized_audit(spark):
    a = audit(FX.view(spark, SF001, "materials"), FX.TYPED_RULES, FX.UNITS)
    msgs = [c["mensaje"] for b in FX.TYPED_RULES.values() for d in K.DIMENSIONS for c in b.get(d, {}).values()]
    cat = FX.view(spark, SF001, "type_catalog")
    d = reports.dashboard(a, msgs, custodians=cat, catalog=cat, types=["PROMO", "SMALL"])
    assert set(d) >= {"summary", "top_failures", "explorer", "custodian_queue", "present_types"}
    assert d["summary"].count() == 1
    assert "Join" not in d["to_remediate"]._jdf.queryExecution().optimizedPlan().toString()
    expected = a.where(F.col("tipo_mat").isin("PROMO", "SMALL")).where(F.col(K.SCORE) < 100).count()
    assert d["to_remediate"].first()[0] == expected
