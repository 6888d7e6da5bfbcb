"""Rule semantics on micro-tables (value parity points and quirks)."""

from pyspark.sql import functions as F

from calibra import constants as K
from calibra.functions import predicates as P
from calibra.functions.text import canonical_id, qcol, utrim
from calibra.operators.audit import audit, restate
from calibra.operators.shaping import dedupe_columns, drop_shadow, trim_headers

W = {"Completitud": 0.25, "Unicidad": 0.25, "Validez": 0.25, "Consistencia": 0.25}


def _rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("id").collect()]


def test_blank_key_counts_with_null_but_only_nonblank_is_flagged(spark):
    df = spark.createDataFrame([(1, "  "), (2, None), (3, "q")], "id int, k string")
    doc = {"DEFAULT": {"pesos_dimensiones": W,
                       "Unicidad": {"k": {"regla": "duplicado_multicampo", "penalizacion": 100, "mensaje": "dup"}}}}
    out = audit(df, doc)
    assert _rows(out, "id", K.SCORE_UNIQUENESS) == [(1, 0.0), (2, 100.0), (3, 100.0)]


def test_email_unicode_word_and_end_of_text(spark):
    df = spark.createDataFrame([(1, "josé@x.co"), (2, "a@x.co\n"), (3, "a@b"), (4, ""), (5, None)],
                               "id int, e string")
    got = _rows(df.select("id", F.coalesce(P.bad_email(qcol("e")), F.lit(False)).alias("f")), "id", "f")
    assert got == [(1, False), (2, True), (3, True), (4, False), (5, False)]


def test_number_parsing_is_non_strict(spark):
    vals = ["abc", " 12 ", "1e3", "NaN", "", None, "-1"]
    df = spark.createDataFrame(list(enumerate(vals)), "id int, v string")
    got = _rows(df.select("id", F.coalesce(P.not_greater_than(qcol("v"), 0), F.lit(False)).alias("f")), "id", "f")
    # unparsable and empty -> 0 -> fails; NaN is not <= 0; NULL passes (not-null guard)
    assert got == [(0, True), (1, False), (2, False), (3, False), (4, True), (5, False), (6, True)]


def test_trim_strips_unicode_whitespace(spark):
    df = spark.createDataFrame([("\t a  \n",)], "s string")
    assert df.select(utrim(qcol("s"))).first()[0] == "a"


def test_blank_tokens(spark):
    vals = [None, "", " NaN ", "NaT", "null", "x", "\tnull\n"]
    df = spark.createDataFrame(list(enumerate(vals)), "id int, v string")
    got = [r[1] for r in _rows(df.select("id", P.is_blank(qcol("v")).alias("f")), "id", "f")]
    assert got == [True, True, True, True, True, False, True]


def test_length_rule_cuts_trailing_dot_zero(spark):
    vals = ["1234567890123.0", "1234567890123", "123.0.0", "nan", "", None, "NaN"]
    df = spark.createDataFrame(list(enumerate(vals)), "id int, v string")
    got = [r[1] for r in _rows(df.select("id", F.coalesce(P.bad_length(qcol("v"), 13), F.lit(False)).alias("f")),
                               "id", "f")]
    assert got == [False, False, True, False, False, False, True]


def test_phone_with_and_without_country(spark):
    rows = [(1, "+57 3001234567", "CO"), (2, "6012345678", "CO"), (3, "12345", "CO"),
            (4, "+5112345678", "PE"), (5, "tel?", "PE"), (6, "tel?", None)]
    df = spark.createDataFrame(rows, "id int, t string, c string")
    with_c = df.select("id", F.coalesce(P.bad_phone(qcol("t"), qcol("c")), F.lit(False)).alias("f"))
    assert [r[1] for r in _rows(with_c, "id", "f")] == [False, False, True, False, True, False]
    plain = df.select("id", F.coalesce(P.bad_phone(qcol("t")), F.lit(False)).alias("f"))
    assert [r[1] for r in _rows(plain, "id", "f")] == [False, False, True, False, True, True]


def test_null_type_unknown_type_and_no_default(spark):
    df = spark.createDataFrame([(1, None, None), (2, "A", None), (3, "B", None)],
                               "id int, tipo_mat string, marca string")
    rule = {"marca": {"regla": "nulo", "penalizacion": 100, "mensaje": "m"}}
    with_default = {"DEFAULT": {"pesos_dimensiones": W, "Completitud": rule}}
    out = audit(df, with_default)
    assert _rows(out, "id", K.SCORE) == [(1, 100.0), (2, 75.0), (3, 75.0)]   # B falls to DEFAULT
    only_a = {"A": {"pesos_dimensiones": W, "Completitud": rule}}
    out = audit(df, only_a)
    assert _rows(out, "id", K.SCORE, K.FINDINGS) == [(1, 100.0, ""), (2, 75.0, "m, "), (3, 100.0, "")]


def test_floor_zero_weights_and_unnormalised_sum(spark):
    df = spark.createDataFrame([(1, "T", None, "-5")], "id int, tipo_mat string, marca string, n string")
    doc = {"T": {"pesos_dimensiones": {"Completitud": 0.5, "Validez": 1.0, "Unicidad": 0.0},
                 "Completitud": {"marca": {"regla": "nulo", "penalizacion": 70, "mensaje": "a"},
                                 "n": {"regla": "nulo", "penalizacion": 10, "mensaje": "b"}},
                 "Validez": {"n": {"regla": "mayor_a", "penalizacion": 150, "mensaje": "c"}}}}
    r = audit(df, doc).first()
    assert r[K.SCORE_COMPLETENESS] == 30.0            # 100 - 70 (n is not blank)
    assert r[K.SCORE_VALIDITY] == 0.0                 # floored
    assert r[K.SCORE_UNIQUENESS] is None              # weight 0 -> shown null
    assert r[K.SCORE_CONSISTENCY] is None             # weight missing -> shown null (Q-4)
    # missing weight scores with 0.25: 30*0.5 + 0*1.0 + 100*0.0 + 100*0.25
    assert r[K.SCORE] == 40.0
    assert r[K.FINDINGS] == "a, c, "
    big = audit(spark.createDataFrame([(1, "T", "x", "5")], df.schema), doc).first()
    assert big[K.SCORE] == 100 * 0.5 + 100 * 1.0 + 100 * 0.25   # ceiling moves (Q-5)
    assert big[K.STATUS] == 1


def test_shadow_columns_dropped_and_duplicates_keep_last(spark):
    df = spark.createDataFrame([(1, 5.0, "x")], "id int, `estado_gestion ` double, SCORE_CALIDAD string")
    assert drop_shadow(df).columns == ["id"]
    dup = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("a", "b", "a")
    d = dedupe_columns(dup)
    assert d.columns == ["b", "a"] and tuple(d.first()) == (2, 3)
    spaced = spark.createDataFrame([(1,)], "` x ` int")
    assert trim_headers(spaced).columns == ["x"]


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "a@b.co", None, "1"), (2, "bad", "CO", None)],
                               "id int, `Correo electrónico` string, `Clave de país/región` string, `peso.neto` string")
    doc = {"DEFAULT": {"pesos_dimensiones": W,
                       "Completitud": {"Clave de país/región": {"regla": "nulo", "penalizacion": 100, "mensaje": "pais"},
                                       "peso.neto": {"regla": "nulo", "penalizacion": 100, "mensaje": "peso"}},
                       "Validez": {"Correo electrónico": {"regla": "formato_correo", "penalizacion": 100,
                                                         "mensaje": "correo"}}}}
    out = audit(df, doc)
    assert _rows(out, "id", K.FINDINGS) == [(1, "pais, "), (2, "peso, correo, ")]
    assert "Clave de país/región_nulo" in out.columns and "peso.neto_nulo" in out.columns


def test_condition_whitelist_blacklist(spark):
    rows = [(1, "A", "x", "g1"), (2, "A", "x", "g2"), (3, "A", "ok", "g1"), (4, "A", "ok", "g1"),
            (5, "A", "bad", "g2")]
    df = spark.createDataFrame(rows, "id int, tipo_mat string, d string, g string")
    doc = {"A": {"pesos_dimensiones": W,
                 "Unicidad": {"d": {"regla": "duplicado_multicampo", "penalizacion": 100, "mensaje": "dup",
                                    "whitelist": [" OK "], "blacklist": ["bad"],
                                    "condicion_columna": "g", "condicion_valor": "g1"}}}}
    out = audit(df, doc)
    # x duplicated (ids 1,2) but the condition keeps only g1; ok is white-listed;
    # bad is black-listed but fails the condition
    assert _rows(out, "id", K.SCORE_UNIQUENESS) == [(1, 0.0), (2, 100.0), (3, 100.0), (4, 100.0), (5, 100.0)]


def test_check_flag_uses_existing_column_as_base(spark):
    df = spark.createDataFrame([(1, None, True), (2, "x", False)], "id int, m string, m_nulo boolean")
    doc = {"DEFAULT": {"Completitud": {"m": {"regla": "nulo", "penalizacion": 10, "mensaje": "m"}}}}
    out = audit(df, doc)
    assert _rows(out, "id", "m_nulo") == [(1, False), (2, False)]


def test_restate_from_stored_score(spark):
    df = spark.createDataFrame([(1, "99.995"), (2, "abc"), (3, None), (4, "50")], "id int, Score_Calidad string")
    assert _rows(restate(df), "id", K.STATUS, K.STATUS_DESC) == [
        (1, 1, "Bueno"), (2, 1, "Bueno"), (3, 1, "Bueno"), (4, 0, "Malo")]
    none = restate(spark.createDataFrame([(1,)], "id int"))
    assert _rows(none, "id", K.STATUS, K.STATUS_DESC) == [(1, 0, "Malo")]


def test_canonical_id(spark):
    df = spark.createDataFrame([(1, 12.0, "77001.0"), (2, 1.5, " 12 "), (3, None, None), (4, 3.0, "a.0")],
                               "id int, f double, s string")
    got = _rows(df.select("id", canonical_id(qcol("f"), df.schema["f"].dataType).alias("a"),
                          canonical_id(qcol("s"), df.schema["s"].dataType).alias("b")), "id", "a", "b")
    assert got == [(1, "12", "77001"), (2, "1.5", "12"), (3, "", ""), (4, "3", "a.0")]


def test_messages_with_separator_and_substrings(spark):
    from calibra.operators import reports
    df = spark.createDataFrame([(1, None, "5"), (2, "x", "-1")], "id int, marca string, n string")
    doc = {"DEFAULT": {"Completitud": {"marca": {"regla": "nulo", "penalizacion": 10, "mensaje": "Falta, marca"}},
                       "Validez": {"n": {"regla": "mayor_a", "penalizacion": 10, "mensaje": "marca"}}}}
    out = audit(df, doc)
    found = [r[0] for r in reports.distinct_findings(out).collect()]
    assert found == ["Falta", "marca"]                       # a message with ', ' splits (Q-11)
    msgs = ["Falta, marca", "marca"]
    marks = reports.remediation_long(out.withColumn("SKU", F.col("id")), msgs)
    got = sorted((r["SKU"], r["falla"]) for r in marks.collect())
    assert got == [(1, "Falta"), (1, "marca"), (2, "marca")]
    assert reports.ambiguous_findings(reports.candidate_findings(msgs), msgs) == []
    # "marca" inside "Falta marca" is ambiguous: a substring hit alone does not prove it fired
    msgs2 = ["Falta marca", "marca"]
    assert reports.ambiguous_findings(reports.candidate_findings(msgs2), msgs2) == ["marca"]
    doc2 = {"DEFAULT": {"Completitud": {"marca": {"regla": "nulo", "penalizacion": 10, "mensaje": "Falta marca"}},
                        "Validez": {"n": {"regla": "mayor_a", "penalizacion": 10, "mensaje": "marca"}}}}
    only1 = audit(df.where("id = 1"), doc2).withColumn("SKU", F.col("id"))
    got1 = sorted((r["SKU"], r["falla"]) for r in reports.remediation_long(only1, msgs2).collect())
    assert got1 == [(1, "Falta marca")]                      # "marca" never fired: not a column
    both = audit(df, doc2).withColumn("SKU", F.col("id"))
    got2 = sorted((r["SKU"], r["falla"]) for r in reports.remediation_long(both, msgs2).collect())
    assert got2 == [(1, "Falta marca"), (1, "marca"), (2, "marca")]   # substring mark (Q-11)


def test_catalog_as_code_table_equals_code_list(spark):
    from calibra import fixtures as FX
    m = FX.view(spark, "/root/testdata/sf0.001", "materials")
    codes = spark.createDataFrame([("kg",), ("UN",), (None,), ("UN",)], "code string")
    for rules in (FX.FLAGSHIP_RULES, FX.TYPED_RULES):
        with_list = audit(m, rules, ["KG", "UN"])
        with_table = audit(m, rules, codes)
        with_hot = audit(m, rules, codes, hot_key_rows=1)
        key = sorted(with_list.columns)
        rows = sorted(tuple(r) for r in with_list.select(*key).collect())
        assert rows == sorted(tuple(r) for r in with_table.select(*key).collect())
        assert rows == sorted(tuple(r) for r in with_hot.select(*key).collect())
