"""Rule documents: validation, generated-rule adapter, merge modes (no Spark)."""

import pytest

from calibra.plans.ruledoc import (RuleError, adapt_generated, default_document, load_document,
                                   merge_documents, validate_document, with_generated)


def test_default_document_has_equal_weights_and_no_rules():
    doc = default_document()
    assert doc == {"DEFAULT": {"pesos_dimensiones": {"Completitud": 0.25, "Unicidad": 0.25,
                                                     "Validez": 0.25, "Consistencia": 0.25}}}


def test_missing_rule_file_raises(spark, tmp_path):
    assert load_document(None) == default_document()
    with pytest.raises(Exception):
        load_document(str(tmp_path / "absent.json"))


@pytest.mark.parametrize("bad,msg", [
    ({"DEFAULT": {"Completitud": {"marca": {"penalizacion": 10}}}}, "regla"),
    ({"DEFAULT": {"Completitud": {"marca": {"regla": "nulo"}}}}, "penalizacion"),
    ({"DEFAULT": {"Completitud": {"marca": {"regla": "nulo", "penalizacion": "x"}}}}, "number"),
    ({"DEFAULT": {"pesos_dimensiones": {"Completitud": "0.5"}}}, "number"),
    ({"DEFAULT": "x"}, "object"),
])
def test_validation_names_the_rule(bad, msg):
    with pytest.raises(RuleError, match=msg):
        validate_document(bad)


def test_unknown_rule_under_dimension_is_a_warning():
    doc = {"DEFAULT": {"Validez": {"x": {"regla": "nulo", "penalizacion": 5}}}}
    assert any("not run" in w for w in validate_document(doc))


def test_adapter_format_a_and_b():
    gen = {"diccionario_reglas": [
        {"dimension_dama": "Completitud", "reglas_aplicadas": [
            {"nombre_columna": "marca", "regla": "nulo", "penalizacion": 80, "mensaje": "sin marca"}]},
        {"dimension": "Unicidad de datos", "columna": "SKU", "penalizacion_negocio": 70, "descripcion": "dup"},
        {"dimension": "exactitud", "columna": "UoM"},
    ]}
    doc = adapt_generated(gen, "Maestro de Materiales")
    b = doc["DEFAULT"]
    assert b["Completitud"]["marca"] == {"regla": "nulo", "penalizacion": 80.0, "mensaje": "sin marca"}
    assert b["Unicidad"]["SKU"]["regla"] == "duplicado_multicampo"
    # format B falls back to `nulo` under Validez (quirk Q-3): the engine will skip it
    assert b["Validez"]["UoM"] == {"regla": "nulo", "penalizacion": 50.0, "mensaje": "Error en UoM"}


def test_adapter_directory_target_and_json_in_text():
    text = 'noise {"diccionario_reglas": [{"dimension_dama": "Validez", "reglas_aplicadas": ' \
           '[{"nombre_columna": "email", "regla": "formato_correo", "valor": 3}]}]} trailing'
    doc = adapt_generated(text, "Directorio Comercial")
    assert list(doc) == ["Directorio_Comercial"]
    assert doc["Directorio_Comercial"]["Validez"]["email"]["valor"] == 3
    dropped = adapt_generated(text, "Directorio Comercial", carry_parameters=False)
    assert "valor" not in dropped["Directorio_Comercial"]["Validez"]["email"]   # quirk Q-2


def test_adapter_returns_none_without_rules():
    assert adapt_generated({"otra": 1}, "x") is None


def test_merge_replaces_whole_dimension_by_default():
    base = {"DEFAULT": {"Completitud": {"a": {"regla": "nulo", "penalizacion": 1}},
                        "Validez": {"b": {"regla": "mayor_a", "penalizacion": 1}}}}
    over = {"DEFAULT": {"Completitud": {"c": {"regla": "nulo", "penalizacion": 2}}, "Validez": {}}}
    m = merge_documents(base, over)
    assert m["DEFAULT"]["Completitud"] == {"c": {"regla": "nulo", "penalizacion": 2}}   # Q-1
    assert m["DEFAULT"]["Validez"] == {}
    e = merge_documents(base, over, mode="extend")
    assert set(e["DEFAULT"]["Completitud"]) == {"a", "c"}
    assert set(e["DEFAULT"]["Validez"]) == {"b"}


def test_with_generated_engine_format_merges_directly():
    base = {"DEFAULT": {"Completitud": {"a": {"regla": "nulo", "penalizacion": 1}}}}
    gen = {"DEFAULT": {"Validez": {"b": {"regla": "mayor_a", "penalizacion": 3}}}}
    out = with_generated(base, gen, "x")
    assert set(out["DEFAULT"]) == {"Completitud", "Validez"}
