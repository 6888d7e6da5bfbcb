"""Properties of the audit on random frames (hypothesis, few examples: each is a Spark job)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from calibra import constants as K
from calibra.operators.audit import audit

VALUES = st.one_of(st.none(), st.sampled_from(["", " ", "nan", "x", "X ", "-1", "0", "7", "abc", "kg", "UN"]))
ROWS = st.lists(st.tuples(st.sampled_from([None, "A", "B"]), VALUES, VALUES, VALUES), min_size=0, max_size=25)

DOC = {"DEFAULT": {"pesos_dimensiones": {"Completitud": 0.25, "Unicidad": 0.25, "Validez": 0.25, "Consistencia": 0.25},
                   "Unicidad": {"a": {"regla": "duplicado_multicampo", "penalizacion": 40, "columnas": ["a", "b"],
                                      "mensaje": "dup"}},
                   "Completitud": {"a": {"regla": "nulo", "penalizacion": 60, "mensaje": "blank"}},
                   "Validez": {"b": {"regla": "mayor_a", "penalizacion": 30, "mensaje": "low"},
                               "c": {"regla": "catalogo", "catalogo_ref": "unidades", "penalizacion": 80,
                                     "mensaje": "unit"}},
                   "Consistencia": {"c": {"regla": "mayor_o_igual_columna", "columna_ref": "b",
                                          "penalizacion": 20, "mensaje": "lt"}}}}
MORE = {"DEFAULT": dict(DOC["DEFAULT"], Completitud={**DOC["DEFAULT"]["Completitud"],
                                                     "c": {"regla": "nulo", "penalizacion": 10, "mensaje": "c"}})}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ROWS)
def test_audit_properties(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "id int, tipo_mat string, a string, b string, c string")
    out = audit(df, DOC, ["KG", "UN"]).orderBy("id").collect()
    assert len(out) == len(rows)                                   # row count kept
    for r in out:
        for c in (K.SCORE_UNIQUENESS, K.SCORE_COMPLETENESS, K.SCORE_VALIDITY, K.SCORE_CONSISTENCY):
            assert 0.0 <= r[c] <= 100.0
        assert (r[K.SCORE] == 100.0) == (r[K.FINDINGS] == "")     # positive penalties, weights sum to 1
    more = audit(df, MORE, ["KG", "UN"]).orderBy("id").collect()
    assert all(m[K.SCORE] <= o[K.SCORE] for m, o in zip(more, out))   # adding a rule never raises a score
    shuffled = audit(df.repartition(3).orderBy(F.rand(7)), DOC, ["KG", "UN"]).orderBy("id").collect()
    assert [tuple(r) for r in shuffled] == [tuple(r) for r in out]    # order/partitioning independent
