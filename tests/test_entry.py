"""The driver contract: entry runs, every query has a callable, oracles match keys."""

import __spark_entry__ as E


def test_entry_flagship_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 200
    assert {"Score_Calidad", "Hallazgos_Detallados", "Estado_Gestion"} <= set(df.columns)


def test_queries_and_oracles_line_up():
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 50 and set(o) <= set(q)
    from calibra.registry import QUERIES
    assert set(QUERIES) <= set(o)          # every query of the library itself has its SQL
    assert all(callable(f) for f in q.values())
