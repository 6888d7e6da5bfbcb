"""Plan shape: no Python in the plan, one aggregate shuffle per uniqueness key set,
filters and projections reach the scan."""

import re

from pyspark.sql import functions as F

from calibra import fixtures as FX
from calibra.operators import incremental, reports
from calibra.operators.audit import audit
from calibra.registry import QUERIES

from conftest import SF01


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_udf_in_any_registered_query(spark):
    for name, fn in QUERIES.items():
        plan = _plan(fn(spark, SF01))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_one_key_count_per_uniqueness_key_set(spark):
    m = FX.view(spark, "/root/testdata/sf0.001", "materials")
    for rules, key_sets in ((FX.FLAGSHIP_RULES, 1), (FX.TYPED_RULES, 2)):
        final = _final_plan(audit(m, rules, FX.UNITS))
        # the key-count exchange feeds both the hot-key table and the lookup: computed once
        assert final.count("ReusedExchange") == key_sets
        # no per-row hash filter inferred from the salted join key
        assert "isnotnull(pmod" not in final


def _schemas(df):
    return set(re.findall(r"ReadSchema: (struct<[^>]*>)", _final_plan(df)))


def test_scan_reads_only_needed_columns(spark):
    (schema,) = _schemas(QUERIES["rule_blank"](spark, "/root/testdata/sf0.001"))
    assert schema == "struct<p_partkey:bigint,p_brand:string>"


def test_audits_and_lookups_read_only_the_columns_in_use(spark, tmp_path):
    """Reports over an audit, key lookups and code-table audits of a wide master read no
    unrelated column."""
    path = str(tmp_path / "wide")
    wide = FX.view(spark, "/root/testdata/sf0.001", "materials")
    wide.withColumns({f"otro{i}": F.lit(i) for i in range(8)}).write.parquet(path)
    m = spark.read.parquet(path)
    t = FX.view(spark, "/root/testdata/sf0.001", "audit_target_all")
    codes = spark.createDataFrame([("KG",), ("UN",)], "code string")
    for df in (reports.summary(audit(m, FX.FLAGSHIP_RULES, FX.UNITS)),
               reports.summary(audit(m, FX.TYPED_RULES, codes)),
               incremental.new_records(m, t).select("SKU"), incremental.open_anomalies(m, t).select("SKU", "marca")):
        assert not [s for s in _schemas(df) if "otro" in s]
    assert "struct<SKU:bigint>" in _schemas(incremental.new_records(m, t).select("SKU"))


def test_new_records_pushes_cutoff_filter_to_target_scan(spark):
    plan = _plan(QUERIES["new_records"](spark, SF01))
    import re
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(l_shipdate,1995-03-01", plan)


def test_key_count_side_reads_only_key_columns(spark):
    m = FX.view(spark, "/root/testdata/sf0.001", "materials")
    a = audit(m, FX.FLAGSHIP_RULES, FX.UNITS)
    a.collect()
    plan = a._jdf.queryExecution().executedPlan().toString()
    schemas = set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan))
    # the main scan reads what the fixture view needs; the key-count scan reads the 3 key columns
    assert "struct<p_name:string,p_brand:string,p_type:string>" in schemas
