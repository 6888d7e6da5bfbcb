"""Hot keys: same answers whatever the threshold, and a hot key is spread over tasks."""

from pyspark.sql import functions as F

from calibra import fixtures as FX
from calibra.operators import incremental
from calibra.operators.audit import audit

from conftest import SF001


def _sorted(df):
    cols = sorted(df.columns)
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_threshold_does_not_change_results(spark):
    m = FX.view(spark, SF001, "materials")
    t = FX.view(spark, SF001, "audit_target")
    for rules in (FX.FLAGSHIP_RULES, FX.TYPED_RULES):
        assert _sorted(audit(m, rules, FX.UNITS, hot_key_rows=1)) == _sorted(audit(m, rules, FX.UNITS))
    assert _sorted(incremental.new_records(m, t, hot_key_rows=1)) == _sorted(incremental.new_records(m, t))
    assert _sorted(incremental.open_anomalies(m, t, hot_key_rows=1)) == _sorted(incremental.open_anomalies(m, t))
    o = FX.view(spark, SF001, "origin_dates")
    assert _sorted(incremental.sync_dates(t, o, hot_key_rows=1)) == _sorted(incremental.sync_dates(t, o))


def test_null_and_blank_keys(spark):
    rows = [(i, None if i % 3 == 0 else ("" if i % 3 == 1 else str(i % 7))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, SKU string")
    target = spark.createDataFrame([("1",), ("2",), (None,)], "SKU string")
    for t in (1, 5, 10**6):
        new = incremental.new_records(df, target, hot_key_rows=t)
        assert new.where(F.col("SKU").isNull()).count() == 100          # null keys are always new
        assert new.where(F.col("SKU") == "1").count() == 0
        opened = incremental.open_anomalies(df, target.withColumn("Estado_Gestion", F.lit(0)), hot_key_rows=t)
        assert opened.count() == df.where(F.col("SKU").isin("1", "2")).count()


def test_hot_key_rows_are_spread_over_partitions(spark):
    # a third of the rows share the blank key
    rows = [(i, " " if i % 3 == 0 else f"k{i // 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, d string").repartition(8)
    doc = {"DEFAULT": {"Unicidad": {"d": {"regla": "duplicado_multicampo", "penalizacion": 100, "mensaje": "x"}}}}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = audit(df, doc, hot_key_rows=100)
        sizes = a.withColumn("p", F.spark_partition_id()).where(F.col("d") == " ").groupBy("p").count().collect()
        assert max(r["count"] for r in sizes) < 1000 / 2          # not all 1000 blank rows in one task
        assert a.where(F.col("d") == " ").where(F.col("Score_Unicidad") == 0).count() == 1000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
