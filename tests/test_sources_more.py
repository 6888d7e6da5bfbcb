"""Search index, history claims, nested types, unique mark names."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from calibra.operators import reports, shaping
from calibra.operators.search import search_rows
from calibra.sources import history, text_index

WHEN = dt.datetime(2024, 2, 3, 4, 5, 6, 7)


def audited(spark, n=3):
    return spark.range(n).select(F.lit(50.0).alias("Score_Calidad"))


# -- search index ------------------------------------------------------------------

@pytest.fixture
def indexed(spark, tmp_path):
    table, index = str(tmp_path / "t"), str(tmp_path / "i")
    words = ["alpha beta", "GAMMA delta", "KKelvin sign", "İstanbul", "dıtto", "paſta", "ΟΔΟΣ", "straße 12", None, ""]
    for i, w in enumerate(words):
        spark.createDataFrame([(i, w), (i + 100, "common text")], "id long, t string").coalesce(1).write.mode("append").parquet(table)
    assert text_index.update_index(spark, table, index) == len(words) and text_index.update_index(spark, table, index) == 0
    return table, index


@pytest.mark.parametrize("term", ["alpha", "ALPHA", "a b", "gamma", "kke", "istan", "İSTAN", "ditto", "pasta", "common", "οδο", "ss", "straße",
                                  "STRASSE", "e 12", "zzz", "", "(", "10"])
def test_indexed_search_finds_what_a_whole_search_finds(spark, indexed, term):
    table, index = indexed
    whole = search_rows({"x": spark.read.parquet(table)}, term, regex=False).collect()
    got = text_index.search_indexed(spark, table, index, term, "x").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, whole), key=str)


def test_index_skips_files_but_never_unknown_ones(spark, indexed):
    table, index = indexed
    assert len(text_index.candidate_files(spark, table, index, "alpha")) == 1
    assert len(text_index.candidate_files(spark, table, index, "common")) == 10
    spark.createDataFrame([(1, "alpha")], "id long, t string").write.mode("append").parquet(table)
    assert 1 < len(text_index.candidate_files(spark, table, index, "alpha")) < 12       # the new files are read
    assert text_index.search_indexed(spark, table, index, "ALPHA").count() == 2


# -- history -----------------------------------------------------------------------

def runs(spark, path):
    return sorted(r.id_ejecucion for r in history.read_history(spark, path).collect())


def test_a_source_is_recorded_once_ever(spark, tmp_path):
    path = str(tmp_path / "h")
    record = lambda source, rid, **kw: history.append_history(audited(spark), path, "u", "d", run_id=rid, strict=True, source_name=source, **kw)
    assert record("a", "R1") == "R1" and record("a", "R2") is None and record("b", "R3") == "R3" and record("a", "R4") is None
    assert runs(spark, path) == ["R1", "R3"]


def test_a_failed_write_is_forgotten(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "h")
    real = history.history_record

    def broken(*a, **k):
        raise OSError("store away")
    monkeypatch.setattr(history, "history_record", broken)
    with pytest.warns(UserWarning):
        assert history.append_history(audited(spark), path, "u", "d", run_id="R1", source_name="a") is None
    monkeypatch.setattr(history, "history_record", real)
    assert history.append_history(audited(spark), path, "u", "d", run_id="R2", source_name="a") == "R2"
    assert runs(spark, path) == ["R2"]


def test_a_dead_claim_is_taken_over_unless_its_record_was_written(spark, tmp_path):
    path = str(tmp_path / "h")
    history.ensure_history(spark, path)
    place, rid = history._claim(spark, path, "a", "R1", 60)
    record = lambda rid, stale: history.append_history(audited(spark), path, "u", "d", run_id=rid, strict=True, source_name="a", stale_seconds=stale)
    assert record("R2", 3600) is None                       # its owner may be alive
    time.sleep(1.1)
    assert record("R3", 1) == "R1" and runs(spark, path) == ["R1"]
    os.remove(place + ".done")                              # died between the write and the mark
    time.sleep(1.1)
    assert record("R4", 1) is None and runs(spark, path) == ["R1"] and os.path.exists(place + ".done")


def test_last_source_guard_as_the_original(spark, tmp_path):
    path = str(tmp_path / "h")
    for n, source in enumerate("aabab"):
        history.append_history(audited(spark), path, "u", "d", run_id=f"R{n}", strict=True, source_name=source, once="last")
    assert runs(spark, path) == ["R0", "R2", "R3", "R4"]


# -- shapes ------------------------------------------------------------------------

def test_nested_extension_types_become_storage(spark):
    from pyspark.ml.functions import array_to_vector
    base = spark.createDataFrame([(1, [1.0, 2.0], WHEN), (2, None, None)], "i int, a array<double>, t timestamp_ntz")
    v = F.when(F.col("a").isNotNull(), array_to_vector("a"))
    deep = base.select("i", "t", v.alias("v"), F.when(F.col("i") == 1, F.struct(F.array(F.struct(v.alias("x"), "t")).alias("l"))).alias("s"),
                       F.create_map(F.lit("k"), v).alias("m"), F.array("i").alias("plain"))
    out = shaping.normalize_types(deep)
    assert "vector" not in out.schema.simpleString() and "udt" not in out.schema.simpleString().lower()
    assert dict(out.dtypes)["t"] == "timestamp_ntz" and dict(out.dtypes)["plain"] == "array<int>"
    one, two = out.orderBy("i").collect()
    assert list(one.v["values"]) == list(one.s.l[0].x["values"]) == list(one.m["k"]["values"]) == [1.0, 2.0]
    assert two.v is None and two.s is None and two.m == {"k": None} and one.s.l[0].t == WHEN
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Bogota")
        zoned = shaping.normalize_types(deep, wall_clock=False)
        assert "timestamp_ntz" not in zoned.schema.simpleString()
        got = zoned.orderBy("i").select(F.unix_micros("t").alias("a"), F.unix_micros(F.col("s.l")[0]["t"]).alias("b")).collect()
        expected = int(WHEN.replace(tzinfo=dt.timezone.utc).timestamp()) * 10**6 + 7
        assert tuple(got[0]) == (expected, expected) and tuple(got[1]) == (None, None)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_mark_names_differ_across_labels():
    names = reports.mark_names(["a", "b", "c", "d"], {"SKU"}, {"a": "SKU", "b": "SKU · marca", "c": "sku", "d": "SKU · marca"})
    shown = [n.casefold() for _, n in names]
    assert len(set(shown)) == 4 and "sku" not in shown and names[0] == ("a", "SKU · marca")
