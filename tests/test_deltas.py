"""Dates by overlay, key counts over loads, as-of join, frames, audit differences."""

import collections
import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from calibra.operators import changes, incremental, ordered, reports
from calibra.operators.audit import audit
from calibra.sources import deltas
from calibra.sources.history import score_trend
from calibra.sources.io import hadoop_path

DAY = dt.datetime(2024, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


@pytest.fixture
def narrow(spark):
    """Many small ranges and partitions, so that keys cross borders."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "17"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def files_of(spark, folder):
    """Name and time of every data file below a folder."""
    out = {}
    files, root = hadoop_path(spark, folder)
    it = files.listFiles(root, True)
    while it.hasNext():
        s = it.next()
        out[s.getPath().toString()] = s.getModificationTime()
    return out


# -- overlay ---------------------------------------------------------------------

TARGET = "SKU long, Fecha_Actualizacion timestamp_ntz, Fecha_Ingreso timestamp_ntz, Fecha_Actualizacion_M timestamp_ntz, nota string"


def target_rows(rng, n, start):
    return [(rng.choice([None, 1, 1, 1, *range(2, 12)]), day(rng.choice([None, 0, 1, 2, 3])), day(50), None, f"r{start + i}") for i in range(n)]


def versions(rng, spark, created):
    rows = [(k, day(rng.choice([None, 1, 2, 3])), day(60 + rng.randrange(5))) for k in rng.sample(range(1, 14), 8)] + [(None, day(9), day(9))]
    df = spark.createDataFrame(rows, "SKU long, fecha_actualiza timestamp_ntz, fecha_creacion timestamp_ntz")
    return df if created else df.drop("fecha_creacion")


def content(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_overlay_reads_like_whole_table_updates(spark, tmp_path, seed):
    """Every step against the whole-table update of the same dates."""
    rng = random.Random(seed)
    table = deltas.DatedTable(spark, str(tmp_path / "t"), buckets=4)
    plain = spark.createDataFrame(target_rows(rng, 60, 0), TARGET)
    table.create(plain)
    for step in range(4):
        src, now = versions(rng, spark, created=step % 2 == 0), day(100 + step)
        refreshed = incremental.sync_dates(plain, src, order=["fecha_actualiza"], now=F.lit(now).cast("timestamp_ntz"))
        expected = refreshed.where("__changed").count()
        plain = spark.createDataFrame(refreshed.drop("__changed").collect(), TARGET)
        before = files_of(spark, table.base)
        assert table.sync_dates(src, order=["fecha_actualiza"], now=now) == expected
        assert files_of(spark, table.base) == before                   # no base file is written or changed
        assert table.sync_dates(src, order=["fecha_actualiza"], now=now) == 0
        if step == 1:
            more = target_rows(rng, 20, 100)
            table.append(spark.createDataFrame(more, TARGET))
            plain = plain.unionByName(spark.createDataFrame(more, TARGET))
        if step == 2:
            kept = files_of(spark, table.base)
            chosen = table.compact(least=2)
            now_held = files_of(spark, table.base)
            assert set(kept.items()) <= set(now_held.items())
            fresh = {p.split("bucket=")[1].split("/")[0] for p in set(now_held) - set(kept) if "bucket=" in p}
            assert fresh == {str(b) for b in chosen}
        assert content(table.read()) == content(plain), step
        assert content(table.read(hot_key_rows=5)) == content(plain), step
    assert table.compact() and not table.compact()
    assert content(table.read()) == content(plain)


def test_overlay_holds_only_changed_keys(spark, tmp_path):
    table = deltas.DatedTable(spark, str(tmp_path / "t"), buckets=4)
    rows = [(k % 50, day(1), f"r{k}") for k in range(500)]
    table.create(spark.createDataFrame(rows, "SKU long, Fecha_Actualizacion timestamp_ntz, nota string"))
    src = spark.createDataFrame([(7, day(2)), (8, day(1)), (999, day(5))], "SKU long, fecha_actualiza timestamp_ntz")
    assert table.sync_dates(src) == 10
    (_, path), = deltas.complete_versions(spark, table.dates)
    assert [r["__calibra_tk"] for r in spark.read.parquet(path).collect()] == ["7"]
    with pytest.raises(ValueError):
        table.create(table.read())


def test_incomplete_versions_are_not_read(spark, tmp_path):
    table = deltas.DatedTable(spark, str(tmp_path / "t"), buckets=2)
    table.create(spark.createDataFrame([(1, day(1))], "SKU long, Fecha_Actualizacion timestamp_ntz"))
    table.sync_dates(spark.createDataFrame([(1, day(2))], "SKU long, fecha_actualiza timestamp_ntz"))
    (_, path), = deltas.complete_versions(spark, table.dates)
    os.remove(os.path.join(path, "_SUCCESS"))
    assert [r.Fecha_Actualizacion for r in table.read().collect()] == [day(1)]
    assert table.sync_dates(spark.createDataFrame([(1, day(3))], "SKU long, fecha_actualiza timestamp_ntz")) == 1
    assert [r.Fecha_Actualizacion for r in table.read().collect()] == [day(3)]


# -- key counts ------------------------------------------------------------------

def test_loads_count_keys_like_one_table(spark, tmp_path):
    rng = random.Random(3)
    store = deltas.KeyCounts(spark, str(tmp_path / "k"), ["a", "b"], buckets=4)
    seen = collections.Counter()
    assert store.known(spark.createDataFrame([("x", 1)], "a string, b long")) is None
    for n in range(5):
        rows = [(rng.choice(["x", " X", "y", None, "", "hot", "hot", "hot"]), rng.randrange(3)) for _ in range(40)]
        load = spark.createDataFrame(rows, "a string, b long")
        norm = collections.Counter(((a or "").strip().upper(), str(b)) for a, b in rows)
        known = store.known(load)
        if n:
            assert {(r.a, r.b): r[deltas.COUNT] for r in known.collect()} == {k: seen[k] for k in norm if k in seen}
        store.add(load, n)
        store.add(load, n)                            # a load that is run again counts once
        seen += norm
        if n == 2:
            store.compact()
            with pytest.raises(ValueError):
                store.add(load, 2)
        assert {(r.a, r.b): r[deltas.COUNT] for r in store.counts().collect()} == dict(seen)


def test_a_small_load_reads_only_its_buckets(spark, tmp_path):
    store = deltas.KeyCounts(spark, str(tmp_path / "k"), ["a"], buckets=8)
    store.add(spark.range(400).select(F.col("id").cast("string").alias("a")))
    known = store.known(spark.createDataFrame([("17",), ("17",)], "a string"))
    assert len({f.split("bucket=")[1].split("/")[0] for f in known.inputFiles()}) == 1 < 8
    assert [r.a for r in known.collect()] == ["17"]


def test_audit_over_loads_marks_keys_of_earlier_loads(spark, tmp_path):
    rules = {"DEFAULT": {"Unicidad": {"clave": {"regla": "duplicado_multicampo", "penalizacion": 50, "mensaje": "repetida"}}}}
    store = deltas.KeyCounts(spark, str(tmp_path / "k"), ["clave"], buckets=2)
    first = spark.createDataFrame([("a", "T"), ("b", "T"), ("b", "T")], "clave string, tipo_mat string")
    second = spark.createDataFrame([("A ", "T"), ("c", "T")], "clave string, tipo_mat string")
    store.add(first)
    got = audit(second, rules, reference=store.known(second)).collect()
    assert {r.clave: r.Score_Unicidad for r in got} == {"A ": 50.0, "c": 100.0}


# -- ordered operators -----------------------------------------------------------

def test_asof_join_matches_brute_force_with_a_hot_key(narrow):
    rng = random.Random(4)
    left = [(i, rng.choice(["hot", "hot", "hot", "a", "b", "zz", None]), day(rng.choice([None, *range(40)]))) for i in range(400)]
    left += left[:3]
    right = [(rng.choice(["hot", "a", "b", "never", None]), day(rng.choice([None, *range(5, 45)])), j) for j in range(150)]
    a = narrow.createDataFrame(left, "id long, clave string, cuando timestamp_ntz").withColumn("v", F.lit("clash"))
    b = narrow.createDataFrame(right, "clave string, desde timestamp_ntz, version long")
    got = ordered.asof_join(a, b, "clave", "cuando", "desde", ["version"], ties=["version"]).collect()

    def valid(k, t):
        fit = [(d, v) for kk, d, v in right if kk == k and d is not None and t is not None and d <= t and k is not None]
        return max(fit, default=(None, None))
    expected = collections.Counter((i, k, t, "clash", *valid(k, t)) for i, k, t in left)
    assert collections.Counter(tuple(r) for r in got) == expected


def test_asof_join_spreads_a_hot_key(narrow):
    rows = narrow.range(4000).select(F.col("id"), F.lit("hot").alias("clave"), F.col("id").alias("t"))
    dealt = ordered.dealt(rows, ["clave"], ["t"], "test")
    sizes = [r["count"] for r in dealt.groupBy(ordered.PART).count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 1200


def test_empty_sides(spark):
    left = spark.createDataFrame([(1, "a", day(1))], "id long, clave string, cuando timestamp_ntz")
    right = spark.createDataFrame([], "clave string, desde timestamp_ntz, version long")
    (row,) = ordered.asof_join(left, right, "clave", "cuando", "desde", ["version"]).collect()
    assert row.version_vigente is None and row.id == 1
    assert ordered.asof_join(left.limit(0), right, "clave", "cuando", "desde", ["version"]).count() == 0


@pytest.mark.parametrize("runs", [1, 3, 40])
def test_trend_matches_brute_force_across_ranges(narrow, runs):
    rng = random.Random(runs)
    rows = [(i, day(rng.randrange(30)), rng.choice(["hot", "hot", "hot", "b", None]), float(rng.randrange(100))) for i in range(300)]
    got = score_trend(narrow.createDataFrame(rows, "id_ejecucion long, fecha timestamp_ntz, dominio string, score_global double"), runs=runs, digits=6)
    by = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        by[r[2]].append(r)
    expected = {}
    for runs_of in by.values():
        for n, r in enumerate(runs_of):
            last = [x[3] for x in runs_of[max(0, n - runs + 1):n + 1]]
            before = runs_of[n - 1][3] if n else None
            expected[r[0]] = (before, None if before is None else r[3] - before, round(sum(last) / len(last), 6))
    assert {r.id_ejecucion: (r.anterior, r.cambio, r.media_movil) for r in got.collect()} == expected
    assert got.columns == ["id_ejecucion", "fecha", "dominio", "score_global", "anterior", "cambio", "media_movil"]


# -- changes and cube -------------------------------------------------------------

def audited(spark, rows):
    return spark.createDataFrame(rows, "SKU string, Hallazgos_Detallados string")


def test_changes_keep_multiplicity(spark):
    before = audited(spark, [("1", "a, b, "), ("1", "a, "), ("2", ""), (None, "a, "), ("4", None), ("5", "Sin Errores")])
    after = audited(spark, [("1", "a, "), ("2", "c, "), ("3", "a, a, "), (None, "a, "), ("4", "nan")])
    got = {(r.SKU, r.falla): (r.antes, r.despues, r.aparecen, r.siguen, r.desaparecen) for r in changes.finding_changes(before, after).collect()}
    assert got == {("1", "a"): (2, 1, 0, 1, 1), ("1", "b"): (1, 0, 0, 0, 1), ("2", "c"): (0, 1, 1, 0, 0),
                   ("3", "a"): (0, 2, 2, 0, 0), (None, "a"): (1, 1, 0, 1, 0)}
    total = {r.falla: (r.aparecen, r.siguen, r.desaparecen) for r in changes.change_summary(changes.finding_changes(before, after)).collect()}
    assert total == {"a": (2, 2, 1), "b": (0, 0, 1), "c": (1, 0, 0)}


def test_changes_take_one_shuffle(spark):
    plan = changes.finding_changes(audited(spark, [("1", "a")]), audited(spark, [("1", "b")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_cube_tells_subtotals_from_nulls(spark):
    rows = [("M", None, 10.0), ("M", "T", 90.0), ("D", "T", 60.0)]
    df = spark.createDataFrame(rows, "dominio string, tipo_mat string, Score_Calidad double")
    got = {(r.dominio, r.tipo_mat, r.banda, r.nivel): (r.filas, r.score) for r in reports.score_cube(df, ["dominio", "tipo_mat"]).collect()}
    assert got[None, None, None, 7] == (3, pytest.approx(160 / 3))
    assert got["M", None, None, 3] == (2, 50.0)                     # all types of M
    assert got["M", None, None, 1] == (1, 10.0)                     # the null type of M
    assert len([k for k in got if k[3] == 0]) == 3
