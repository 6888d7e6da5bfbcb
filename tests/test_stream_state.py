"""Stateful streams: nothing is re-read, late rows, horizons, restarts."""

import datetime as dt
import os

import pytest

from calibra.streaming import stream_state as S

T0 = dt.datetime(2024, 3, 1)
SCHEMA = "id long, ts timestamp_ntz, clave string, tipo_mat string, valor double"
RULES = {"DEFAULT": {"Validez": {"valor": {"regla": "mayor_a", "valor": 10, "penalizacion": 100, "mensaje": "bajo"}}}}


def at(hours):
    return None if hours is None else T0 + dt.timedelta(hours=hours)


@pytest.fixture
def feed(spark, tmp_path):
    """feed(rows): a file for the stream's source, as one batch of the next run."""
    source = str(tmp_path / "in")

    def write(rows):
        spark.createDataFrame([(i, at(h), k, "T", float(v)) for i, h, k, v in rows], SCHEMA).write.mode("append").parquet(source)
    write.source, write.out, write.checkpoint = source, str(tmp_path / "out"), str(tmp_path / "checkpoint")
    write.schema = spark.createDataFrame([], SCHEMA).schema
    return write


def test_repeats_within_their_period(spark, feed):
    def run():
        return S.stream_repeats(spark, feed.source, feed.schema, feed.out, ["clave"], "id", "ts", "1 day", "2 days", feed.checkpoint)
    feed([(1, 5, "a", 1), (2, 6, " A", 1), (3, 7, "b", 1), (4, None, "b", 1), (5, 8, None, 1)])
    run()
    feed([(6, 9, "B ", 1), (7, 30, "a", 1), (8, 4, "a", 1), (9, 9, "", 1)])
    run()
    read = lambda: {(r.periodo, r.clave): (r.veces, r.primero) for r in S.read_repeats(spark, feed.out, ["clave"]).collect()}
    assert read() == {(at(0), "A"): (3, 8), (at(0), "B"): (2, 3), (at(0), ""): (2, 5)}
    feed([(10, 200, "z", 1)])
    run()                                          # the watermark is now at hour 152
    feed([(11, 10, "a", 1), (12, 201, "z", 1)])
    run()
    assert read() == {(at(0), "A"): (3, 8), (at(0), "B"): (2, 3), (at(0), ""): (2, 5), (at(192), "Z"): (2, 10)}
    files = sorted(os.listdir(feed.out))
    run()                                          # no new input: nothing changes
    assert read()[at(192), "Z"] == (2, 10) and len(os.listdir(feed.out)) <= len(files) + 1


def test_first_records_pass_once_a_horizon(spark, feed):
    def run():
        return S.stream_first_records(spark, feed.source, feed.schema, feed.out, ["clave"], "id", "ts", "1 day", feed.checkpoint, salts=4)
    feed([(i, 1, "hot", 1) for i in range(200)] + [(300, 2, "a", 1), (301, 2, None, 1)])
    run()
    feed([(400, 3, "HOT ", 1), (401, 3, "a", 1), (402, 4, "c", 1)])
    run()
    got = [(r.clave, r.id) for r in spark.read.parquet(feed.out).collect()]
    assert sorted(((k or "").strip().upper() for k, _ in got)) == ["", "A", "C", "HOT"]
    assert dict(got)["a"] == 300 and 400 not in dict(got).values()
    feed([(500, 100, "d", 1)])
    run()                                          # the watermark passes the horizon of all keys but d
    feed([(501, 101, "a", 1), (502, 101, "d", 1)])
    run()
    got = sorted((r.id for r in spark.read.parquet(feed.out).collect() if r.id >= 500))
    assert got == [500, 501]


def test_failures_per_window_leave_out_late_rows(spark, feed):
    def run():
        return S.stream_failures(spark, feed.source, feed.schema, feed.out, RULES, "ts", "2 hours", "3 hours", feed.checkpoint, slide="1 hour")
    feed([(1, 10, "a", 5), (2, 10.5, "a", 50), (3, None, "a", 5)])
    run()                                          # watermark: 7.5
    feed([(4, 7, "a", 5), (5, 5, "a", 5), (6, 6.2, "a", 5), (7, 10.9, "a", 1)])
    run()
    got = {(r.inicio, r.fin): (r.filas, r.fallidas) for r in S.read_failures(spark, feed.out).collect()}
    # 7 falls in windows 6-8 and 7-9; 6.2 in 5-7 (closed) and 6-8; 5 in 4-6 and 5-7 (both closed)
    assert got == {(at(9), at(11)): (3, 2), (at(10), at(12)): (3, 2), (at(6), at(8)): (2, 2), (at(7), at(9)): (1, 1)}


def test_uniqueness_rules_are_refused_by_row_streams(spark, feed):
    feed([(1, 1, "a", 1)])
    rules = {"DEFAULT": {"Unicidad": {"clave": {"regla": "duplicado_multicampo", "penalizacion": 50, "mensaje": "x"}}}}
    with pytest.raises(ValueError, match="stream_repeats"):
        S.stream_failures(spark, feed.source, feed.schema, feed.out, rules, "ts", "1 hour", "1 hour", feed.checkpoint)
