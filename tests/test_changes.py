"""Tables changed in place, reports sent once, the gauge and the chain of providers."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessellate.operators import limiters
from tessellate.sources import shared
from tessellate.sources.keyed import Conflict, KeyedTable
from tessellate.streaming import reports, stateful

ROWS = "id long, at long, text string"


def held(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_change_rewrites_the_buckets_it_touches(spark, tmp_path):
    rows = [(i, 1, f"t{i}") for i in range(100)] + [(None, 1, "nobody"), (5, 0, "older")]
    made = KeyedTable.create(spark.createDataFrame(rows, ROWS), str(tmp_path / "t"), "id", 16, "at")
    assert held(made.read()) == sorted(rows[:-1], key=repr)
    before = {f for f in made.read().inputFiles()}
    touched = made.upsert(spark.createDataFrame([(5, 2, "new"), (500, 2, "more"), (6, 0, "stale"), (7, 1, "equal")], ROWS), "at")
    after = {f for f in made.read().inputFiles()}
    assert 1 <= len(touched) <= 4 and len(before & after) >= 16 - len(touched) - 1 and {f for f in before - after if int(f.split("bucket=")[1].split("/")[0]) not in touched} == set()
    now = {r.id: r.text for r in made.read().collect()}
    assert (now[5], now[500], now[6], now[7], now[None]) == ("new", "more", "t6", "equal", "nobody") and len(now) == 102
    made.delete(spark.createDataFrame([(5,), (None,), (12345,)], "id long"))
    assert {r.id for r in made.read().collect()} == set(range(100)) - {5} | {500}
    assert held(made.read(1)) == sorted(rows[:-1], key=repr)
    made.clear()
    assert made.read().collect() == [] and made.read().schema == made.read(1).schema
    assert made.upsert(spark.createDataFrame([], ROWS)) == []
    made.upsert(spark.createDataFrame([(1, 1, "again")], ROWS))
    assert held(made.read()) == [(1, 1, "again")]


def test_a_change_that_fails_or_comes_second_leaves_the_table(spark, tmp_path, monkeypatch):
    made = KeyedTable.create(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], ROWS), str(tmp_path / "t"), "id", 4)
    bad = spark.createDataFrame([(1, 2, "x")], ROWS).withColumn("text", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        made.upsert(bad)
    assert held(made.read()) == [(1, 1, "a"), (2, 1, "b")]
    old = made._state()
    made.upsert(spark.createDataFrame([(1, 2, "first")], ROWS))
    monkeypatch.setattr(KeyedTable, "_state", lambda self, version=None: old)
    with pytest.raises(Conflict):
        made.upsert(spark.createDataFrame([(1, 3, "second")], ROWS))
    monkeypatch.undo()
    assert held(made.read()) == [(1, 2, "first"), (2, 1, "b")]
    empty = KeyedTable.create(spark.createDataFrame([], ROWS), str(tmp_path / "e"), "id")
    assert empty.read().collect() == []


def test_reports_are_sent_once_whatever_breaks_off(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.createDataFrame([(date(2024, 1, 1), "one"), (date(2024, 1, 2), "two")], "day date, text string")
    reports.written(rows, path)  # and killed before it is published
    assert reports.sent(spark, path).collect() == []
    reports.deliver(rows, path)
    reports.deliver(rows.unionAll(spark.createDataFrame([(date(2024, 1, 3), "three")], rows.schema)), path)
    assert held(reports.sent(spark, path).select("text")) == [("one",), ("three",), ("two",)]
    made = reports.written(rows, path, force=True)
    reports.publish(spark, path, made)
    with pytest.raises(RuntimeError):
        reports.publish(spark, path, made)
    assert held(reports.sent(spark, path).select("text")) == [("one",), ("one",), ("three",), ("two",), ("two",)]


def test_a_daily_run_that_is_killed_goes_on(spark, tmp_path, monkeypatch):
    schema, start = "site string, visitor string, ts timestamp_ntz", datetime(2024, 5, 1, 3)
    parts = [[("cn", f"v{i % 3}", start + timedelta(hours=i)) for i in range(40)], [("overseas", "w", start + timedelta(days=4))]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path = str(tmp_path / "r")
    run = lambda: reports.daily_run(stateful.source(spark, str(tmp_path / "in"), 1), path, "1 hour")
    with monkeypatch.context() as m:
        m.setattr(reports, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(Exception, match="killed"):
            run()
    assert reports.sent(spark, path).collect() == []
    run()
    run()
    got = {str(r.day): r.text for r in reports.sent(spark, path).collect()}
    assert reports.sent(spark, path).count() == 3 and set(got) == {"2024-05-01", "2024-05-02", "2024-05-03"}
    assert "国内站：UV 3 · PV 13" in got["2024-05-01"] and "国内站：UV 3 · PV 24" in got["2024-05-02"]


def test_gauge(spark):
    rows = [("a", 1, 0, 100), ("a", 2, 0, 50), ("a", 3, 10, 500), ("a", 4, 50, 60), ("a", 5, 55, 70), ("a", 6, 60, None), ("b", 7, 55, 56), (None, 8, 1, 2), ("a", 9, None, 5), ("a", 10, 99, 99), ("a", 11, 100, 101)]
    got = limiters.gauged(spark.createDataFrame(rows, "instance string, event_id long, ms long, until long"), 2).collect()
    assert {r.event_id: (r.running, r.verdict) for r in got} == {1: (0, "ok"), 2: (1, "ok"), 3: (2, "busy"), 4: (1, "ok"), 5: (2, "busy"), 6: (1, "ok"), 7: (0, "ok"), 8: (0, "ok"), 10: (2, "busy"), 11: (1, "ok")}


def test_chain_remembers_what_failed(spark):
    calls = [(1, 0, {"x": False, "y": True}), (2, 10, {"x": False, "y": False}), (3, 20, {"x": True, "y": False}), (4, 25, {"x": True, "y": None}), (5, 115, {"x": True}), (6, 130, {"x": False, "y": True}), (7, 200, None)]
    rows = spark.createDataFrame([("i", e, ms, ok) for e, ms, ok in calls] + [("j", 8, 20, {"x": True})], "instance string, event_id long, ms long, ok map<string,boolean>")
    got = limiters.chained(rows, dict.fromkeys(("x", "y"), limiters.breaker(2, 100))).collect()
    assert {r.event_id: (r.provider, r.attempts, r.retry_at) for r in got} == {
        1: ("y", ["x", "y"], None), 2: (None, ["x", "y"], 110), 3: (None, ["y"], 110), 4: (None, [], 110), 5: ("x", ["x"], None), 6: ("y", ["x", "y"], None), 7: (None, ["x", "y"], 300), 8: ("x", ["x"], None),
    }


def test_places_are_new(spark):
    assert shared.place(spark, "a") != shared.place(spark, "a")
