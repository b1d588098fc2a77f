"""Streams with state over several batches: order, expiry, bounds, late rows."""

import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tessellate.config import Limits
from tessellate.functions.times import local_day, millis
from tessellate.operators import limiters, traffic
from tessellate.streaming import stateful

START = datetime(2024, 1, 1, 15, 59, 50)
EVENTS = "event_id long, user_id long, ts timestamp_ntz"


def files(spark, path, parts, schema):
    """Each part as a file, in order of arrival."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return stateful.source(spark, path, 1)


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_sliding_log_equals_the_batch_form_over_files_in_time_order(spark, tmp_path):
    rows = [(i, (i * 7) % 3 if i % 11 else None, START + timedelta(seconds=(i * i) % 17 + 4 * i)) for i in range(120)]
    rows.sort(key=lambda r: r[2])
    limits = Limits(per_minute=4, per_day=15)
    stream = files(spark, str(tmp_path / "in"), [rows[:50], rows[50:51], rows[51:]], EVENTS)
    got = stateful.run(stateful.sliding_stream(stream, limits), str(tmp_path / "out"))[0]
    want = traffic.sliding(spark.createDataFrame(rows, EVENTS), limits)
    cols = ("event_id", "in_window", "in_day", "verdict")
    assert rows_of(got, *cols) == rows_of(want, *cols)
    assert {r[3] for r in rows_of(got, *cols)} == {"ok", "minute_limit", "daily_limit", "missing_user"}


def test_a_day_is_the_local_one_in_any_session_zone(spark):
    rows = [(1, 1, START), (2, 1, START + timedelta(seconds=20)), (3, None, START)]
    for zone in ("America/New_York", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = traffic.sliding(spark.createDataFrame(rows, EVENTS))
            assert rows_of(got, "event_id", "in_day", "in_window", "verdict") == [(1, 1, 1, "ok"), (2, 1, 1, "ok"), (3, 0, 0, "missing_user")]
            zoned = spark.createDataFrame([(START.replace(tzinfo=timezone.utc),)], "ts timestamp")
            assert zoned.select(millis(zoned).alias("a"), local_day(millis(zoned)).cast("string").alias("d")).first() == (1704124790000, "2024-01-01")
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_limiter_goes_on_after_a_restart_and_forgets_silent_keys(spark, tmp_path):
    schema, path = "event_id long, user_id long, ms long, ok boolean", str(tmp_path / "in")
    stream = files(spark, path, [[(1, 1, 1000, True), (2, 1, 1030, True), (3, 1, 1070, None)], [(4, 1, 1100, True), (5, None, 1130, True), (6, 2, None, True)]], schema)
    keep = lambda s, ms: stateful.run(stateful.limited_stream(s, limiters.least_interval(60), ms), str(tmp_path / f"out{ms}"))[0]
    assert rows_of(keep(stream, stateful.WEEK), "event_id", "verdict") == [(1, "ok"), (2, "too_soon"), (3, "ok"), (4, "too_soon"), (5, "ok")]
    assert len(rows_of(keep(stream, 200), "event_id")) == 5
    time.sleep(1)
    spark.createDataFrame([(7, 1, 1120, True)], schema).coalesce(1).write.mode("append").parquet(path)
    assert dict(rows_of(keep(stateful.source(spark, path, 1), stateful.WEEK), "event_id", "verdict"))[7] == "too_soon"
    assert dict(rows_of(keep(stateful.source(spark, path, 1), 200), "event_id", "verdict"))[7] == "ok"


def test_pieces_wait_for_the_whole_answer_or_time_out(spark, tmp_path):
    schema, path = "answer_id long, seq long, piece string, last boolean", str(tmp_path / "in")
    parts = [[(1, 3, "c", True), (2, 1, "x", False), (3, 1, "only", True), (4, 2, "z", None)], [(1, 1, "a", False), (1, 1, "again", False), (2, 2, None, None)], [(1, 2, "b", False), (2, 3, "y", True)]]
    stream = files(spark, path, parts, schema)
    got = stateful.run(stateful.token_stream(stream, 1500), str(tmp_path / "out"))[0]
    done = {(1, "abc"), (2, "xy"), (3, "only")}
    assert {(r.answer_id, r.text) for r in got.filter("NOT timed_out").collect()} == done
    time.sleep(2)
    spark.createDataFrame([(9, 1, "n", True)], schema).coalesce(1).write.mode("append").parquet(path)
    got = stateful.run(stateful.token_stream(stateful.source(spark, path, 1), 1500), str(tmp_path / "out"))[0]
    assert {(r.answer_id, r.text, r.timed_out) for r in got.collect()} == {(*d, False) for d in done} | {(9, "n", False), (4, None, True)}


def test_late_answers_are_dropped(spark, tmp_path):
    schema = "k string, no long, at long, is_answer boolean, text string"
    parts = [[("u", 1, 10, False, None), ("v", 7, 10, False, None)], [("u", 1, 20, True, "one"), ("u", 2, 20, False, None), ("v", 7, 30, True, "seven")], [("u", 2, 40, True, "two"), ("w", 1, 5, True, "unasked"), (None, 1, 5, False, None), (None, 1, 6, True, "nobody's")]]
    got = stateful.run(stateful.answers_in_time(files(spark, str(tmp_path / "in"), parts, schema)), str(tmp_path / "out"))[0]
    assert rows_of(got, "k", "no", "text") == [("", 1, "nobody's"), ("u", 2, "two"), ("v", 7, "seven")]


def test_visitors_are_bounded_and_days_are_closed(spark, tmp_path):
    schema = "site string, visitor string, ts timestamp_ntz"
    day = datetime(2024, 3, 1, 1)
    first = [("a", f"v{i % 40}", day) for i in range(100)] + [("b", None, day), (None, "x", day)]
    parts = [first, [("a", "v1", day + timedelta(hours=1)), ("a", "new", day)], [("a", "v1", day + timedelta(days=4))], [("a", "late", day), ("a", "v2", day + timedelta(days=4))]]
    stream = stateful.visitor_stream(files(spark, str(tmp_path / "in"), parts, schema), "1 hour", Limits(uv_most=25))
    got, query = stateful.run(stream, str(tmp_path / "out"), timers=True)
    closed = {(str(r.day), r.site): (r.pv, r.uv) for r in got.filter("closed").collect()}
    assert closed == {("2024-03-01", "a"): (102, 25), ("2024-03-01", "b"): (1, 0), ("2024-03-01", ""): (1, 1)}
    open_ = got.filter(F.col("day") == "2024-03-05").agg(F.max("pv"), F.max("uv")).first()
    assert tuple(open_) == (2, 2) and stateful.late_rows(query) == 1


def test_settings_are_put_back(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    with pytest.raises(Exception, match="lost"):
        stream = files(spark, str(tmp_path / "in"), [[(1, 1, START)]], EVENTS).withColumn("user_id", F.raise_error(F.lit("lost")).cast("long"))
        stateful.run(stateful.sliding_stream(stream), str(tmp_path / "out"))
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == before
