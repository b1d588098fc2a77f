"""The sliding log over a stream: windows go on over midnight, within a batch and from one to the next."""

from datetime import datetime, timedelta

import pytest

from tessellate import catalog
from tessellate.config import Limits
from tessellate.operators import traffic
from tessellate.streaming import stateful

MIDNIGHT = datetime(2024, 1, 1, 16)  # local
EVENTS = "event_id long, ts timestamp_ntz, user_id long"


def test_a_streamed_window_goes_on_over_midnight(spark, tmp_path):
    rows = [(i, MIDNIGHT + timedelta(seconds=s), 1) for i, s in enumerate((-60, -59, -1, 0, 0, 58, 59, 86_400))]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.queries()["streamed_sliding_limit"](spark, str(tmp_path)).orderBy("event_id").collect()
    assert [(r.in_window, r.in_day) for r in got] == [(1, 1), (2, 2), (3, 3), (4, 1), (4, 2), (4, 3), (4, 4), (1, 1)]


@pytest.mark.parametrize("window_ms", (60_000, 2 * 86_400_000))
def test_a_log_goes_on_over_midnight_from_batch_to_batch(spark, tmp_path, window_ms):
    rows = sorted(((i, MIDNIGHT + timedelta(seconds=(i * i) % 29 + 7 * (i - 60) + 86_400 * (i // 80)), i % 4 or None) for i in range(160)), key=lambda r: r[1])
    for part in (rows[:40], rows[40:55], rows[55:90], rows[90:]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    limits = Limits(per_minute=4, per_day=30, window_ms=window_ms)
    stream = stateful.source(spark, str(tmp_path / "in"), 1)
    got = stateful.run(stateful.sliding_stream(stream, limits, buckets=2, across_days=True), str(tmp_path / "out"))[0]
    want = traffic.sliding(spark.createDataFrame(rows, EVENTS), limits, across_days=True)
    shown = lambda df: sorted(tuple(r) for r in df.select("event_id", "in_window", "in_day", "verdict").collect())
    assert shown(got) == shown(want) and len(shown(got)) == 160
