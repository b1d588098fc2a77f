"""Operators with keyed state over streams (transformWithState): sliding log, limiters, token streams, answers in time, visitors.

State is in RocksDB and expires by its time to live or by a timer, so a key that falls silent leaves nothing behind. Rows of a
micro-batch are taken in time order; across batches they count as they arrive. `run` drives a stream over what its source holds
and stops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..config import Limits
from ..functions.times import local_day, millis
from ..operators.limiters import Step
from ..operators.traffic import daily_verdict
from ..sources import shared

WEEK = 7 * 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drive(writer: DataStreamWriter, timers: bool = False) -> StreamingQuery:
    """Run a stream over all that its source holds; its checkpoint goes on where an earlier run ended.

    timers: also run batches without data, which event-time timers need. (Processing-time state would ask for them for ever.)
    """
    spark = writer._spark
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": str(timers).lower()}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return query


def run(stream: DataFrame, path: str | None = None, timers: bool = False) -> tuple[DataFrame, StreamingQuery]:
    """drive a stream into a table under path, beside its checkpoint."""
    path = path or shared.place(stream.sparkSession, "stream")
    query = drive(stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint"), timers)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows"), query


def source(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """A Parquet table, a folder or a single file, as a stream, so many of its files a batch."""
    some = f"{path[:-1]}[{path[-1]}]"  # a pattern: a stream takes a plain path for a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(some)


def _ordered(parts: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(list(by), kind="stable")


class SlidingLog(StatefulProcessor):
    """Users of a bucket in a local day: how many requests each had, and a log of those of the last window. Denied requests count.

    Requests of days before that the day's windows reach (later > 0) go into the log alone.
    """

    def __init__(self, limits: Limits, live_ms: int):
        self.limits, self.live_ms = limits, live_ms

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "users array<string>, n array<long>, whose array<long>, at array<long>", self.live_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        users, n, whose, at = map(list, self.held.get() or ((),) * 4)
        new = _ordered(rows, "user_id", "ms", "event_id")
        number = {u: i for i, u in enumerate(users)}
        mine = np.array([number.setdefault(u, len(number)) for u in new.user_id], dtype="int64")
        ms = new.ms.to_numpy("int64")
        counts = np.array(n + [0] * (len(number) - len(n)), dtype="int64")
        own = new.later.to_numpy() == 0
        in_day = counts[mine] + pd.Series(own.astype("int64")).groupby(mine).cumsum().to_numpy()
        counts += np.bincount(mine[own], minlength=len(counts))
        who, times = np.append(np.array(whose, dtype="int64"), mine), np.append(np.array(at, dtype="int64"), ms)
        # one number for user and time, so far apart that no window holds two users; of one time all see each other, as in the batch form
        low, window = times.min(), self.limits.window_ms
        apart = times.max() - low + window
        line, asked = np.sort(who * apart + times - low), mine * apart + ms - low
        near = np.searchsorted(line, asked, "right") - np.searchsorted(line, asked - window, "right")
        last = np.full(len(counts), np.iinfo("int64").min + window)
        np.maximum.at(last, mine, ms)
        live = times > last[who] - window
        self.held.update((list(number), counts.tolist(), who[live].tolist(), times[live].tolist()))
        yield pd.DataFrame({"event_id": new.event_id.to_numpy()[own], "user_id": new.user_id.to_numpy()[own], "in_window": near[own], "in_day": in_day[own]})

    def close(self) -> None:
        pass


def sliding_stream(requests: DataFrame, limits: Limits = Limits(), live_ms: int = WEEK, buckets: int = 256, across_days: bool = False) -> DataFrame:
    """(event_id, user_id, in_window, in_day, verdict) of a stream of requests (user_id, event_id, ts), as traffic.sliding has them.

    A window ends with its day, or goes on across_days: a request that the next day's windows can reach is then put to that day's log too.

    Users are dealt to buckets. A bucket's day is one key, whose state lives live_ms: state costs a call for each key, which users
    would pay one by one. Requests without a user are refused and count for nothing.
    """
    rows = requests.select(F.col("user_id").cast("string").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), millis(requests).alias("ms")).filter("ms IS NOT NULL")
    rows = rows.withColumns({"day": local_day(F.col("ms")), "bucket": F.pmod(F.xxhash64("user_id"), F.lit(buckets))})
    reached = local_day(F.col("ms") + (limits.window_ms - 1)) if across_days else F.col("day")
    dealt = rows.filter("user_id IS NOT NULL").select("user_id", "event_id", "ms", "bucket", F.posexplode(F.sequence("day", reached)).alias("later", "day"))
    known = dealt.groupBy("bucket", "day").transformWithStateInPandas(SlidingLog(limits, live_ms), "event_id long, user_id string, in_window long, in_day long", "append", "ProcessingTime")
    nobody = rows.filter("user_id IS NULL").select("event_id", "user_id", F.lit(0).cast("long").alias("in_window"), F.lit(0).cast("long").alias("in_day"))
    return known.unionByName(nobody).withColumn("verdict", daily_verdict(limits))


class Limiter(StatefulProcessor):
    """The fold of operators.limiters over a key's requests."""

    def __init__(self, step: Step, live_ms: int):
        self.step, self.live_ms = step, live_ms

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "v array<long>", self.live_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(int(x) for x in (self.held.get() or ((),))[0])
        out = []
        for ms, event, ok in _ordered(rows, "ms", "event_id")[["ms", "event_id", "ok"]].itertuples(index=False):
            held, verdict = self.step(held, int(ms), bool(ok))
            out.append((key[0], int(event), int(ms), verdict))
        self.held.update((list(held),))
        yield pd.DataFrame(out, columns=["k", "event_id", "ms", "verdict"])

    def close(self) -> None:
        pass


def limited_stream(requests: DataFrame, step: Step, live_ms: int = WEEK) -> DataFrame:
    """(k, event_id, ms, verdict) of a stream of requests (user_id, event_id, ms, ok). State lives live_ms after a key's last
    batch. Null keys are one key, rows without a time are left out."""
    rows = requests.filter("ms IS NOT NULL").select(F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("k"), "event_id", "ms", F.coalesce("ok", F.lit(True)).alias("ok"))
    return rows.groupBy("k").transformWithStateInPandas(Limiter(step, live_ms), "k string, event_id long, ms long, verdict string", "append", "ProcessingTime")


class Pieces(StatefulProcessor):
    """Pieces of an answer, kept until all up to the closing one are there, or until no piece has come for wait_ms."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "seq long", "piece string")
        self.end = handle.getValueState("end", "seq long")

    def _done(self) -> None:
        self.pieces.clear()
        self.end.clear()
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for seq, piece, last in _ordered(rows, "seq")[["seq", "piece", "last"]].itertuples(index=False):
            if not self.pieces.containsKey((int(seq),)):
                self.pieces.updateValue((int(seq),), (None if piece is None or piece != piece else piece,))
            if last:
                self.end.update((int(seq),))
        end = self.end.get()
        held = {k[0]: v[0] for k, v in self.pieces.iterator()}
        if end and all(i in held for i in range(1, end[0] + 1)):
            self._done()
            yield pd.DataFrame({"answer_id": [key[0]], "text": ["".join(held[i] or "" for i in range(1, end[0] + 1))], "timed_out": [False]})
        else:
            for at in self.handle.listTimers():
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._done()
        yield pd.DataFrame({"answer_id": [key[0]], "text": pd.Series([None], dtype=object), "timed_out": [True]})

    def close(self) -> None:
        pass


def token_stream(pieces: DataFrame, wait_ms: int = 25_000) -> DataFrame:
    """(answer_id, text, timed_out) of a stream of pieces (answer_id, seq from 1, piece, last) in any order.

    A piece that comes again is ignored, a null piece is empty. An answer that isn't whole wait_ms after its last piece has a null
    text and is done with; pieces that come later start it anew.
    """
    rows = pieces.select(F.col("answer_id").cast("long").alias("answer_id"), F.col("seq").cast("long").alias("seq"), "piece", F.coalesce("last", F.lit(False)).alias("last")).filter("seq >= 1")
    return rows.groupBy("answer_id").transformWithStateInPandas(Pieces(wait_ms), "answer_id long, text string, timed_out boolean", "append", "ProcessingTime")


class Newest(StatefulProcessor):
    """The number of a key's latest request."""

    def __init__(self, live_ms: int):
        self.live_ms = live_ms

    def init(self, handle) -> None:
        self.latest = handle.getValueState("latest", "no long", self.live_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = (self.latest.get() or (None,))[0]
        out = []
        for no, answer, text in _ordered(rows, "at", "is_answer", "no")[["no", "is_answer", "text"]].itertuples(index=False):
            if not answer:
                latest = int(no)
            elif latest == no:
                out.append((key[0], int(no), text))
        if latest is not None:
            self.latest.update((latest,))
        yield pd.DataFrame(out, columns=["k", "no", "text"])

    def close(self) -> None:
        pass


def answers_in_time(turns: DataFrame, live_ms: int = WEEK) -> DataFrame:
    """(k, no, text): the answers that arrive while theirs is the latest request of the key; late ones go.

    turns: requests and answers (k, no, at, is_answer, text) of one stream; of one time requests come first.
    """
    rows = turns.select(F.coalesce(F.col("k").cast("string"), F.lit("")).alias("k"), F.col("no").cast("long").alias("no"), F.col("at").cast("long").alias("at"), "is_answer", "text")
    return rows.groupBy("k").transformWithStateInPandas(Newest(live_ms), "k string, no long, text string", "append", "ProcessingTime")


class Visitors(StatefulProcessor):
    """Views and visitors of a site's day; no more than `most` visitors are held, and none once the day is over."""

    def __init__(self, most: int | None):
        self.most = most

    def init(self, handle) -> None:
        self.handle = handle
        self.pv = handle.getValueState("pv", "n long")
        self.seen = handle.getValueState("seen", "v array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pv, seen = (self.pv.get() or (0,))[0], dict.fromkeys((self.seen.get() or ((),))[0])
        for part in rows:
            pv += int(part.pv.sum())
            for ids in part.visitors:
                for v in ids:
                    if len(seen) == self.most:
                        break
                    seen[v] = None
        self.pv.update((pv,))
        self.seen.update((list(seen),))
        self.handle.registerTimer(int(pd.Timestamp(key[0]).value // 1_000_000) + 86_400_000)
        yield pd.DataFrame({"day": [key[0]], "site": [key[1]], "pv": [pv], "uv": [len(seen)], "closed": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = pd.DataFrame({"day": [key[0]], "site": [key[1]], "pv": [self.pv.get()[0]], "uv": [len(self.seen.get()[0])], "closed": [True]})
        self.pv.clear()
        self.seen.clear()
        yield out

    def close(self) -> None:
        pass


def visitor_stream(views: DataFrame, late: str = "1 day", limits: Limits = Limits(), parts: int = 1) -> DataFrame:
    """(day, site, pv, uv, closed) after each batch and, once the watermark has passed the day, for the last time.

    views: a stream of (site, visitor, ts). Views are added up by task before they meet, so a site that has most of them moves few
    rows; a null visitor is none. Rows of a day that is closed are dropped, and late_rows counts them (as they were added up).
    parts: visitors are dealt to so many keys, each with a row of its own that has its share of pv and uv (limits.uv_most must be
    None), so that a day of many visitors is not one state. The rows of a day that is closed come in one batch.
    """
    if parts > 1 and limits.uv_most is not None:
        raise ValueError("a limit of visitors needs all of them in one part")
    keys = ["day", "site", "part"] if parts > 1 else ["day", "site"]
    most = limits.uv_most

    def added(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            groups = part.groupby(["day", "site", "part"], dropna=False)
            yield pd.DataFrame([(*k, len(g), list(g.visitor.dropna().unique()[:most]), g["at"].max()) for k, g in groups], columns=["day", "site", "part", "pv", "visitors", "at"])

    ms = millis(views)
    rows = views.select(local_day(ms).alias("day"), F.coalesce("site", F.lit("")).alias("site"), F.col("visitor").cast("string").alias("visitor"), F.pmod(F.xxhash64("visitor"), F.lit(parts)).alias("part"), F.timestamp_millis(ms + 28_800_000).alias("at")).filter("at IS NOT NULL")
    few = rows.mapInPandas(added, "day date, site string, part long, pv long, visitors array<string>, at timestamp").withWatermark("at", late)
    return few.groupBy(*keys).transformWithStateInPandas(Visitors(most), "day date, site string, pv long, uv long, closed boolean", "append", "EventTime")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a run dropped as late."""
    return sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])
