"""Request limiters with state: each is a fold over a key's requests in time order.

The batch form sorts within partitions by key and time, so a key's history streams through and only its state is held. The
same step functions drive the streaming form in streaming/limits.py.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: state, time in ms, ok flag -> state, verdict. An empty tuple is the state of a new key.
Step = Callable[[tuple, int, bool], tuple[tuple, str]]

DAY = 86_400_000


def two_windows(minute: int = 10, day: int = 60, minute_ms: int = 60_000) -> Step:
    """Fixed windows of a minute and a day from a key's first request; one is over after its end. Denied requests don't count."""

    def step(state: tuple, now: int, ok: bool) -> tuple[tuple, str]:
        m_count, m_end, d_count, d_end = state or (0, now + minute_ms, 0, now + DAY)
        if now > m_end:
            m_count, m_end = 0, now + minute_ms
        if now > d_end:
            d_count, d_end = 0, now + DAY
        verdict = "minute_limit" if m_count >= minute else "day_limit" if d_count >= day else "ok"
        more = int(verdict == "ok")
        return (m_count + more, m_end, d_count + more, d_end), verdict

    return step


def least_interval(ms: int = 60_000) -> Step:
    """At least ms between requests that pass; denied ones don't extend it."""

    def step(state: tuple, now: int, ok: bool) -> tuple[tuple, str]:
        if state and now - state[0] < ms:
            return state, "too_soon"
        return (now,), "ok"

    return step


def breaker(failures: int = 5, open_ms: int = 60_000) -> Step:
    """Opens after consecutive failures and denies all; when that is over one probe passes, and success closes it."""

    def step(state: tuple, now: int, ok: bool) -> tuple[tuple, str]:
        bad, until = state or (0, 0)
        if now < until:
            return (bad, until), "open"
        verdict = "probe" if until else "ok"
        if ok:
            return (0, 0), verdict
        bad += 1
        return (bad, now + open_ms if bad >= failures else 0), verdict

    return step


def limited(requests: DataFrame, step: Step, key: str = "user_id") -> DataFrame:
    """(key, event_id, ms, verdict) of requests (key, event_id, ms and, if there, ok). Null keys are one key; ties go by event_id."""
    ok = F.coalesce("ok", F.lit(True)) if "ok" in requests.columns else F.lit(True)
    rows = requests.select(F.col(key).cast("string").alias("k"), F.col("event_id").cast("long").alias("event_id"), F.col("ms").cast("long").alias("ms"), ok.alias("ok")).filter("ms IS NOT NULL")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), ()
        for part in parts:
            found = []
            for k, ms, fine in zip(part.k, part.ms, part.ok):
                if k != at:
                    at, state = k, ()
                state, verdict = step(state, int(ms), bool(fine))
                found.append(verdict)
            yield part[["k", "event_id", "ms"]].assign(verdict=found)

    out = rows.repartition("k").sortWithinPartitions("k", "ms", "event_id").mapInPandas(run, "k string, event_id long, ms long, verdict string")
    return out.withColumnRenamed("k", key)


def gauged(requests: DataFrame, most: int = 8, key: str = "instance") -> DataFrame:
    """(key, event_id, ms, running, verdict) of requests (key, event_id, ms, until): at most `most` run at a time.

    An ordered sweep of starts and ends: a request that is admitted runs until its end and counts till then, one that is denied
    never does. At one time ends come before starts, and starts go by event_id. running: how many run before the request. A key's
    history streams through; its state is the ends of what runs. Null keys are one key, rows without a time are left out, a
    request without an end runs on.
    """
    rows = requests.select(F.col(key).cast("string").alias("k"), F.col("event_id").cast("long").alias("event_id"), F.col("ms").cast("long").alias("ms"), F.coalesce(F.col("until").cast("double"), F.lit(float("inf"))).alias("until")).filter("ms IS NOT NULL")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ends = object(), []
        for part in parts:
            running, verdicts = [], []
            for k, ms, until in zip(part.k, part.ms, part.until):
                if k != at:
                    at, ends = k, []
                while ends and ends[0] <= ms:
                    heapq.heappop(ends)
                running.append(len(ends))
                verdicts.append("ok" if len(ends) < most else "busy")
                if len(ends) < most:
                    heapq.heappush(ends, until)
            yield part[["k", "event_id", "ms"]].assign(running=running, verdict=verdicts)

    out = rows.repartition("k").sortWithinPartitions("k", "ms", "event_id").mapInPandas(run, "k string, event_id long, ms long, running long, verdict string")
    return out.withColumnRenamed("k", key)


def chained(calls: DataFrame, steps: Mapping[str, Step], key: str = "instance") -> DataFrame:
    """(key, event_id, ms, provider, attempts, retry_at) of calls (key, event_id, ms, ok: a map from provider to whether it would answer).

    Providers are tried in order until one answers. Each has a breaker (its step) that remembers earlier calls: one that is open is
    passed over. provider is null if none answers; retry_at is then the earliest time at which one that is open lets a probe
    through, null if none is open. Null keys are one key, rows without a time are left out, a provider without a value fails.
    """
    names = list(steps)
    rows = calls.select(F.col(key).cast("string").alias("k"), F.col("event_id").cast("long").alias("event_id"), F.col("ms").cast("long").alias("ms"), *(F.coalesce(F.col("ok")[n], F.lit(False)).alias(f"ok{i}") for i, n in enumerate(names))).filter("ms IS NOT NULL")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, states = object(), {}
        for part in parts:
            found = []
            for k, event, ms, *fine in part.itertuples(index=False):
                if k != at:
                    at, states = k, dict.fromkeys(names, ())
                tried, answered = [], None
                for name, ok in zip(names, fine):
                    states[name], verdict = steps[name](states[name], int(ms), bool(ok))
                    if verdict != "open":
                        tried.append(name)
                        if ok:
                            answered = name
                            break
                waits = [s[1] for s in states.values() if s and s[1] > ms]
                found.append((k, event, ms, answered, tried, min(waits) if waits and answered is None else None))
            out = pd.DataFrame(found, columns=["k", "event_id", "ms", "provider", "attempts", "retry_at"])
            yield out.astype({"retry_at": "Int64"})

    out = rows.repartition("k").sortWithinPartitions("k", "ms", "event_id").mapInPandas(run, "k string, event_id long, ms long, provider string, attempts array<string>, retry_at long")
    return out.withColumnRenamed("k", key)
