"""Visits: daily counters, reports, limits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Limits
from ..functions.text import bare, clean_path
from ..functions.times import local_day, millis


def visits(events: DataFrame) -> DataFrame:
    """Events as page views: local day (UTC+8), site, path, hashed visitor."""
    return events.select(
        "event_id", "user_id", "ts", local_day(millis(events)).alias("day"), F.col("event_type").alias("site"),
        F.concat(F.lit("/"), F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))).alias("path"), F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 16).alias("visitor"),
    )


def admitted(requests: DataFrame, sites: Sequence[str]) -> DataFrame:
    """requests (site, path, vid) of a known site whose visitor id has 8 characters or more; fields cleaned, ids cut to 80."""
    rows = requests.withColumns({"site": F.lower(bare(F.col("site"))), "path": clean_path(F.col("path")), "vid": F.substring(bare(F.col("vid")), 1, 80)})
    return rows.filter(F.col("site").isin(*sites) & (F.length("vid") >= 8))


def daily(views: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(day, site, pv, uv); uv counts up to limits.uv_most, or all if that is None."""
    uv = F.countDistinct("visitor")
    return views.groupBy("day", "site").agg(F.count("*").alias("pv"), (uv if limits.uv_most is None else F.least(uv, F.lit(limits.uv_most))).alias("uv"))


def by_site(counts: DataFrame, days: DataFrame) -> DataFrame:
    """One row for each day of days (day): pv and uv of each of SITES from counts (day, site, pv, uv), 0 where there are none."""
    got = days.select("day").distinct().join(counts, "day", "left").groupBy("day")
    return got.agg(*(F.coalesce(F.max(F.when(F.col("site") == s, F.col(m))), F.lit(0)).alias(f"{s}_{m}") for s in SITES for m in ("pv", "uv")))


#: Sites, and the lines of the daily report; the last site is left out of the total, and shown only if visited.
SITES = ("cn", "overseas", "local")
REPORT = ("【图谱访问日报】", "日期：%s", "", "合计（不含本地）：UV %d · PV %d", "国内站：UV %d · PV %d", "海外站：UV %d · PV %d", "本地调试：UV %d · PV %d", "", "说明：UV≈独立访客（匿名 ID），PV=页面打开次数")


def report_text(rows: DataFrame) -> DataFrame:
    """(day, text) of rows as by_site gives them."""
    cn, far, near = ([F.col(f"{s}_uv"), F.col(f"{s}_pv")] for s in SITES)
    values = {1: [F.col("day").cast("string")], 3: [cn[0] + far[0], cn[1] + far[1]], 4: cn, 5: far, 6: near}
    lines = [F.format_string(line, *values[i]) if i in values else F.lit(line) for i, line in enumerate(REPORT)]
    lines[6] = F.when(near[1] > 0, lines[6])
    return rows.select("day", F.concat_ws("\n", *lines).alias("text"))


def unsent(reports: DataFrame, sent: DataFrame, force: bool = False) -> DataFrame:
    """Reports (day, text) of days that are not among those sent (day), or all if forced: a daily run repeats nothing."""
    return reports if force else reports.join(sent.select("day").distinct(), "day", "left_anti")


def last_path(views: DataFrame) -> DataFrame:
    return views.groupBy("day", "site").agg(F.max_by("path", F.struct("ts", "event_id")).alias("path"))


def changed_paths(views: DataFrame) -> DataFrame:
    """Views whose path differs from the visitor's one before."""
    before = F.lag("path").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return views.withColumn("before", before).filter("before IS NULL OR before <> path").drop("before")


def daily_verdict(limits: Limits) -> Column:
    """What becomes of a request (user_id, in_day, in_window)."""
    return F.when(F.col("user_id").isNull(), "missing_user").when(F.col("in_day") > limits.per_day, "daily_limit").when(F.col("in_window") > limits.per_minute, "minute_limit").otherwise("ok")


def sliding(requests: DataFrame, limits: Limits = Limits(), across_days: bool = False) -> DataFrame:
    """Requests (user_id, event_id, ts) with counts of the local day (UTC+8) and of the window up to them, and whether they pass.

    Denied requests count. A window ends with its day, or goes on across_days: a request that the next day's windows can reach
    is then put to that day too. So counts and windows share one partitioning, by user and day, and no user's whole history is
    one partition. Requests without a user are refused and count for nothing.
    """
    ms = requests.withColumn("ms", millis(requests))
    # a null user has nothing to count: its rows are dealt by event instead of meeting in one partition
    rows = ms.withColumns({"day": local_day(F.col("ms")), "_u": F.when(F.col("user_id").isNull(), F.col("event_id"))})
    reached = local_day(F.col("ms") + (limits.window_ms - 1)) if across_days else F.col("day")
    rows = rows.select("*", F.posexplode(F.coalesce(F.sequence("day", reached), F.array("day"))).alias("_later", "_on")).drop("day").withColumnRenamed("_on", "day")
    mine = Window.partitionBy("user_id", "_u", "day").orderBy("ms")
    # those of days before are earlier than all of the day
    today = F.count_if(F.col("_later") == 0).over(Window.partitionBy("user_id", "_u", "day").orderBy("ms", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    near = F.count("*").over(mine.rangeBetween(-(limits.window_ms - 1), 0))
    known = lambda n: F.when(F.col("user_id").isNull(), F.lit(0).cast("long")).otherwise(n)
    return rows.withColumn("in_day", known(today)).withColumn("in_window", known(near)).filter("_later = 0").drop("_u", "_later").withColumn("verdict", daily_verdict(limits))


def anchored(requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Fixed windows that start at a user's first request and, once over, at the next one. Denials count."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, start, count = object(), 0, 0
        for pdf in parts:
            hits, passed = [], []
            for u, ms in zip(pdf.user_id, pdf.ms):
                if u != user or ms - start >= limits.window_ms:
                    user, start, count = u, ms, 0
                count += 1
                hits.append(count)
                passed.append(count <= limits.anchored_most)
            yield pdf.assign(hit=hits, passed=passed)

    rows = requests.select("user_id", "event_id", millis(requests).alias("ms"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "ms", "event_id").mapInPandas(run, "user_id long, event_id long, ms long, hit long, passed boolean")
