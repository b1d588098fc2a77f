"""Page views as a stream, and daily counters over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Limits
from ..operators.traffic import admitted

VIEW = "type string, site string, path string, vid string, t long"


def page_views(spark: SparkSession, folder: str, sites: Sequence[str], rows: int = 1000) -> DataFrame:
    """Admitted page views (site, path, vid, ts) of JSON lines that arrive as files in a folder, `rows` files a batch at most.

    ts is when a file was written: the time that the sender states is not trusted. Lines that aren't JSON, and other types, go.
    """
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", rows).load(folder)
    body = lines.select(F.from_json("value", VIEW).alias("b"), F.col("_metadata.file_modification_time").alias("ts")).select("b.*", "ts")
    return admitted(body.filter(F.col("type") == "pageview"), sites).select("site", "path", "vid", "ts")


def daily_views(events: DataFrame, late: str = "1 day", limits: Limits = Limits()) -> DataFrame:
    """(day, site, pv, uv) of page views by local day (UTC+8) and site; events later than the watermark are left out.

    uv is exact up to limits.uv_most, as in the batch form: the state of a day and site holds its visitors. For sites of many
    visitors use approximate_daily_views, whose state is a sketch of bounded size.
    """
    return _daily(events, late, F.least(F.size(F.collect_set("user_id")), F.lit(limits.uv_most)).cast("long"))


def approximate_daily_views(events: DataFrame, late: str = "1 day") -> DataFrame:
    return _daily(events, late, F.approx_count_distinct("user_id"))


def _daily(events: DataFrame, late: str, uv) -> DataFrame:
    shifted = events.withColumn("at", (F.col("ts") + F.expr("INTERVAL 8 HOURS")).cast("timestamp")).withWatermark("at", late)
    return shifted.groupBy(F.window("at", "1 day").alias("w"), F.col("event_type").alias("site")).agg(F.count("*").alias("pv"), uv.alias("uv")).select(F.to_date("w.start").alias("day"), "site", "pv", "uv")
