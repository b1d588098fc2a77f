"""Daily reports that are sent once: a run that is repeated, or that broke off, sends nothing twice and nothing less.

A report and the mark that it was sent are one row, published with a rename of the folder that holds it. What a run wrote before
it broke off lies aside and is not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Limits
from ..operators import traffic
from ..sources import shared
from . import stateful

SENT = "day date, text string, sent_at timestamp"


def sent(spark: SparkSession, path: str) -> DataFrame:
    """(day, text, sent_at) of all that was sent; a day that was forced is there again."""
    runs = shared.names(spark, f"{path}/sent")
    return spark.read.schema(SENT).parquet(*(f"{path}/sent/{r}" for r in runs)) if runs else spark.createDataFrame([], SENT)


def written(reports: DataFrame, path: str, force: bool = False) -> str:
    """Write the reports (day, text) that are due aside; the folder that publish makes public."""
    spark = reports.sparkSession
    due = traffic.unsent(reports, sent(spark, path), force)
    made = shared.place(spark, "run").rsplit("/", 1)[1]
    due.select("day", "text", F.current_timestamp().alias("sent_at")).write.parquet(f"{path}/made/{made}")
    return made


def publish(spark: SparkSession, path: str, made: str) -> None:
    shared.folders(spark, f"{path}/sent")
    if not shared.rename(spark, f"{path}/made/{made}", f"{path}/sent/{made}"):
        raise RuntimeError(f"{made} was published before")


def deliver(reports: DataFrame, path: str, force: bool = False) -> None:
    """Send the reports (day, text) of days that were not sent, or all of them if forced."""
    publish(reports.sparkSession, path, written(reports, path, force))


#: Keys that the visitors of a site's day are dealt to.
PARTS = 16


def daily_run(views: DataFrame, path: str, late: str = "1 day", force: bool = False) -> None:
    """Send the reports of the days that a stream of views (site, visitor, ts) has closed since the last run; all visitors count."""

    def one(batch: DataFrame, number: int) -> None:
        closed = batch.filter("closed").groupBy("day", "site").agg(F.sum("pv").alias("pv"), F.sum("uv").alias("uv")).persist()
        if not closed.isEmpty():
            deliver(traffic.report_text(traffic.by_site(closed, closed)), path, force)
        closed.unpersist()

    stateful.drive(stateful.visitor_stream(views, late, Limits(uv_most=None), PARTS).writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/checkpoint"), timers=True)
