"""Times as milliseconds and local days, the same whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Local time is UTC+8.
OFFSET = 8 * 3_600_000
DAY = 86_400_000


def millis(rows: DataFrame, name: str = "ts") -> Column:
    """Milliseconds since 1970 of a timestamp column; one without a zone is UTC."""
    if dict(rows.dtypes)[name] == "timestamp_ntz":
        ts = F.col(name)
        seconds = F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")
        return F.unix_date(ts.cast("date")).cast("long") * DAY + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + seconds
    return F.unix_millis(F.col(name).cast("timestamp"))


def local_day(ms: Column) -> Column:
    return F.date_from_unix_date(F.floor((ms + OFFSET) / DAY).cast("int"))
