"""Times: modified Julian days, nights and calendars."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .geometry import col

#: MJD of 1970-01-01, and TAI - UTC in seconds for the dates of the survey (fixed values).
MJD_EPOCH, TAI_UTC = 40587.0, 35.0
LOCAL_MIDNIGHT = 0.166


def mjd_of(ts: str | Column) -> Column:
    """MJD of a timestamp."""
    return F.unix_micros(col(ts).cast("timestamp")) / F.lit(86400e6) + MJD_EPOCH


def timestamp_of(mjd) -> Column:
    return F.timestamp_micros(F.round((col(mjd) - MJD_EPOCH) * 86400e6).cast("long"))


def tai_to_utc(mjd, seconds: float = TAI_UTC) -> Column:
    return col(mjd) - seconds / 86400


def night_local(mjd, midnight: float = LOCAL_MIDNIGHT) -> Column:
    """Night number that changes at local noon."""
    return F.floor(col(mjd) + 0.5 - midnight).cast("long")


def night_int(mjd) -> Column:
    return F.floor(col(mjd)).cast("long")


def nights_by_gap(df, keys: list[str], mjd: str = "mjd", gap: float = 0.5):
    """keys, n_nights: a new night begins after a gap of more than ``gap`` days between sorted times."""
    w = Window.partitionBy(*keys).orderBy(mjd)
    step = F.when(F.col(mjd) - F.lag(mjd).over(w) > gap, 1).otherwise(0)
    return df.select(*keys, step.alias("__new")).groupBy(*keys).agg((F.sum("__new") + 1).alias("n_nights"))


def nights_in_array(times: str, gap: float = 0.5) -> Column:
    """Number of nights in a sorted array of times (0 if empty)."""
    return F.expr(f"case when size({times}) = 0 then 0 else 1 + size(filter(sequence(0, size({times}) - 1), i -> i > 0 and {times}[i] - {times}[i - 1] > {gap!r})) end")


def calendar(mjd, decimals: int = 5) -> Column:
    """``YYYY MM DD.ddddd``."""
    day = F.format_string(f"%0{3 + decimals}.{decimals}f", F.dayofmonth(timestamp_of(mjd)) + (col(mjd) - F.floor(col(mjd))))
    return F.concat_ws(" ", F.date_format(timestamp_of(mjd), "yyyy MM"), day)
