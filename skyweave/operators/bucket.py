"""Keys that turn range joins into equality joins: bands and cells of the sky, grids of the plane, time buckets.

One side gets the key of where it is, the other the keys of all places near it; the exact predicate stays as the
residual of the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.functions.geometry import col, wrap360


def cells_of_zone(zone: Column, radius: float) -> Column:
    """Number of RA cells in a band of ``radius`` degrees: a cell is at least as wide as any circle of that radius."""
    edge = F.least(F.greatest(F.abs(zone), F.abs(zone + 1)) * radius, F.lit(90.0))
    wide = F.sin(F.radians(F.lit(min(radius, 90.0)))) / F.cos(F.radians(edge))
    cells = F.when((edge + radius >= 90.0) | (wide >= 1.0), F.lit(1.0)).otherwise(F.floor(360.0 / F.degrees(F.asin(F.least(wide, F.lit(1.0))))))
    return F.greatest(F.lit(1), cells.cast("long"))


def sky_key(df: DataFrame, ra: str, dec: str, radius: float) -> DataFrame:
    """With ``__zone`` and ``__cell`` of a position."""
    zone = F.floor(col(dec) / radius)
    return df.withColumn("__zone", zone).withColumn("__cell", F.least(F.floor(wrap360(ra) / 360.0 * cells_of_zone(zone, radius)), cells_of_zone(zone, radius) - 1))


def sky_keys_near(df: DataFrame, ra: str, dec: str, radius: float) -> DataFrame:
    """One row for each ``__zone``, ``__cell`` that a position within ``radius`` degrees can have. Loses nothing:
    great-circle distance is at least the difference in declination, and cells are as wide as circles are."""
    zone = F.floor(col(dec) / radius)
    out = df.withColumn("__zone", F.explode(F.array(zone - 1, zone, zone + 1)))
    n = cells_of_zone(F.col("__zone"), radius)
    here = F.least(F.floor(wrap360(ra) / 360.0 * n), n - 1)
    return out.withColumn("__cell", F.explode(F.array_distinct(F.array(F.pmod(here - 1, n), here, F.pmod(here + 1, n)))))


def sky_keys_within(df: DataFrame, ra: str, dec: str, radius: float, width: float) -> DataFrame:
    """One row for each ``__zone``, ``__cell`` of ``width`` degrees that the circle of ``radius`` degrees about a position
    touches, by its extent on either axis: with wide cells fewer than the nine of ``sky_keys_near``."""
    r = radius * (1 + 1e-9) + 1e-9
    low, high = F.floor((col(dec) - r) / width), F.floor((col(dec) + r) / width)
    out = df.withColumn("__zone", F.explode(F.sequence(low, high)))
    n = cells_of_zone(F.col("__zone"), width)
    share = F.sin(F.radians(F.lit(min(r, 90.0)))) / F.cos(F.radians(col(dec)))
    half = F.when((F.abs(col(dec)) + r >= 90.0) | (share >= 1.0), F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(share, F.lit(1.0)))) * (1 + 1e-9) + 1e-9)
    west, east = F.floor((wrap360(ra) - half) / 360.0 * n), F.floor((wrap360(ra) + half) / 360.0 * n)
    cells = F.when(east - west >= n - 1, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.transform(F.sequence(west, east), lambda x: F.pmod(x, n)))
    return out.withColumn("__cell", F.explode(cells))


def time_key(t, width: float) -> Column:
    return F.floor(col(t) / width).cast("long")


def time_keys_near(t, width: float) -> Column:
    """Buckets that a time within ``width`` can have (to be exploded)."""
    k = time_key(t, width)
    return F.array(k - 1, k, k + 1)


def grid_key(x, size: float) -> Column:
    return F.floor(col(x) / size).cast("long")


def circular_grid(x, tolerance: float, period: float = 360.0) -> tuple[Column, Column]:
    """(key, keys near) of an angle for a tolerance."""
    n = max(1, int(period // max(tolerance, period / 1_000_000)))
    here = F.least(F.floor(F.pmod(col(x), F.lit(period)) / period * n), F.lit(n - 1)).cast("long")
    return here, F.array_distinct(F.array(F.pmod(here - 1, F.lit(n)), here, F.pmod(here + 1, F.lit(n))))


def linear_grid(x, tolerance: float) -> tuple[Column, Column]:
    """(key, keys near) of a number for a tolerance."""
    here = grid_key(x, max(tolerance, 1e-9))
    return here, F.array(here - 1, here, here + 1)
