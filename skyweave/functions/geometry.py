"""Angles and distances on the sphere as Column expressions (degrees unless said otherwise)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyweave.config import BadParameter

ColumnLike = "Column | str | float"
EPSILON = 1e-10


def col(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def wrap360(x) -> Column:
    """Angle in [0, 360)."""
    return F.pmod(col(x), F.lit(360.0))


def circular_distance(a, b, period: float = 360.0) -> Column:
    """Shorter arc between two angles."""
    d = F.pmod(col(a) - col(b), F.lit(period))
    return F.least(d, F.lit(period) - d)


def circular_distance_rad(a, b) -> Column:
    return circular_distance(a, b, 2 * math.pi)


def signed_distance(a, b) -> Column:
    """a - b along the shorter arc, in [-180, 180)."""
    return F.pmod(col(a) - col(b) + 180.0, F.lit(360.0)) - 180.0


def haversine(ra1, dec1, ra2, dec2) -> Column:
    """Great-circle distance."""
    s_dec = F.sin(F.radians(col(dec2) - col(dec1)) / 2)
    s_ra = F.sin(F.radians(col(ra2) - col(ra1)) / 2)
    h = s_dec * s_dec + F.cos(F.radians(col(dec1))) * F.cos(F.radians(col(dec2))) * s_ra * s_ra
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), h))))


def arc_to_ra(dec, arc) -> Column:
    """Difference in RA that an arc spans along the parallel at ``dec``; 180 if the arc reaches round the pole."""
    inside = F.abs(F.sin(F.radians(col(arc)) / 2) / F.cos(F.radians(col(dec))))
    return F.when(inside >= 1.0, F.lit(180.0)).otherwise(2 * F.degrees(F.asin(inside)))


def euclidean(a: list, b: list) -> Column:
    if len(a) != len(b) or not a:
        raise BadParameter("points need the same number of dimensions, one at least")
    total = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        total = total + (col(x) - col(y)) * (col(x) - col(y))
    return F.sqrt(total)


def array_distance(a: str, b: str) -> Column:
    """Euclidean distance of two array columns."""
    return F.sqrt(F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0).cast("double"), lambda s, v: s + v))


#: geometry of a dimension -> distance; spherical ones need two dimensions at once and are refused here.
GEOMETRIES = ("euclidean", "circular_degrees", "circular_radians")


def distance_1d(a, b, geometry: str) -> Column:
    if geometry == "euclidean":
        return F.abs(col(a) - col(b))
    if geometry == "circular_degrees":
        return circular_distance(a, b)
    if geometry == "circular_radians":
        return circular_distance_rad(a, b)
    raise BadParameter(f"no distance in one dimension for geometry {geometry}")


def are_equal(a, b) -> Column:
    return F.abs(col(a) - col(b)) < EPSILON


def min_of_two(a, b) -> Column:
    return F.least(col(a), col(b))


def max_of_two(a, b) -> Column:
    return F.greatest(col(a), col(b))


def arc_contains(a, b, x) -> Column:
    """Whether x lies on the shorter arc from a to b (ends included); a span of 180 degrees holds everything."""
    span = circular_distance(a, b)
    return are_equal(span, 180.0) | are_equal(circular_distance(a, x) + circular_distance(x, b), span)


def intervals_overlap(a_low, a_high, b_low, b_high, circular: bool = False) -> Column:
    """Whether [a_low, a_high] and [b_low, b_high] meet; circular ones run upwards and may pass 360."""
    if not circular:
        return (col(a_low) <= col(b_high)) & (col(b_low) <= col(a_high))
    width_a, width_b = F.pmod(col(a_high) - col(a_low), F.lit(360.0)), F.pmod(col(b_high) - col(b_low), F.lit(360.0))
    return (F.pmod(col(b_low) - col(a_low), F.lit(360.0)) <= width_a) | (F.pmod(col(a_low) - col(b_low), F.lit(360.0)) <= width_b)


def arcs_overlap(a1, a2, b1, b2) -> Column:
    """Whether the shorter arcs a1-a2 and b1-b2 meet; a span of 180 degrees meets all."""
    return arc_contains(a1, a2, b1) | arc_contains(a1, a2, b2) | arc_contains(b1, b2, a1) | arc_contains(b1, b2, a2)


def to_cartesian(ra, dec) -> tuple[Column, Column, Column]:
    r, d = F.radians(col(ra)), F.radians(col(dec))
    return F.cos(d) * F.cos(r), F.cos(d) * F.sin(r), F.sin(d)


def to_sky(x, y, z) -> tuple[Column, Column]:
    """(ra, dec) of a vector of any length."""
    return wrap360(F.degrees(F.atan2(col(y), col(x)))), F.degrees(F.atan2(col(z), F.sqrt(col(x) * col(x) + col(y) * col(y))))


def rotation(from_ra: float, from_dec: float, to_ra: float, to_dec: float) -> list[list[float]]:
    """Matrix that carries one point of the sphere to another: back to the equator at RA 0, then out again."""
    def turn(ra: float, dec: float) -> list[list[float]]:
        r, d = math.radians(ra), math.radians(dec)
        return [[math.cos(d) * math.cos(r), -math.sin(r), -math.sin(d) * math.cos(r)], [math.cos(d) * math.sin(r), math.cos(r), -math.sin(d) * math.sin(r)], [math.sin(d), 0.0, math.cos(d)]]

    a, b = turn(from_ra, from_dec), turn(to_ra, to_dec)
    return [[sum(b[i][k] * a[j][k] for k in range(3)) for j in range(3)] for i in range(3)]


def rotate(ra, dec, matrix: list[list[float]]) -> tuple[Column, Column]:
    """(ra, dec) after a rotation: nine literals in one expression."""
    v = to_cartesian(ra, dec)
    return to_sky(*[sum((F.lit(row[k]) * v[k] for k in range(1, 3)), F.lit(row[0]) * v[0]) for row in matrix])


def contiguous(x, first) -> Column:
    """Angle unwrapped to within half a turn of ``first``."""
    return col(first) + signed_distance(x, first)


def recentre(x, centre: float) -> Column:
    """Angle unwrapped to within half a turn of a centre; applied to every row."""
    return F.lit(centre) + signed_distance(x, centre)


def negative_above_180(x, low, high) -> Column:
    """Angle moved below zero if its group (low to high) spans more than half a turn."""
    return F.when((col(high) - col(low) > 180.0) & (col(x) > 180.0), col(x) - 360.0).otherwise(col(x))
