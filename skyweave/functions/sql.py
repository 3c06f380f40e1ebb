"""The scalar functions for SQL users: temporary SQL functions, which Catalyst inlines like any expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (parameters, body)
FUNCTIONS = {
    "wrap360": ("x double", "pmod(x, 360e0)"),
    "circular_distance": ("a double, b double", "least(pmod(a - b, 360e0), 360e0 - pmod(a - b, 360e0))"),
    "signed_distance": ("a double, b double", "pmod(a - b + 180e0, 360e0) - 180e0"),
    "haversine": ("ra1 double, dec1 double, ra2 double, dec2 double", "degrees(2 * asin(sqrt(least(1e0, pow(sin(radians(dec2 - dec1) / 2), 2) + cos(radians(dec1)) * cos(radians(dec2)) * pow(sin(radians(ra2 - ra1) / 2), 2)))))"),
    "arc_to_ra": ("dec double, arc double", "case when abs(sin(radians(arc) / 2) / cos(radians(dec))) >= 1 then 180e0 else 2 * degrees(asin(abs(sin(radians(arc) / 2) / cos(radians(dec))))) end"),
    "night_local": ("mjd double", "cast(floor(mjd + 0.5e0 - 0.166e0) as bigint)"),
    "night_int": ("mjd double", "cast(floor(mjd) as bigint)"),
    "snr": ("mag double, m5 double", "5 * pow(10e0, 0.4e0 * (m5 - mag))"),
    "astrometric_error": ("mag double, m5 double, seeing double", "sqrt(0.01e0 + seeing * seeing * (0.001e0 * pow(10e0, 0.4e0 * (mag - m5)) + 0.039e0 * pow(10e0, 0.8e0 * (mag - m5))))"),
}


def register_functions(spark: SparkSession, prefix: str = "sky_") -> list[str]:
    """Make them known to the session; returns their names."""
    for name, (parameters, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {prefix}{name}({parameters}) returns {'bigint' if name.startswith('night') else 'double'} return {body}")
    return [prefix + n for n in FUNCTIONS]
