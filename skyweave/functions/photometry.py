"""Magnitudes, signal to noise and errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import col, wrap360

GAMMA = 0.039  # fixed value of the error model


def astrometric_error(mag, m5, seeing, systematic: float = 0.1) -> Column:
    """Arc seconds: systematic floor and photon noise in quadrature."""
    x = F.pow(F.lit(10.0), 0.4 * (col(mag) - col(m5)))
    noise = col(seeing) * F.sqrt((0.04 - GAMMA) * x + GAMMA * x * x)
    return F.sqrt(F.lit(systematic * systematic) + noise * noise)


def snr(mag, m5) -> Column:
    return 5.0 * F.pow(F.lit(10.0), 0.4 * (col(m5) - col(mag)))


def magnitude_error(snr_value) -> Column:
    return 2.5 / F.log(F.lit(10.0)) / col(snr_value)


def with_noise(df, error_arcsec: str, seed: int, ra: str = "ra", dec: str = "dec"):
    """Positions with normal noise of the given size on both axes."""
    e = F.col(error_arcsec) / 3600
    return df.withColumn(ra, wrap360(F.col(ra) + F.randn(seed) * e)).withColumn(dec, F.col(dec) + F.randn(seed + 1) * e)


def coloured(df, colour: dict[str, float], band: str = "band", mag: str = "mag", m5: str = "m5", seeing: str = "seeing", min_snr: float = 5.0):
    """Magnitudes in the band of observation from a reference magnitude and colour terms; rows below ``min_snr`` go;
    astrometric and photometric errors are attached."""
    term = F.lit(None).cast("double")
    for name, value in colour.items():
        term = F.when(F.col(band) == name, F.lit(float(value))).otherwise(term)
    out = df.withColumn(mag, F.col(mag) + term).withColumn("snr", snr(mag, m5)).where(F.col("snr") >= min_snr)
    return out.withColumn("astrom_err", astrometric_error(mag, m5, seeing)).withColumn("mag_err", magnitude_error("snr"))
