"""Detections derived from an event stream: each user is an object on a curved path, errors are noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Microseconds of 2024-01-01, and the MJD that the first night has (fixed values of the derivation).
ORIGIN, FIRST_MJD = 1704067200000000, 60310.0


def detections_from_events(events: DataFrame) -> DataFrame:
    """det_id, image_id, mjd, ssm_id (-1: noise), ra, dec, mag, path_id (the user, noise too). 24 images of 20 minutes a night."""
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(ORIGIN)
    rows = events.select("event_id", "user_id", "event_type", "value", us.alias("us")).withColumn("img", F.expr("us div 3600000000"))
    rows = rows.withColumn("t", F.expr("img div 24 + (img % 24) / 72e0")).withColumn("noise", F.expr("case when event_type = 'error' then ((event_id * 47) % 101 - 50) / 1000e0 else 0e0 end"))
    return rows.selectExpr(
        "event_id as det_id", "img as image_id", f"{FIRST_MJD!r}D + t as mjd", "case when event_type = 'error' then -1L else user_id end as ssm_id",
        "pmod(user_id * 137e0 + (user_id % 13 - 6) * .03e0 * t + (user_id % 5 - 2) * .001e0 * t * t + noise, 360e0) as ra",
        "pmod(user_id * 73e0, 60e0) - 30e0 + (user_id % 7 - 3) * .03e0 * t - noise / 2e0 as dec", "20e0 + value / 100e0 as mag", "user_id as path_id",
    )


def read_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return detections_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
