"""Catalogues in tables: Parquet folders by night, or a database through JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.config import BadParameter


def read_nights(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """A folder that is partitioned by night; the range is a partition filter, so other nights are not listed."""
    df = spark.read.parquet(path)
    if "night" not in df.columns:
        raise BadParameter(f"{path} is not partitioned by night")
    if first is not None:
        df = df.where(F.col("night") >= first)
    return df if last is None else df.where(F.col("night") <= last)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 64, **options: str) -> DataFrame:
    """A database table in ``parts`` ranges of a numeric key, read side by side; filters and columns are pushed down."""
    if parts < 1 or low > high:
        raise BadParameter("parts >= 1 and low <= high are needed")
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()


def write_table(df: DataFrame, name: str, key: str, buckets: int = 64) -> None:
    """A bucketed and sorted table: later joins on the key do not shuffle it."""
    df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)
