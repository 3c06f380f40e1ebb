"""Checkpoints, join hints behind a size check, and ids."""

from __future__ import annotations

import tempfile
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.config import BadParameter

#: A table is broadcast only up to so many rows.
BROADCAST_ROWS = 100_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's ``spark.checkpoint.dir``; where none is named a temporary folder if Spark runs in this very process
    (tests), else an error, as executors would not share it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise BadParameter("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skyweave-ckpt-"))


def checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, whose rows must be of fixed width, with a join hint: broadcast up to ``limit`` rows, else merge. Counts at
    most limit + 1 rows, on the executors."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df.hint("merge")


def assign_ids(df: DataFrame, order: list[str], name: str = "id", start: int = 0) -> DataFrame:
    """Consecutive numbers in the order of ``order``, without a global window: ranges are numbered apart and shifted
    by the counts of the ranges before them, which are joined by range."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__ids_at", F.monotonically_increasing_id())
    ranged = checkpoint(ranged.withColumn("__ids_part", F.shiftright("__ids_at", 33).cast("int")).withColumn("__ids_row", F.col("__ids_at").bitwiseAND((1 << 33) - 1)).drop("__ids_at"))
    # one row for each range
    counts = sorted((r["__ids_part"], r["n"]) for r in ranged.groupBy("__ids_part").agg(F.count("*").alias("n")).collect())
    before = list(zip([part for part, _ in counts], accumulate((n for _, n in counts[:-1]), initial=start), strict=bool(counts)))
    offsets = df.sparkSession.createDataFrame(before, "__ids_part int, __ids_before long")
    return ranged.join(F.broadcast(offsets), "__ids_part").withColumn(name, F.col("__ids_before") + F.col("__ids_row")).drop("__ids_part", "__ids_row", "__ids_before")


def every_nth(df: DataFrame, order: list[str], n: int, start: int = 0) -> DataFrame:
    return assign_ids(df, order, "__id").where((F.col("__id") - start) % n == 0).drop("__id")


def dense_ids(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """key -> 0-based number by first appearance in the order of ``order``."""
    first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("__first"))
    return assign_ids(first, ["__first", key], name).drop("__first")
