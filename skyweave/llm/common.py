"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition ``[^\x20\x09-\x0D]+``.
SPACE = b" \t\n\x0b\f\r"
#: A word-hash cache of one Python worker stops growing here (about 30 MB).
CACHE_WORDS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's ``spark.checkpoint.dir``; where none is named a temporary folder if Spark runs in this very process
    (tests), else an error, as executors would not share it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skyweave-ckpt-"))


def checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: A table is broadcast only up to so many bytes, which are measured.
BROADCAST_BYTES = 32 << 20


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a checkpointed frame: 16 bytes a row, 8 a value, and the contents of strings and arrays."""
    size = F.lit(16 + 8 * len(df.columns))
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif kind == "array":
            each = F.aggregate(f"`{f.name}`", F.lit(0), lambda n, x: n + 16 + F.coalesce(F.octet_length(x), F.lit(0))) if f.dataType.elementType.typeName() == "string" else F.size(f"`{f.name}`") * 8
            size = size + F.coalesce(each, F.lit(0))
        elif kind not in ("long", "integer", "double", "float", "boolean", "short", "byte", "date", "timestamp"):
            raise ValueError(f"no size known for a column of type {kind}")
    row = df.agg(F.count("*"), F.sum(size.cast("long"))).first()
    return row[0], row[1] or 0


def hinted(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A checkpointed frame with a hint for its join: broadcast up to ``limit`` measured bytes, else merge."""
    return F.broadcast(df) if measured(df)[1] <= limit else df.hint("merge")


#: Rows and bytes of one Arrow batch: whole documents travel in them, so that a Python worker holds a few MB, not tens.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def small_batches(df: DataFrame) -> None:
    """Arrow batches of at most ARROW_ROWS rows and ARROW_BYTES bytes (or one row) for this session."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = df.sparkSession.conf.get(key, None)
        now = int(now) if now and now.lstrip("-").isdigit() else -1
        if now <= 0 or now > most:
            df.sparkSession.conf.set(key, str(most))


def spread(df: DataFrame) -> DataFrame:
    """Dealt out evenly over the session's shuffle partitions, before rows are multiplied."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fields_for(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that clashing extra columns never reach an operator; Arrow batches are kept small."""
    small_batches(df)
    return df.select(*[F.col(f"`{n}`") for n in names])


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def crc_remainder(column: str, mod: int):
    """crc32 of an id written as text, modulo ``mod`` (null ids: remainder of crc32 of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


class WordHashes(dict):
    """word -> 64-bit XXH64; bounded in memory, exact beyond the bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd multiplier of the polynomial window hashes, a fixed value (2**64 divided by the golden ratio).
MULTIPLIER = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), so that all bits of a polynomial hash are usable."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    m = np.uint64(MULTIPLIER)
    for j in range(1, k):
        out *= m
        out += h[j : j + n]
    return mix(out)
