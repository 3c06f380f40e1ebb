"""SimHash near-dedup with deletion-variant signatures.

Two 64-bit fingerprints at distance 2 or less, cut into two 32-bit segments, agree in one segment up to one bit.
Every distinct fingerprint is indexed under its 64 one-wildcard segment variants (segment, bit left out, rest),
and rows meet by equality of that key alone. A key with two fingerprints is verified at once. A key with more is
not expanded into pairs: its fingerprints are also indexed under their 65 values at distance 0 or 1, and two
fingerprints are within distance 2 exactly if they share such a value, so each of those groups is linked to its
smallest member. Work and shuffle stay in proportion to the number of distinct fingerprints (at most 129 rows
each), whatever the size of a group of copies. Classes come from alternating large-star / small-star rounds.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; repeated rows stay; an
empty table gives an empty result; a null doc_id keeps its row and takes part without naming a class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.operators.graph import connected_components

from .common import checkpoint, fields_for, hinted, spread, utf8
from .jaccard import SMALL_GRAPH, near_duplicates

SHINGLE, RADIUS = 3, 2


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles (XXH64, seed 42) of a text, A-Z lower-cased."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest = xxhash.xxh64_intdigest
    parts = map(b" ".join, zip(*[words[j:] for j in range(shingle)], strict=False))
    n = len(words) - shingle + 1
    h = np.fromiter((digest(p, 42) for p in parts), np.uint64, n)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # bounded memory for very long texts
        bits = np.unpackbits(h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return fields_for(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """fp, key: segment number and left-out bit in the upper bits, the rest of the segment in the lower 32."""
    half = lambda s: f"(shiftrightunsigned(fp, {32 * s}) & 4294967295)"
    keys = [f"transform(sequence(0, 31), i -> shiftleft(cast({32 * s} + i as bigint), 32) | ({half(s)} & ~shiftleft(1L, i)))" for s in (0, 1)]
    return fps.select("fp", F.explode(F.expr(f"concat({keys[0]}, {keys[1]})")).alias("key"))


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints, enough to connect all that are within distance 2."""
    variants = _variants(spread(fps))
    groups = (
        variants.repartition("key").groupBy("key")
        .agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
        .where("n > 1").select("key", "n", "u", "v")
    )
    groups = checkpoint(groups)
    near = groups.where("n = 2 and bit_count(u ^ v) <= 2").select("u", "v")
    crowded = variants.join(groups.where("n > 2").select("key").hint("merge"), "key", "left_semi").select("fp").distinct()
    middles = crowded.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("middle"))
    star = middles.groupBy("middle").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1").select("middle", "u")
    return near.unionByName(middles.join(star.hint("merge"), "middle").where("fp <> u").select("u", F.col("fp").alias("v"))).distinct()


def simhash_components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id (smallest doc_id reachable)."""
    prints = checkpoint(fingerprints(docs, shingle))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    classes = connected_components(links(distinct.select("fp")))
    rooted = distinct.join(classes.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = rooted.join(named.hint("merge"), "root").select("fp", "component_id")
    return prints.join(of_fp.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def copy_classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, rid (number of the row's content), root (number of the class) of every distinct row of ``docs``. Rows are linked
    by fingerprints at distance 2 or less and, as edits leave fingerprints farther apart, by sets of shingles that are near
    (``options`` of ``near_duplicates``); classes are those of both kinds of links together."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    # a class is named by its smallest row, so that a row's two classes meet under rows that are in them
    of_prints = simhash_components(rows).select(F.col("doc_id").alias("rid"), F.lit(None).cast("long").alias("id"), F.col("component_id").alias("s"), F.lit(None).cast("long").alias("j"))
    of_sets = near_duplicates(rows, **options).select(F.col("doc_id").alias("rid"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("s"), F.col("component_id").alias("j"))
    ids = docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.col("doc_id").cast("long").alias("id"), F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("j"))
    met = checkpoint(of_prints.unionByName(of_sets).unionByName(ids).groupBy("rid").agg(F.max("id").alias("doc_id"), F.max("s").alias("s"), F.max("j").alias("j")))
    merged = connected_components(met.where("s <> j").select(F.col("s").alias("u"), F.col("j").alias("v")), small=SMALL_GRAPH)
    roots = hinted(checkpoint(merged.select(F.col("node").alias("s"), "root")))
    return met.join(roots, "s", "left").select("doc_id", "rid", F.coalesce("root", "s").alias("root"))


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their class of copies (smallest doc_id). Rows
    repeated under that id stay; a class without any doc_id stays whole."""
    rows = checkpoint(copy_classes(docs, **options))
    first = hinted(checkpoint(rows.groupBy("root").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("root", "first")))
    gone = rows.join(first, "root").where("not (doc_id <=> first)").select(F.col("doc_id").alias("__doc"), F.col("rid").alias("__gone"))
    gone = hinted(checkpoint(gone))
    marked = docs.withColumn("__rid", F.xxhash64("doc_id", "text"))
    return marked.join(gone, (F.col("__rid") == F.col("__gone")) & F.col("doc_id").eqNullSafe(F.col("__doc")), "left_anti").drop("__rid")


def hex_fingerprint(column: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
