"""Benchmark decontamination; DataFrame functions only.

A document leaks an item if a window of as many words as the item has a weighted five-word-shingle similarity of
0.8 or more with it (shared weight over united weight; the weight of a shingle is how often it occurs).

1. Windows. A window this similar shares at least similarity * n shingles with its item of n, so all windows of the item's
   length that hold so many places where the document has a shingle of the item are laid, at every start; no other
   window can reach the similarity. Windows are cut at the end of their document.
2. SimHash. Each window and item has a 64-bit SimHash of its weighted shingles, cut into 8 blocks of 8 bits. Two
   fingerprints within 23 bits differ by at most 2 bits in some block, so the items are indexed under all values
   within 2 bits of each block, and windows of the same length meet them by equality: every pair within the radius
   is found (a pair at the similarity bound is 10 bits apart on average, 23 is beyond 4 standard deviations).
   A radius of a third of all bits leaves such an index little to select by: two fingerprints at random meet in some block
   in seven of ten cases and lie within the radius in one of eighty. It is the windows that are few.
3. Exact similarity of the shingles decides.

Index and windows are rows of fixed width, shingles are fetched for what the index finds. Tables of the benchmark are
broadcast only up to a measured number of bytes; beyond it the joins shuffle, and AQE splits a phrase that is hot.

Edge cases: null and empty texts of either table match nothing; items of fewer than five words are one shingle of
all their words; repeated rows count once; repeated items are items of their own; empty
tables give an empty result; rows with a null doc_id or item_id keep the null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fields_for, hinted

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, BLOCK_BITS, VARIANT_BITS = 8, 8, 2
RADIUS = BLOCKS * (VARIANT_BITS + 1) - 1


def _hashes(text: str) -> str:
    """SQL: hashes of the lower-case words of a text."""
    return f"transform(filter(split(lower({text}), '[ \\\\t-\\\\r]+'), w -> w <> ''), w -> xxhash64(w))"


def _shingles(h: str, k: int) -> str:
    """SQL: hashes of all runs of ``k`` words, from an array of word hashes."""
    run = ", ".join(f"{h}[i + {j}]" for j in range(k))
    return f"case when size({h}) >= {k} then transform(sequence(0, size({h}) - {k}), i -> xxhash64({run})) else cast(array() as array<bigint>) end"


def _simhash(shingles: str) -> str:
    """SQL: 64-bit SimHash of an array of shingle hashes; repeats weigh by their number."""
    ones = f"aggregate({shingles}, 0, (n, x) -> n + cast(shiftrightunsigned(x, b) & 1 as int))"
    return f"aggregate(transform(sequence(0, 63), b -> case when 2 * {ones} > size({shingles}) then shiftleft(1L, b) else 0L end), 0L, (a, x) -> a | x)"


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id, length (words), k (words of a shingle), sh (shingle hashes in order), fp (SimHash)."""
    rows = fields_for(benchmark, "item_id", "text").where("text is not null").select("item_id", F.expr(_hashes("text")).alias("h")).where("size(h) > 0")
    sh = "case " + " ".join(f"when size(h) = {k} then {_shingles('h', k)}" for k in range(1, SHINGLE)) + f" else {_shingles('h', SHINGLE)} end"
    rows = rows.select("item_id", F.size("h").alias("length"), F.least(F.size("h"), F.lit(SHINGLE)).alias("k"), F.expr(sh).alias("sh"))
    return rows.withColumn("item", F.xxhash64("item_id", "sh")).withColumn("fp", F.expr(_simhash("sh")))


def _blocks(variants: bool) -> str:
    """SQL: (block, value) pairs of a fingerprint ``fp``; with all values within VARIANT_BITS bits if asked."""
    masks = [0] + [1 << i for i in range(BLOCK_BITS)] + [1 << i | 1 << j for i in range(BLOCK_BITS) for j in range(i)]
    if not variants:
        masks = [0]
    return f"flatten(transform(sequence(0, {BLOCKS - 1}), b -> transform(array({', '.join(map(str, masks))}), m -> b * 256 + (cast(shiftrightunsigned(fp, {BLOCK_BITS} * b) & 255 as int) ^ m))))"


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and item that it leaks: doc_id, item_id, start (first word), n_words, similarity, distance
    (bits between the fingerprints), rid (number of the row's content). Best window of each pair."""
    items = checkpoint(benchmark_items(benchmark))
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most SHINGLE values
    raw = fields_for(docs, "doc_id", "text").where("text is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "text")
    source = raw.select("rid", F.expr(_hashes("text")).alias("h"))
    # shared shingles of a window and an item of n at that similarity; fewer than for two of n, as windows end with their document
    needed = f"ceil({similarity!r} * n - 0.000001)"
    places = checkpoint(items.select("item", "length", "k", F.size("sh").cast("int").alias("n"), F.explode("sh").alias("s")).distinct())
    told = hinted(places)
    found = None
    for k in sizes:  # five; fewer only for items of fewer words
        here = source.select("rid", F.posexplode(F.expr(_shingles("h", k))).alias("pos", "s"))
        part = here.join(told.where(F.col("k") == k), "s").select("rid", "item", "length", "n", "pos")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = source.select("rid", F.lit(0).cast("long").alias("item"), F.lit(0).alias("length"), F.lit(0).alias("n"), F.lit(0).alias("pos")).where("false")
    per_pair = found.groupBy("rid", "item", "length", "n").agg(F.array_sort(F.collect_set("pos")).alias("ps")).where(f"size(ps) >= {needed}")
    per_pair = per_pair.withColumn("most", F.expr(f"cast({needed} as int)"))
    # starts from which the i-th to the last of so many places in a row are inside: apart for each i, together all starts
    first = "greatest(ps[i + most - 2] - n + 1, 0, if(i > 1, ps[i - 2] + 1, 0))"
    spans = f"filter(transform(sequence(1, size(ps) - most + 1), i -> struct({first} as low, ps[i - 1] as high)), x -> x.low <= x.high)"
    per_pair = per_pair.withColumn("starts", F.expr(f"flatten(transform({spans}, x -> sequence(x.low, x.high)))")).where("size(starts) > 0")
    per_row = checkpoint(per_pair.groupBy("rid", "length").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")))
    # only the texts that have windows are hashed again, and each of them once
    hashed = raw.join(hinted(per_row), "rid").select("doc_id", "rid", "length", "starts", F.expr(_hashes("text")).alias("h"))
    ready = hashed.select("doc_id", "rid", "length", "starts", *[F.expr(_shingles("h", k)).alias(f"sh{k}") for k in sizes])
    # windows are slices of the shingles of their text, cut before rows multiply
    pick = " ".join(f"when {'true' if k == SHINGLE else f'length = {k}'} then slice(sh{k}, s + 1, length - {k} + 1)" for k in sizes)
    cut = f"transform(starts, s -> struct(s as start, {f'case {pick} end' if sizes else 'cast(array() as array<bigint>)'} as sh))"
    windows = ready.select("doc_id", "rid", "length", F.explode(F.expr(cut)).alias("w")).select("doc_id", "rid", "length", "w.start", "w.sh")
    windows = checkpoint(windows.withColumn("fp", F.expr(_simhash("sh"))))
    index = checkpoint(items.select("item", "length", F.col("fp").alias("item_fp"), F.explode(F.expr(_blocks(True))).alias("block")))
    probes = windows.select("rid", "doc_id", "length", "start", "fp").distinct().withColumn("block", F.explode(F.expr(_blocks(False))))
    near = probes.join(hinted(index), ["length", "block"]).withColumn("distance", F.expr("bit_count(fp ^ item_fp)")).where(F.col("distance") <= RADIUS)
    near = near.select("rid", "doc_id", "length", "start", "item", "distance").distinct()
    shingles = checkpoint(items.select("item", "item_id", F.col("sh").alias("item_sh")).dropDuplicates(["item", "item_id"]))
    once = windows.select("rid", "length", "start", "sh").dropDuplicates(["rid", "length", "start"])
    near = near.join(once, ["rid", "length", "start"]).join(hinted(shingles), "item")
    # repeated shingles count as often as both have them; without any the common ones are counted at once
    plain = "size(array_distinct(sh)) = size(sh) and size(array_distinct(item_sh)) = size(item_sh)"
    often = "aggregate(array_intersect(item_sh, sh), 0, (n, x) -> n + least(size(filter(item_sh, y -> y = x)), size(filter(sh, y -> y = x))))"
    scored = near.withColumn("shared", F.expr(f"case when {plain} then size(array_intersect(item_sh, sh)) else {often} end"))
    scored = scored.withColumn("similarity", F.expr("shared / (size(sh) + size(item_sh) - shared)")).where(F.col("similarity") >= similarity)
    best = scored.groupBy("doc_id", "rid", "item", "item_id").agg(F.max_by(F.struct("start", "length", "similarity", "distance"), F.struct("similarity", -F.col("start"))).alias("x"))
    return best.select("doc_id", "item_id", F.col("x.start").cast("long").alias("start"), F.col("x.length").cast("long").alias("n_words"), F.col("x.similarity").alias("similarity"), F.col("x.distance").alias("distance"), "rid")


def clean_documents(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    found = hinted(checkpoint(leaks(docs, benchmark, similarity).select(F.col("doc_id").alias("__doc"), F.col("rid").alias("__gone")).distinct()))
    marked = docs.withColumn("__rid", F.xxhash64("doc_id", "text"))
    return marked.join(found, (F.col("__rid") == F.col("__gone")) & F.col("doc_id").eqNullSafe(F.col("__doc")), "left_anti").drop("__rid")
