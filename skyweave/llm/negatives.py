"""Hard negatives of anchors by exact integer products over bit planes.

Vectors are scaled to integers once, in the JVM. Anchors are a stated query set: they are taken in chunks whose bytes are
bounded (``CHUNK_BYTES``), each chunk is broadcast and held against all rows, block by block. A block of rows is cut into
its bit planes, in two's complement. The planes are multiplied with the anchors most significant first; after each, a score
is known to lie in an interval: the planes still to come add between 0 and 2**t - 1 in every component, so between the
sum of the anchor's negative and of its positive components, times 2**t - 1. Rows whose intervals reach no wanted score of
any anchor drop out of the block, pairs that cannot qualify are set aside, and once few pairs are left the remaining planes
are taken for these alone. Nothing is estimated: all pairs that are left after the last plane have their exact product.

Two passes: the first finds each anchor's positives (best rows of its label); with their scores known, the second looks for
the best rows of other labels in the windows below them. Every task keeps the best few for each anchor and window, so it
sends a bounded list for each anchor; lists are merged by anchor and window. The bounds tighten with what the task has kept.

Edge cases: rows with a null id, label or vector, or a null, NaN or infinite component take no part; shorter vectors count as
filled up with zeros; ties go by id; rows repeated under one id are rows of their own; anchors without rows of their label
give nothing; empty tables give empty results. Components must be below 2**22 when scaled, so that products are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.operators.common import assign_ids

from .common import checkpoint

#: Anchors, positives of an anchor, negatives of a positive, and the window of negative scores in percent of the positive.
EVERY, POSITIVES, NEGATIVES, WINDOW, SCALE = 100, 5, 5, (80, 100), 256
#: A chunk of anchors is broadcast up to so many bytes.
CHUNK_BYTES = 32 << 20
#: Anchors and rows that are multiplied at once (4 MB of scores), and the share of pairs from which they are taken singly.
ANCHOR_BLOCK, ROW_BLOCK, SPARSE = 512, 2048, 0.02
_LIMIT = 1 << 22


def integer_vectors(rows: DataFrame, scale: int = SCALE, shift_every: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label, v: rows that take part, with components floor(scale * x); labels of ids divisible by ``shift_every``
    move on by one (0: none)."""
    label = F.col("label").cast("long")
    if shift_every:
        label = F.when(F.col("vec_id") % shift_every == 0, F.pmod(label + 1, F.lit(labels))).otherwise(label)
    x = F.transform("embedding", lambda e: e.cast("double"))
    whole = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def _matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column, filled up with zeros; longer rows keep their length."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), max(width, int(size.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    if np.abs(out).max(initial=0) >= _LIMIT:
        raise ValueError(f"components must be below {_LIMIT} when scaled")
    return out


def sliced_products(anchors: np.ndarray, rows: np.ndarray, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs that ``wanted(low, high, pairs)`` keeps, plane by plane, as long as it does so.

    ``wanted`` gets bounds of the scores, both ends included, and where they are: the rows of a matrix (anchors x rows), or
    the anchors and rows of single pairs; it returns which can still qualify. With low = high it has the scores.
    """
    planes = max(1, int(max(rows.max(initial=0), -rows.min(initial=0) - 1)).bit_length()) + 1
    a = anchors.astype(np.float64)
    below, above = np.minimum(a, 0).sum(1), np.maximum(a, 0).sum(1)
    sums = np.zeros((len(anchors), len(rows)))
    left = np.arange(len(rows))
    at: tuple[np.ndarray, np.ndarray] | None = None
    for t in range(planes - 1, -1, -1):
        bits = ((rows >> t) & 1).astype(np.float64)
        weight = float(-(1 << t) if t == planes - 1 else 1 << t)
        rest = float((1 << t) - 1)
        if at is None:
            sums += weight * (a @ bits[left].T)
            low, high = sums + rest * below[:, None], sums + rest * above[:, None]
            keep = wanted(low, high, left)
            some = keep.any(0)
            if t == 0 or keep.sum() <= SPARSE * len(anchors) * len(rows):
                i, j = np.nonzero(keep)
                at, sums = (i, left[j]), sums[i, j]
            elif some.mean() < 0.8:
                left, sums = left[some], sums[:, some]
        elif len(sums):
            i, j = at
            sums = sums + weight * np.einsum("ij,ij->i", a[i], bits[j])
            keep = wanted(sums + rest * below[i], sums + rest * above[i], at)
            at, sums = (i[keep], j[keep]), sums[keep]
    return at[0], at[1], sums.astype(np.int64)


class _Best:
    """The best rows of each (anchor, window) so far: scores descending, ties by id."""

    def __init__(self, anchors: int, windows: int, keep: int) -> None:
        self.keep, self.windows = keep, windows
        self.score = np.full((anchors * windows, keep), np.iinfo(np.int64).min)
        self.vec = np.zeros((anchors * windows, keep), np.int64)

    def floor(self, a: int, b: int) -> np.ndarray:
        """Scores that further rows of anchors a to b must reach, by window."""
        return self.score[a * self.windows : b * self.windows, -1].reshape(b - a, self.windows)

    def put(self, slot: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        touched = np.unique(slot)
        held = self.score[touched] > np.iinfo(np.int64).min
        slot = np.concatenate((slot, np.repeat(touched, held.sum(1))))
        score, vec = np.concatenate((score, self.score[touched][held])), np.concatenate((vec, self.vec[touched][held]))
        order = np.lexsort((vec, -score, slot))
        slot, score, vec = slot[order], score[order], vec[order]
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else np.empty(0, np.int64)
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        good = rank < self.keep
        self.score[slot[good], rank[good]], self.vec[slot[good], rank[good]] = score[good], vec[good]

    def batch(self, names: np.ndarray) -> pa.RecordBatch:
        slot, rank = np.nonzero(self.score > np.iinfo(np.int64).min)
        return pa.RecordBatch.from_arrays([pa.array(names[slot // self.windows]), pa.array((slot % self.windows).astype(np.int32)), pa.array(self.score[slot, rank]), pa.array(self.vec[slot, rank])], ["anchor", "slot", "score", "vec_id"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, ROW_BLOCK):
            part = b.slice(at, ROW_BLOCK)
            yield (*(part.column(k).to_numpy(zero_copy_only=False) for k in range(3)), part.column(3))


_FOUND = "anchor long, slot int, score long, vec_id long"


def _search(rows: DataFrame, chunk: dict[str, np.ndarray], windows: int, keep: int, pick) -> DataFrame:
    """anchor (its row number), slot, score, vec_id: the best ``keep`` rows in every task for every anchor and window.
    ``pick(chunk, a, b, row numbers, labels, best)`` gives ``wanted`` for anchors a to b and the windows of a kept score."""
    told = rows.sparkSession.sparkContext.broadcast(chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = told.value
        best = _Best(len(chunk["rid"]), windows, keep)
        for rid, vec, label, lists in _blocks(batches):
            v = _matrix(lists, chunk["v"].shape[1])
            for a in range(0, len(chunk["rid"]), ANCHOR_BLOCK):
                b = min(a + ANCHOR_BLOCK, len(chunk["rid"]))
                wanted, slots = pick(chunk, a, b, rid, label, best)
                i, j, score = sliced_products(np.pad(chunk["v"][a:b], ((0, 0), (0, v.shape[1] - chunk["v"].shape[1]))), v, wanted)
                which, slot = slots(i, score)
                best.put((a + i[which]) * windows + slot, score[which], vec[j[which]])
        for a in range(0, len(chunk["rid"]), 4 * ANCHOR_BLOCK):
            part = slice(a * windows, (a + 4 * ANCHOR_BLOCK) * windows)
            some = _Best(0, windows, keep)
            some.score, some.vec = best.score[part], best.vec[part]
            yield some.batch(chunk["rid"][a : a + 4 * ANCHOR_BLOCK])

    return rows.select("rid", "vec_id", "label", "v").mapInArrow(run, _FOUND)


def _same_label(chunk: dict, a: int, b: int, rid: np.ndarray, label: np.ndarray, best: _Best):
    """Rows of the anchor's label but itself that can be among its best."""
    same = (chunk["label"][a:b, None] == label) & (chunk["rid"][a:b, None] != rid)
    least = best.floor(a, b)[:, 0].astype(np.float64)
    state = {"least": least}

    def wanted(low, high, at):
        if isinstance(at, tuple):
            return high >= state["least"][at[0]]
        mask = same[:, at]
        if mask.shape[1] >= best.keep:  # so many rows score this or more
            sure = np.partition(np.where(mask, low, -np.inf), -best.keep, axis=1)[:, -best.keep]
            state["least"] = np.maximum(state["least"], sure)
        return mask & (high >= state["least"][:, None])

    return wanted, lambda i, score: (np.arange(len(i)), np.zeros(len(i), np.int64))


def _other_label(window: tuple[int, int]):
    """Rows of other labels in the windows below the positives."""
    least_pct, most_pct = window

    def pick(chunk: dict, a: int, b: int, rid: np.ndarray, label: np.ndarray, best: _Best):
        other = chunk["label"][a:b, None] != label
        positive = chunk["positive"][a:b]  # anchors x windows; NaN: none
        top, low_end = np.floor(most_pct * positive / 100), np.maximum(np.ceil(least_pct * positive / 100), best.floor(a, b))

        def wanted(low, high, at):
            if isinstance(at, tuple):
                i = at[0]
                out = np.zeros(len(i), bool)
                for w in range(top.shape[1]):
                    out |= (low <= top[i, w]) & (high >= low_end[i, w])
                return out
            mask = other[:, at]
            out = np.zeros(mask.shape, bool)
            for w in range(top.shape[1]):
                out |= (low <= top[:, w, None]) & (high >= low_end[:, w, None])
            return out & mask

        def slots(i, score):
            inside = (score[:, None] <= top[i]) & (score[:, None] >= low_end[i])
            which, slot = np.nonzero(inside)
            return which, slot

        return wanted, slots

    return pick


def _merged(found: DataFrame, keep: int) -> DataFrame:
    """anchor, slot, best: the best of the tasks' lists, at most ``keep`` each of which came from one task."""
    c = F.struct((-F.col("score")).alias("low"), "vec_id")
    return found.groupBy("anchor", "slot").agg(F.slice(F.array_sort(F.collect_list(c)), 1, keep).alias("best"))


def hard_negatives(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: int = SCALE, shift_every: int = 7, labels: int = 10, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ``rows`` (vec_id, embedding, label).

    Anchors are the rows whose id is divisible by ``every``. A score is the integer inner product of components
    floor(scale * x). Positives are an anchor's best other rows of its label, higher scores and then smaller ids first;
    negatives are the best rows of other labels whose score is within ``window`` percent of the positive's.
    """
    if positives < 1 or negatives < 1 or every < 1:
        raise ValueError("every, positives and negatives must be positive")
    whole = checkpoint(integer_vectors(rows, scale, shift_every, labels).withColumn("rid", F.monotonically_increasing_id()))
    queries = assign_ids(whole.where(F.col("vec_id") % every == 0), ["vec_id", "rid"], "no")
    n, width = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    each = max(1, chunk_bytes // (16 * (width or 1) + 8 * (positives + 4)))
    out = None
    for start in range(0, n, each):
        part = queries.where((F.col("no") >= start) & (F.col("no") < start + each)).select("rid", "vec_id", "label", "v").toArrow()
        chunk = {"rid": part["rid"].to_numpy(), "label": part["label"].to_numpy(), "v": _matrix(part["v"])}
        order = np.argsort(chunk["rid"])
        chunk = {k: x[order] for k, x in chunk.items()}
        near = checkpoint(_merged(_search(whole, chunk, 1, positives, _same_label), positives).select("anchor", F.posexplode("best").alias("slot", "x")).select("anchor", "slot", F.col("x.vec_id").alias("positive_id"), (-F.col("x.low")).alias("positive_score")))
        told = near.toArrow()  # at most `positives` rows for each anchor of the chunk
        chunk["positive"] = np.full((len(order), positives), np.nan)
        chunk["positive"][np.searchsorted(chunk["rid"], told["anchor"].to_numpy()), told["slot"].to_numpy()] = told["positive_score"].to_numpy()
        found = _merged(_search(whole, chunk, positives, negatives, _other_label(window)), negatives).select("anchor", "slot", F.posexplode("best").alias("k", "x"))
        ids = queries.where((F.col("no") >= start) & (F.col("no") < start + each)).select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        mine = checkpoint(found.join(near, ["anchor", "slot"]).join(ids, "anchor").select("anchor_id", "positive_id", (F.col("k") + 1).alias("rank"), F.col("x.vec_id").alias("negative_id"), "positive_score", (-F.col("x.low")).alias("negative_score")))
        out = mine if out is None else out.unionByName(mine)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return rows.sparkSession.createDataFrame([], empty) if out is None else out
