"""Exact Jaccard self-join of documents on word shingles, as a metric-space join.

The Jaccard distance is a metric. In the space of all texts nearly every distance is 1, and a pivot at distance 1 tells
nothing, so texts first look for pivots that they share a signature with:

1. Every text becomes the sorted set of hashes of its shingles, once; sets are written once and read from there. Shingles
   that are frequent in some task are counted on the way, and give one order for all sets, rare ones first.
2. Two sets within the distance share a shingle among the first n - ceil(similarity n) + 1 of that order. Sets meet by
   equality of such a shingle; sizes and places of the shingle rule out most pairs that cannot be near. A group of few
   sets is compared as it is. In a larger one the first set is the pivot: its members are held against it, each against
   the pivot that it meets in most groups. Texts within the distance of one pivot are one class, so a group of any number
   of near copies takes one comparison a text.
3. In groups that are not of one class by then, texts that can still be near one of another class make up regions,
   connected through the pairs that can be. What cannot be near is told by bitmaps: sets differ in at least as many
   shingles as the parities of their numbers of shingles by bins do. A region that is larger than a block is split as Voronoi cells: pivots are drawn, every member's distances to all of them are computed,
   and it goes to its nearest pivot p, and also to each pivot q with d(x, q) <= d(x, p) + 2 e, e being the distance of the
   join: if y is within e of x and nearest to q, then d(x, q) <= e + d(y, q) <= e + d(y, p) <= 2 e + d(x, p), so no near pair
   is parted. Members that are far from every pivot (f = 1 - 1.5 e or more) make up one cell more, the rest, and a pivot's
   cell ends at f + e: of a near pair of which one is not far, the other is within that. Cells are split again in the same
   way while that halves the pairs and no more than doubles the rows. Cells of one block are joined within it; a cell that
   pivots cannot split is joined in pairs of blocks, whose bands of distances to a pivot (triangle inequality) are within
   e of each other.

Everything is exact: pivots, orders and blocks decide only where pairs meet. A set is 48 bits of hash a shingle, so two
different shingles of a pair of texts are taken for one with a probability of some 10**-9 a pair.

Edge cases: null, empty and wordless texts have no shingles (``n_shingles`` 0); texts of fewer words than a shingle are one
shingle of all of them; rows repeated under one id keep their rows, and a null doc_id takes part without naming a class; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.operators.graph import connected_components

from .common import WordHashes, checkpoint, ensure_checkpoint_dir, fields_for, hinted, utf8, window_hashes

#: Words of a shingle, and the Jaccard similarity from which two texts are linked.
SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a shingle's hash.
BITS = 48
#: Shingles that a task counts at once, how often one must be among them to count as frequent, and how many the order knows.
COUNT_ROWS, OFTEN, HOT_SHINGLES = 2_000_000, 4, 1 << 20
#: Nodes that a task remembers, so that copies in it store their set once.
SEEN = 200_000
#: Groups of up to SMALL sets are compared pair by pair.
SMALL = 6
#: Groups of more rows than this are not thinned out by bitmaps before they are regions.
GROUP_ROWS = 4096
#: A block of sets: bytes and rows. Pivots of a region, and how often regions are split.
BLOCK_BYTES, BLOCK_ROWS, PIVOTS, MAX_DEPTH = 4 << 20, 2048, 24, 8
#: Classes that are linked by up to so many links are merged in one task.
SMALL_GRAPH = 100_000
_EPS = 1e-9


def shingle_set(text: str | None, hashes: WordHashes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct word shingles in ascending order; a text of fewer words is one shingle of all of them."""
    words = utf8(text).lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(hashes.of(words), min(shingle, len(words))) >> np.uint64(64 - BITS))


def packed(s: np.ndarray) -> bytes:
    return np.ascontiguousarray(s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8]).tobytes()


def unpacked(data) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, BITS // 8)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, : BITS // 8] = six
    return out.view("<u8").reshape(-1)


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the numbers of shingles in 2**k bins, 1.5 bins a shingle at least: two sets differ in no fewer shingles
    than their bitmaps do in bins."""
    bins = 1 << max(6, math.ceil(math.log2(max(1.5 * len(s), 1))))
    return np.packbits((np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1).astype(np.uint8)).tobytes()


def _folded(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of half as many bins."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def possible(size: np.ndarray, bits: list, other_size: np.ndarray, other_bits: list, similarity: float) -> np.ndarray:
    """Which pairs of sets the sizes and bitmaps leave, as a matrix. Sets this similar differ in (1 - s) / (1 + s) of their
    sizes at most, so the numbers of bins differ by a factor of two at most (for a similarity of half or more)."""
    x, y = size.astype(np.float64)[:, None], other_size.astype(np.float64)[None, :]
    most = (1 - similarity) / (1 + similarity) * (x + y) + _EPS
    out = np.minimum(x, y) >= similarity * np.maximum(x, y) - _EPS
    bins_x, bins_y = np.array([len(b) for b in bits]), np.array([len(b) for b in other_bits])
    for bx in np.unique(bins_x):
        i = np.flatnonzero(bins_x == bx)
        mine = np.frombuffer(b"".join(bits[k] for k in i), np.uint64).reshape(len(i), -1)
        for by in np.unique(bins_y):
            j = np.flatnonzero(bins_y == by)
            if max(bx, by) > 2 * min(bx, by) and similarity >= 0.5 or not out[np.ix_(i, j)].any():
                continue
            a, b = mine, np.frombuffer(b"".join(other_bits[k] for k in j), np.uint64).reshape(len(j), -1)
            while a.shape[1] > b.shape[1]:
                a = _folded(a)
            while b.shape[1] > a.shape[1]:
                b = _folded(b)
            step = max(1, 2_000_000 // (len(j) * a.shape[1]))
            for at in range(0, len(i), step):
                part = i[at : at + step]
                differ = np.bitwise_count(a[at : at + step, None, :] ^ b[None, :, :]).sum(2, dtype=np.int64)
                out[np.ix_(part, j)] &= differ <= most[np.ix_(part, j)]
    return out


def _node(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - (1 << 63)


def prefix(s: np.ndarray, hot: np.ndarray, level: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of a set of which one at least is shared with every set this similar, in an order that is the same for
    all sets: frequent ones (``hot``, ascending, and their levels) last, else by hash."""
    rank = s
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        rank = s | (np.where(hot[at] == s, level[at], 0).astype(np.uint64) << np.uint64(BITS))
    return s[np.argsort(rank, kind="stable")[: len(s) - math.ceil(similarity * len(s) - _EPS) + 1]]


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``: shingles of many sets by matrix products, the
    others by their pairs."""
    na, nb = len(a), len(b)
    out = np.zeros((na, nb), np.float32)
    x, y = (np.concatenate(s) if s else np.empty(0, np.uint64) for s in (a, b))
    rx, ry = (np.repeat(np.arange(len(s)), [len(e) for e in s]) for s in (a, b))
    shared = np.intersect1d(x, y)
    if not len(shared):
        return out
    parts = []
    for v, r in ((x, rx), (y, ry)):
        col = np.minimum(np.searchsorted(shared, v), len(shared) - 1)
        good = shared[col] == v
        col, r = col[good], r[good]
        order = np.argsort(col, kind="stable")
        parts.append((col[order], r[order]))
    (cx, rx), (cy, ry) = parts
    many_x, many_y = (np.bincount(c, minlength=len(shared)) for c in (cx, cy))
    dense = many_x * many_y * 100 > na * nb
    number = np.cumsum(dense) - 1
    for at in range(0, int(dense.sum()), 2048):
        planes = []
        for c, r, n in ((cx, rx, na), (cy, ry, nb)):
            here = dense[c] & (number[c] >= at) & (number[c] < at + 2048)
            plane = np.zeros((n, 2048), np.float32)
            plane[r[here], number[c[here]] - at] = 1
            planes.append(plane)
        out += planes[0] @ planes[1].T
    few = ~dense[cx]
    c, r = cx[few], rx[few]
    start = np.cumsum(many_y) - many_y
    upto = np.cumsum(many_y[c])
    done = 0
    while done < len(c):
        end = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + 4_000_000)))
        n = many_y[c[done:end]]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pairs = np.repeat(r[done:end], n) * nb + ry[np.repeat(start[c[done:end]], n) + within]
        out += np.bincount(pairs, minlength=na * nb).reshape(na, nb)
        done = end
    return out


def jaccard(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    shared = overlaps(a, b).astype(np.float64)
    size = np.array([len(s) for s in a], float)[:, None] + np.array([len(s) for s in b], float)[None, :]
    return shared / np.maximum(size - shared, 1)


# ------------------------------------------------------------------ groups of one signature


def _runs(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[list[np.ndarray]]:
    """Columns of whole groups (rows of one key, the first column, follow each other), many groups at once."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        held.append([np.asarray(c) for c in b.columns])
        if sum(len(h[0]) for h in held) < rows:
            continue
        whole = [np.concatenate(c) for c in zip(*held, strict=True)]
        cut = int(np.searchsorted(whole[0], whole[0][-1]))
        if cut:
            yield [c[:cut] for c in whole]
        held = [[c[cut:] for c in whole]]
        rows = max(rows, 2 * len(held[0][0]))  # a group beyond it is not copied at every batch
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _lengths(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the group of every row."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    return np.repeat(first, size), np.repeat(size, size)


def _may(size: np.ndarray, pos: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether rows a and b can be similar, if the shingle at these positions is the first that they share."""
    x, y = size[a].astype(np.float64), size[b].astype(np.float64)
    most = np.minimum(x - pos[a], y - pos[b])
    return (np.minimum(x, y) >= similarity * np.maximum(x, y) - _EPS) & (most >= similarity / (1 + similarity) * (x + y) - _EPS)


def _candidates(columns: list[np.ndarray], similarity: float) -> Iterator[pa.RecordBatch]:
    """(u, v, n, led): all pairs of small groups, and of large ones every row with its pivot u, the first row; n groups."""
    key, node, size, pos, _ = columns
    if not len(key):
        return
    first, length = _lengths(key)
    small, led = [], []

    def put(out: list, a: np.ndarray, b: np.ndarray) -> None:
        good = _may(size, pos, a, b, similarity)
        out.append(np.stack((node[a[good]], node[b[good]])))

    rows = np.arange(len(key))
    every = np.flatnonzero(length <= SMALL)
    for step in range(1, SMALL):
        every = every[every + step < first[every] + length[every]]
        put(small, every, every + step)
    rest = rows[(length > SMALL) & (rows != first)]
    put(led, first[rest], rest)
    for pairs, flag in ((small, False), (led, True)):
        both, often = np.unique(np.concatenate(pairs, axis=1), axis=1, return_counts=True)
        if both.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(often), pa.array(np.full(len(often), flag))], ["u", "v", "n", "led"])


def _mixed(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The rows of groups (key, node, root) with more than one root."""
    key, root = columns[0], columns[2]
    first, _ = _lengths(key)
    mixed = np.zeros(len(key), bool)
    mixed[first[root != root[first]]] = True
    return [c[mixed[first]] for c in columns]


def _connected(key: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray, bits: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): every row that can be near one of another root in its group, with the first row that such pairs reach."""
    first, length = _lengths(key)
    out: list[np.ndarray] = []
    for at in np.unique(first) if len(key) else []:
        part = slice(at, at + length[at])
        maps = list(bits[part])
        may = possible(size[part], maps, size[part], maps, similarity) & (root[part][:, None] != root[part][None, :])
        some = np.flatnonzero(may.any(1))
        may = may[np.ix_(some, some)]
        label = np.arange(len(some))
        while len(some):
            low = np.minimum(label, np.where(may, label[None, :], len(some)).min(1))
            if (low == label).all():
                break
            label = low[low]
        out.append(np.stack((node[part][some][label], node[part][some])))
    both = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.empty((2, 0), np.int64)
    return both[:, both[0] != both[1]]


# ------------------------------------------------------------------ regions


def _split(batches: Iterator[pa.RecordBatch], e: float) -> Iterator[pa.RecordBatch]:
    """region, pivot (null: the rest), node, root, size, band: members under their pivots; the band is that of the distance
    to the region's first pivot. Rows: a block of a region (nodes, roots, sets) and its pivots."""
    far = max(e, 1 - 1.5 * e)
    for b in batches:
        for region, nodes, roots, sets, pivots, centres in zip(*(b.column(c) for c in range(6)), strict=True):
            sets = [unpacked(x) for x in sets.as_py()]
            d = 1 - jaccard(sets, [unpacked(x) for x in centres.as_py()])
            least = d.min(1)
            i, j = np.nonzero((d <= least[:, None] + 2 * e + _EPS) & (d <= far + e + _EPS))
            rest = np.flatnonzero(least >= far - _EPS)
            node, root, pivot = (np.array(x.as_py(), np.int64) for x in (nodes, roots, pivots))
            size = np.array([len(s) for s in sets], np.int64)
            rows = np.concatenate((i, rest))
            cell = pa.array(np.concatenate((pivot[j], np.zeros(len(rest), np.int64))), mask=np.arange(len(rows)) >= len(i))
            band = np.floor(d[rows, 0] * 2 / e).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), region.as_py(), np.int64)), cell, pa.array(node[rows]), pa.array(root[rows]), pa.array(size[rows]), pa.array(band)], ["region", "pivot", "node", "root", "size", "band"])


def _linked(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs of roots that are linked by two sets of a pair of blocks (roots and sets of each)."""
    for b in batches:
        for roots, sets, others, other_sets in zip(*(b.column(c) for c in range(4)), strict=True):
            x, y = np.array(roots.as_py(), np.int64), np.array(others.as_py(), np.int64)
            if (x != x[0]).any() or (y != x[0]).any():
                near = (jaccard([unpacked(s) for s in sets.as_py()], [unpacked(s) for s in other_sets.as_py()]) >= similarity - _EPS) & (x[:, None] != y[None, :])
                i, j = np.nonzero(near)
                found = np.unique(np.stack((np.minimum(x[i], y[j]), np.maximum(x[i], y[j]))), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["u", "v"])


class _Join:
    """The steps of one join over written sets."""

    def __init__(self, docs: DataFrame, similarity: float, shingle: int) -> None:
        self.spark, self.similarity, self.shingle = docs.sparkSession, similarity, shingle
        self.written = self._write(docs)
        self.rows = self.written.where("hot is null").select("doc_id", "rid", "node", "n", "at")

    def _write(self, docs: DataFrame) -> DataFrame:
        """doc_id, rid, node, n, at, shingles, bits of every row, and rows that hold frequent shingles alone. ``at`` numbers the
        stored sets: of copies in one task the first has the set."""
        shingle = self.shingle
        source = fields_for(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("rid"), "text")
        names = ["doc_id", "rid", "node", "n", "at", "shingles", "bits", "hot"]
        schema = "doc_id long, rid long, node long, n long, at long, shingles binary, bits binary, hot binary"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, seen, held, count = WordHashes(), set(), [], 0
            at = TaskContext.get().partitionId() << 33
            none = lambda kind: pa.nulls(1, kind)

            def frequent() -> pa.RecordBatch:
                value, often = np.unique(np.concatenate(held), return_counts=True)
                some = often >= OFTEN
                data = np.stack((value[some], often[some].astype(np.uint64)), axis=1).tobytes()
                return pa.RecordBatch.from_arrays([*[none(pa.int64())] * 5, *[none(pa.binary())] * 2, pa.array([data], pa.binary())], names)

            for b in batches:
                node, size, place, data, bits = [], [], [], [], []
                for t in b.column(2):
                    s = shingle_set(t.as_py(), hashes, shingle)
                    d = packed(s)
                    k = _node(d)
                    fresh = k not in seen and len(s) > 0
                    if fresh:
                        if len(seen) < SEEN:
                            seen.add(k)
                        at += 1
                        held.append(s)
                        count += len(s)
                    node.append(k)
                    size.append(len(s))
                    place.append(at if fresh else None)
                    data.append(d if fresh else None)
                    bits.append(bitmap(s) if fresh else None)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(place, pa.int64()), pa.array(data, pa.binary()), pa.array(bits, pa.binary()), pa.nulls(len(node), pa.binary())], names)
                if count >= COUNT_ROWS:
                    yield frequent()
                    held, count = [], 0
            if held:
                yield frequent()

        ensure_checkpoint_dir(self.spark)
        path = f"{self.spark.sparkContext.getCheckpointDir()}/sets-{uuid.uuid4().hex}"
        source.mapInArrow(run, schema).write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def _order(self) -> tuple[np.ndarray, np.ndarray]:
        """The most frequent shingles, at most HOT_SHINGLES, and their levels."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for data in b.column(0):
                    both = np.frombuffer(data.as_buffer(), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], ["key", "n"])

        counted = checkpoint(self.written.where("hot is not null").select("hot").mapInArrow(run, "key long, n long").groupBy("key").agg(F.round(4 * F.log2(F.sum("n"))).cast("int").alias("level")))
        least, room = None, HOT_SHINGLES
        for r in sorted(counted.groupBy("level").count().collect(), reverse=True):
            room -= r["count"]
            if room < 0:
                break
            least = r["level"]
        if least is None:
            return np.empty(0, np.uint64), np.empty(0, np.uint8)
        found = counted.where(F.col("level") >= least).toArrow()
        hot, level = found["key"].to_numpy().astype(np.uint64), found["level"].to_numpy().astype(np.uint8)
        order = np.argsort(hot)
        return hot[order], level[order]

    def _groups(self) -> DataFrame:
        """key, node, size, pos, large: sets by the shingles of their prefixes, where two sets at least have one."""
        told, similarity = self.spark.sparkContext.broadcast(self._order()), self.similarity

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hot, level = told.value
            for b in batches:
                for at in range(0, b.num_rows, 200):
                    part = b.slice(at, 200)
                    sets = [unpacked(x.as_buffer()) for x in part.column(1)]
                    keys = [prefix(s, hot, level, similarity) for s in sets]
                    n = [len(k) for k in keys]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), n)),
                        pa.array(np.repeat(np.array([len(s) for s in sets], np.int32), n)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in n])),
                    ], ["key", "node", "size", "pos"])

        def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for columns in _runs(batches):
                key, node = columns[:2]
                fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
                columns = [c[fresh] for c in columns]
                length = _lengths(columns[0])[1]
                several = length > 1
                if several.any():
                    yield pa.RecordBatch.from_arrays([pa.array(c[several]) for c in (*columns, length > SMALL)], ["key", "node", "size", "pos", "large"])

        prefixes = self.written.where("shingles is not null").select("node", "shingles").mapInArrow(index, "key long, node long, size int, pos int")
        return checkpoint(prefixes.repartition("key").sortWithinPartitions("key", "node").mapInArrow(groups, "key long, node long, size int, pos int, large boolean"))

    def _sets(self, nodes: DataFrame, distinct: DataFrame) -> DataFrame:
        """node, shingles of these nodes, each once. A few places find their sets where these are read; beyond the limit
        of a broadcast all sets are shuffled once."""
        places = checkpoint(distinct.join(nodes.hint("merge"), "node", "left_semi").select("at"))
        return checkpoint(self.written.where("at is not null").select("at", "node", "shingles").join(hinted(places), "at", "left_semi").select("node", "shingles"))

    def _bits(self, nodes: DataFrame, distinct: DataFrame) -> DataFrame:
        """node, n, bits of these nodes."""
        places = distinct.join(nodes.hint("merge"), "node", "left_semi").select("at")
        return checkpoint(self.written.where("at is not null").select("at", "node", "n", "bits").join(places.hint("merge"), "at", "left_semi").drop("at"))

    def _left(self, pairs: DataFrame, bits: DataFrame) -> DataFrame:
        """The pairs that bitmaps leave."""
        similarity = self.similarity

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                good = [
                    possible(np.array([m]), [x.as_buffer()], np.array([n]), [y.as_buffer()], similarity)[0, 0]
                    for m, x, n, y in zip(b.column(2).to_pylist(), b.column(3), b.column(4).to_pylist(), b.column(5), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))

        of = lambda name: bits.select(F.col("node").alias(name), F.col("n").alias(f"{name}_n"), F.col("bits").alias(f"{name}_bits")).hint("merge")
        met = pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "u_n", "u_bits", "v_n", "v_bits")
        return checkpoint(met.mapInArrow(run, "u long, v long"))

    def _near(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        similarity = self.similarity

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                good = []
                for x, y in zip(b.column(2), b.column(3), strict=True):
                    x, y = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(shared >= similarity * (len(x) + len(y) - shared) - _EPS)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))

        of = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"{name}_set")).hint("merge")
        return checkpoint(pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "u_set", "v_set").mapInArrow(run, "u long, v long"))

    def _blocked(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """region, band, part, nodes, roots, sets of (region, band, node, root, size): blocks of bounded rows and bytes."""
        totals = checkpoint(members.groupBy("region", "band").agg(F.count("*").alias("__rows"), F.sum(F.col("size") * (BITS // 8)).alias("__bytes")))
        parts = F.greatest(F.ceil(F.col("__rows") / BLOCK_ROWS), F.ceil(F.col("__bytes") / BLOCK_BYTES))
        placed = members.join(hinted(totals), ["region", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), parts))
        return placed.join(sets.hint("merge"), "node").groupBy("region", "band", "part").agg(F.collect_list("node").alias("nodes"), F.collect_list("root").alias("roots"), F.collect_list("shingles").alias("sets"))

    def _region_links(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """Links (u, v) of roots from (region, node, root, size): Voronoi cells, and pairs of blocks where cells end."""
        e = 1 - self.similarity
        still, closed = members.withColumn("band", F.lit(0)), []
        for depth in range(MAX_DEPTH):
            totals = checkpoint(still.groupBy("region").agg(F.count("*").alias("n"), F.sum(F.col("size") * (BITS // 8)).alias("bytes")))
            large = totals.where((F.col("n") > BLOCK_ROWS) | (F.col("bytes") > BLOCK_BYTES)).select("region", "n")
            done = still.join(large.hint("merge"), "region", "left_anti")
            closed.append(done.select("region", "band", "node", "root", "size"))
            if large.isEmpty():
                return self._block_links(closed, sets)
            todo = checkpoint(still.join(large.hint("merge"), "region"))
            draw = F.pmod(F.xxhash64("node", F.lit(depth)), F.lit(1 << 24)) * F.col("n") < PIVOTS << 24
            pivots = todo.where(draw).select("region", "node").distinct().join(sets.hint("merge"), "node").groupBy("region").agg(F.collect_list("node").alias("pivots"), F.collect_list("shingles").alias("centres"))
            blocks = self._blocked(todo.select("region", F.lit(0).alias("band"), "node", "root", "size"), sets)
            cells = checkpoint(blocks.join(pivots.hint("merge"), "region").select("region", "nodes", "roots", "sets", "pivots", "centres").mapInArrow(lambda batches: _split(batches, e), "region long, pivot long, node long, root long, size long, band int"))
            cost = cells.groupBy("region", "pivot").count().groupBy("region").agg(F.sum("count").alias("rows"), F.sum(F.col("count") * F.col("count")).alias("pairs"))
            splits = checkpoint(large.join(cost.hint("merge"), "region").where("pairs < 0.5 * n * n and rows < 2 * n").select("region"))
            # a region that pivots do not split ends here, in bands of the distance to its first pivot
            whole = todo.drop("band", "n").join(splits.hint("merge"), "region", "left_anti")
            bands = cells.groupBy("region", "node").agg(F.min("band").alias("band"))
            closed.append(checkpoint(whole.join(bands.hint("merge"), ["region", "node"], "left").select("region", F.coalesce("band", F.lit(0)).alias("band"), "node", "root", "size")))
            still = checkpoint(cells.join(splits.hint("merge"), "region", "left_semi").select(F.xxhash64("region", F.coalesce("pivot", F.lit(0)), F.col("pivot").isNull(), F.lit(depth)).alias("region"), F.lit(0).alias("band"), "node", "root", "size"))
        closed.append(still)
        return self._block_links(closed, sets)

    def _block_links(self, closed: list[DataFrame], sets: DataFrame) -> DataFrame:
        similarity = self.similarity
        members = closed[0]
        for c in closed[1:]:
            members = members.unionByName(c)
        blocks = checkpoint(self._blocked(members, sets))
        places = checkpoint(blocks.select("region", "band", "part"))
        right = places.select("region", F.col("band").alias("band2"), F.col("part").alias("part2"))
        # bands are half of the distance wide
        pairs = places.join(right.hint("merge"), "region").where("band2 - band between 0 and 2 and (band2 > band or part2 >= part)")
        left = blocks.select("region", "band", "part", F.col("roots").alias("u"), F.col("sets").alias("u_sets"))
        other = blocks.select("region", F.col("band").alias("band2"), F.col("part").alias("part2"), F.col("roots").alias("v"), F.col("sets").alias("v_sets"))
        met = pairs.join(left.hint("merge"), ["region", "band", "part"]).join(other.hint("merge"), ["region", "band2", "part2"])
        return met.select("u", "u_sets", "v", "v_sets").mapInArrow(lambda batches: _linked(batches, similarity), "u long, v long").distinct()

    def classes(self) -> DataFrame:
        """doc_id, rid, n, component_id for every row."""
        similarity = self.similarity
        met = self._groups()

        def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for columns in _runs(batches):
                yield from _candidates(columns, similarity)

        found = checkpoint(met.mapInArrow(candidates, "u long, v long, n long, led boolean"))  # groups lie together there
        led = found.where("led").groupBy("u", "v").agg(F.sum("n").alias("n")).groupBy("v").agg(F.max_by("u", F.struct("n", -F.col("u"))).alias("u"))
        pairs = checkpoint(found.where("not led").select("u", "v").unionByName(led.select("u", "v")).distinct())
        large = met.where("large").select("key", "node")
        ends = lambda p: p.select(F.col("u").alias("node")).unionByName(p.select(F.col("v").alias("node"))).distinct()
        distinct = checkpoint(self.rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("at").alias("at")))
        pairs = self._left(pairs, self._bits(ends(pairs), distinct))
        roots = checkpoint(connected_components(self._near(pairs, self._sets(ends(pairs), distinct))))

        def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for columns in _runs(batches):
                rows = _mixed(columns)
                if len(rows[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*rows, _lengths(rows[0])[1])], ["key", "node", "root", "rows"])

        def connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for columns in _runs(batches, 20_000):
                u, v = _connected(*columns, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        by_key = lambda df: df.repartition("key").sortWithinPartitions("key", "node")
        rooted = large.join(roots.hint("merge"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        open_ = checkpoint(by_key(rooted).mapInArrow(mixed, "key long, node long, root long, rows long"))
        named = distinct.select("node", "first_id").join(roots.hint("merge"), "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
        if not open_.isEmpty():
            bits = self._bits(open_.select("node").distinct(), distinct)
            asked = open_.where(F.col("rows") <= GROUP_ROWS).join(bits.hint("merge"), "node").select("key", "node", "root", "n", "bits")
            edges = checkpoint(by_key(asked).mapInArrow(connected, "u long, v long").distinct())
            giant = open_.where(F.col("rows") > GROUP_ROWS)
            star = giant.join(giant.groupBy("key").agg(F.min("node").alias("u")).hint("merge"), "key").where("node <> u").select("u", F.col("node").alias("v"))
            regions = connected_components(edges.unionByName(star), small=SMALL_GRAPH).select("node", F.col("root").alias("region"))
            known = open_.select("node", "root").distinct().join(bits.select("node", F.col("n").alias("size")).hint("merge"), "node")
            members = checkpoint(known.join(regions.hint("merge"), "node").select("region", "node", "root", "size"))
            links = checkpoint(self._region_links(members, self._sets(members.select("node"), distinct)))
            merged = checkpoint(connected_components(links, small=SMALL_GRAPH))
            named = named.join(hinted(merged.select(F.col("node").alias("root"), F.col("root").alias("top"))), "root", "left").select("node", "first_id", F.coalesce("top", "root").alias("root"))
        first = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
        of_node = named.join(first.hint("merge"), "root").select("node", "component_id")
        return self.rows.join(of_node.hint("merge"), "node").select("doc_id", "rid", "n", "component_id")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, rid (number of the row's content), component_id: documents linked by pairs whose sets of word shingles have
    this Jaccard similarity or more; texts without words are equal to one another."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be in (0, 1]")
    return _Join(docs, similarity, shingle).classes().drop("n")


def jaccard_components(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) for every row of ``docs`` (doc_id, text); texts
    without words are linked with nothing."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be in (0, 1]")
    found = _Join(docs, similarity, shingle).classes()
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
