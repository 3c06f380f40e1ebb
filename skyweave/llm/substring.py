"""Substring dedup: words covered by a 13-word window that also starts in a document with a smaller id go.

Every window of k words is an edge of the De Bruijn graph of the corpus (its first and last k-1 words are the
nodes). Edges carry their source coordinates (document, first word). An edge table, shuffled by edge hash, finds
the edges that an earlier document has as well; consecutive repeated edges of one document overlap in k-1 words
and compact into one path, which is the span that is removed. Joining the paths back to the documents by their
coordinates is the only other shuffle.

Edges travel as packed blocks, one for each chunk of documents and bucket of hashes: 7 bytes of hash and about
two bytes of coordinates for a window. The bucket comes from a second, independent hash, so what tells two edges apart
is 56 bits and the bucket, and grows with the number of buckets. Within a chunk only the smallest document of an edge is sent on, so that a
passage which a third of all documents share costs one entry for each chunk, not one for each document. The
number of buckets follows the size of the input; a bucket is all that a task holds.

What tells two edges apart is a hash: with w windows in b buckets about w * w / (b * 2**57) pairs of different windows
are taken for equal, 0.02 windows in 30 GB of text and some 60 in 100 TB. Their words are not compared.

Edge cases: a null or empty text has no words and sha256 of the empty string; texts of fewer than k words lose
nothing; rows of one doc_id never count against each other, and where their texts differ each has the marks of its own
text (the coordinates then hold a hash of the text as well); rows without a doc_id keep all their words and remove
nothing elsewhere; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, checkpoint, fields_for, hinted, utf8, window_hashes

K = 13
#: Windows of one chunk, and MB of (compressed) input for one bucket.
CHUNK_WINDOWS, BUCKET_MB = 750_000, 4
#: Bytes of an edge's hash that travel.
HASH_BYTES = 7
#: Turns word hashes into others, for the second hash of a window (an arbitrary fixed value).
OTHER = 0xA0761D6478BD642F


def input_megabytes(df: DataFrame) -> float:
    """Spark's own estimate of the size of what a plan reads; half of the texts' bytes where it has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 55:  # Spark's default for frames that are not files
        size = (df.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2
    return size / 1e6


def _planes(values: np.ndarray) -> bytes:
    """Integers as byte planes: the planes of zeros vanish when the shuffle compresses them."""
    return np.ascontiguousarray(values.astype("<i8")).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplane(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n).reshape(8, n).T).view("<i8").reshape(n)


def pack_block(doc_ids: np.ndarray, marks: np.ndarray, counts: np.ndarray, starts: np.ndarray, hashes: np.ndarray | None) -> bytes:
    """``starts`` (and ``hashes``) of all documents one after another; ``counts`` of them belong to each document.
    ``marks``: which of several texts of one id, else 0."""
    head = struct.pack("<qqq", len(doc_ids), len(starts), -1 if hashes is None else len(hashes))
    return b"".join((head, _planes(np.diff(doc_ids, prepend=0)), _planes(marks), _planes(counts), _planes(np.diff(starts, prepend=0)), b"" if hashes is None else np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).tobytes()))


def unpack_block(data) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    view, at = memoryview(data), 24
    n_docs, n, with_hashes = struct.unpack_from("<qqq", view)
    doc_ids = np.cumsum(_unplane(view[at:], n_docs))
    marks = _unplane(view[at + 8 * n_docs :], n_docs)
    counts = _unplane(view[at + 16 * n_docs :], n_docs)
    at += 24 * n_docs
    starts = np.cumsum(_unplane(view[at:], n)).astype(np.uint32)
    if with_hashes < 0:
        return doc_ids, marks, counts, starts, None
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :HASH_BYTES] = np.frombuffer(view, np.uint8, HASH_BYTES * n, at + 8 * n).reshape(-1, HASH_BYTES)
    return doc_ids, marks, counts, starts, wide.view("<u8").reshape(n)


def _split(doc_ids: np.ndarray, marks: np.ndarray, doc_of: np.ndarray, starts: np.ndarray, hashes: np.ndarray | None) -> bytes:
    """A block of windows that are in the order of their documents."""
    n = np.bincount(doc_of, minlength=len(doc_ids))
    has = n > 0
    return pack_block(doc_ids[has], marks[has], n[has], starts, hashes)


def chunk_blocks(doc_ids: np.ndarray, marks: np.ndarray, words: list[np.ndarray], buckets: int, k: int = K) -> Iterator[tuple[int, bytes]]:
    """(bucket, block) for the word hashes of documents in ascending order of their ids."""
    windows = [window_hashes(w, k) for w in words]
    sizes = np.array([len(w) for w in windows])
    if not sizes.sum():
        return
    doc_of = np.repeat(np.arange(len(doc_ids), dtype=np.int32), sizes)
    starts = np.arange(len(doc_of), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
    hashes = np.concatenate(windows)
    del windows
    order = np.argsort(hashes, kind="stable")  # stable: the smallest document comes first among equal hashes
    ranked = hashes[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    least = np.repeat(doc_of[order[first]], np.diff(np.append(np.flatnonzero(first), len(order))))  # ids ascend with doc_of
    later = np.empty(len(order), bool)
    later[order] = doc_ids[doc_of[order]] > doc_ids[least]
    del ranked, first, least, order
    if later.any():  # an earlier document of this very chunk has them
        yield int(doc_ids[0] % buckets), _split(doc_ids, marks, doc_of[later], starts[later], None)
    sent = ~later
    doc_of, starts, hashes = doc_of[sent], starts[sent], hashes[sent]
    bucket = np.concatenate([(window_hashes(w ^ np.uint64(OTHER), k) % np.uint64(buckets)).astype(np.int32) for w in words])[sent]
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    for b in range(buckets):
        mine = order[ends[b - 1] if b else 0 : ends[b]]
        if len(mine):
            yield b, _split(doc_ids, marks, doc_of[mine], starts[mine], hashes[mine])


def repeated_of_bucket(blocks: list) -> Iterator[tuple[int, int, bytes]]:
    """(doc_id, mark, first words of repeated windows) from all blocks of one bucket."""
    parsed = [unpack_block(b) for b in blocks]
    known = [p for p in parsed if p[4] is None]
    edges = [p for p in parsed if p[4] is not None]
    for doc_ids, marks, counts, starts, _ in known:
        yield from _rows(doc_ids, marks, counts, starts, np.ones(len(starts), bool))
    if not edges:
        return
    hashes = np.concatenate([p[4] for p in edges])
    docs = np.concatenate([np.repeat(p[0], p[2]) for p in edges])
    order = np.argsort(hashes)
    ranked = hashes[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    least = np.minimum.reduceat(docs[order], first)
    repeated = np.empty(len(docs), bool)
    repeated[order] = docs[order] > np.repeat(least, np.diff(np.append(first, len(docs))))
    at = 0
    for doc_ids, marks, counts, starts, _ in edges:
        yield from _rows(doc_ids, marks, counts, starts, repeated[at : at + len(starts)])
        at += len(starts)


def _rows(doc_ids: np.ndarray, marks: np.ndarray, counts: np.ndarray, starts: np.ndarray, keep: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    ends = np.cumsum(counts)
    kept = np.cumsum(np.concatenate(([0], keep)))
    small = starts[keep].astype("<u4")
    low, high = kept[ends - counts], kept[ends]
    for k in np.flatnonzero(high > low):
        yield int(doc_ids[k]), int(marks[k]), small[low[k] : high[k]].tobytes()


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, mark: 0, or a hash of the text where the id stands on several rows."""
    source = fields_for(docs, "doc_id", "text")
    several = checkpoint(source.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select("doc_id"))
    if several.isEmpty():
        return source.withColumn("mark", F.lit(0).cast("long"))
    met = source.join(hinted(several.withColumn("__several", F.lit(True))), "doc_id", "left")
    return met.select("doc_id", "text", F.when(F.col("__several"), F.xxhash64("text")).otherwise(F.lit(0)).cast("long").alias("mark"))


def bucket_number(docs: DataFrame) -> int:
    return max(24, math.ceil(input_megabytes(docs.where("doc_id is not null and text is not null").select("doc_id", "text")) / BUCKET_MB))


def repeated_windows(docs: DataFrame, k: int = K, buckets: int | None = None) -> DataFrame:
    """doc_id, mark, starts (packed 32-bit numbers of first words) of the windows that an earlier document has too;
    several rows for a document. ``docs``: doc_id, text, mark."""
    source = docs.where("doc_id is not null and text is not null").select("doc_id", "mark", "text")
    buckets = buckets or bucket_number(source)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()

        def flush(ids: list[tuple[int, int]], words: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            by_id = sorted(range(len(ids)), key=ids.__getitem__)
            both = np.array([ids[i] for i in by_id], np.int64)
            rows = list(chunk_blocks(both[:, 0], both[:, 1], [words[i] for i in by_id], buckets, k))
            for at in range(0, len(rows), 64):
                part = rows[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.binary())], ["bucket", "block"])

        ids, words, n = [], [], 0
        for b in batches:
            for doc_id, mark, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids.append((doc_id, mark))
                words.append(cache.of(utf8(text.as_py()).split()))
                n += len(words[-1])
                if n >= CHUNK_WINDOWS:
                    yield from flush(ids, words)
                    ids, words, n = [], [], 0
        if ids:
            yield from flush(ids, words)

    def reduce(group: pa.Table) -> pa.Table:
        rows = list(repeated_of_bucket([x.as_buffer() for x in group.column("block")]))
        return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "mark": pa.array([r[1] for r in rows], pa.int64()), "starts": pa.array([r[2] for r in rows], pa.binary())})

    blocks = source.mapInArrow(edges, "bucket int, block binary")
    return blocks.groupBy("bucket").applyInArrow(reduce, "doc_id long, mark long, starts binary")


def covered_words(n_words: int, starts: list[bytes], k: int = K) -> np.ndarray:
    """Mask of the words that the compacted paths cover."""
    edge = np.zeros(n_words + 1, np.int32)
    for s in starts:
        at = np.frombuffer(s, "<u4").astype(np.int64)
        at = at[at + k <= n_words]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + k, -1)
    return np.cumsum(edge[:-1]) > 0


def paths(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal covered runs [first word, end)."""
    change = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(change[::2].tolist(), change[1::2].tolist(), strict=True))


def substring_dedup(docs: DataFrame, k: int = K, buckets: int | None = None, keep_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, spans (removed runs of words) and, if
    ``keep_text``, the kept words joined by one space."""
    source = marked(docs)
    found = repeated_windows(source, k, buckets or bucket_number(docs)).groupBy("doc_id", "mark").agg(F.collect_list("starts").alias("starts"))
    joined = source.join(found, ["doc_id", "mark"], "left").select("doc_id", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"] + ["kept_text"] * keep_text
        for b in batches:
            out = []
            for text, starts in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                words = utf8(text.as_py()).split()
                mask = covered_words(len(words), starts or [], k)
                if mask.any():
                    kept = b" ".join([w for w, gone in zip(words, mask.tolist(), strict=True) if not gone])
                else:
                    kept = b" ".join(words)
                spans = [{"first": a, "end": z} for a, z in paths(mask)] if starts else []
                out.append((len(words), int(mask.sum()), hashlib.sha256(kept).hexdigest(), spans, kept.decode("utf-8", "replace") if keep_text else None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            kinds = [pa.int64(), pa.int64(), pa.string(), span] + [pa.string()] * keep_text
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols[: len(kinds)], kinds, strict=True)]], names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:long,end:long>>" + ", kept_text string" * keep_text
    return joined.mapInArrow(run, schema)
