"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; every node (context of 0..DEPTH bytes, bits of the byte so far) keeps counts of
zeros and ones with a Krichevsky-Trofimov estimate. Weighting mixes a node's own estimate with its children's by
their evidence: Pw = (Pe + product of the children's Pw) / 2. Counts are exchangeable under KT, so Pe and Pw of
the whole training corpus follow from the counts alone, and a frozen tree scores a byte with the posterior mix of
the estimates on its path. A context that training never showed inherits from its longest known suffix.

Nothing of the size of the model is ever collected or broadcast. Documents are dealt into groups; a group asks for
what it needs (its distinct words and its distinct byte strings of DEPTH + 1) and says how often it trains them.
Requests meet in buckets (of word hashes, or of the last two context bytes), which sum the counts of the whole
corpus, weight their part of the tree and answer each group in the order of its request. Only the top of the tree,
contexts of 0 or 1 bytes, is joined on the driver: at most 65,792 nodes whatever the corpus.

Edge cases: a null or empty text is just its end symbol; words and bytes never seen in training get their smoothed
share; without any training document every estimate is the prior (one half for a bit); rows are scored one by one, so
repeated rows get the same scores; a null doc_id counts as an empty id for the split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, checkpoint, crc_remainder, fields_for, utf8
from .substring import input_megabytes

DEPTH = 5
END = 0xFF  # never a byte of UTF-8: end of text, and the context before its first byte
#: MB of compressed input for one group of documents.
GROUP_MB = 6
_LOG_HALF = math.log(0.5)
_LOG_PI = math.log(math.pi)


# ------------------------------------------------------------------ binary context trees


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: Stirling's series after a shift to 8 and above."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    small = x < 8
    if small.any():
        y = x[small]
        p = np.ones_like(y)
        for _ in range(8):
            p *= y
            y = y + 1
        shift[small] = np.log(p)
        x = np.where(small, x + 8, x)
    i = 1 / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + i * (1 / 12 - i * i * (1 / 360 - i * i / 1260)) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log probability of a block of n0 zeros and n1 ones under the KT estimate."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - _LOG_PI


def byte_strings(raw: bytes, depth: int = DEPTH) -> np.ndarray:
    """A code for each byte and the end: the last context byte uppermost, then older ones, the byte itself lowest."""
    a = np.frombuffer(bytes([END]) * depth + raw + bytes([END]), np.uint8).astype(np.uint64)
    n = len(raw) + 1
    code = a[depth - 1 : depth - 1 + n]
    for back in range(2, depth + 1):
        code = (code << np.uint64(8)) | a[depth - back : depth - back + n]
    return (code << np.uint64(8)) | a[depth : depth + n]


class Subtree:
    """Contexts of ``top`` to ``depth`` bytes, all from the sorted ``codes`` with their training counts.

    For each depth: the entries (context, byte), for each of 8 bits the node of an entry, and per node n0, n1.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int = DEPTH, top: int = 2) -> None:
        self.depth, self.top, self.levels = depth, top, {}
        symbol = codes & np.uint64(0xFF)
        context = codes >> np.uint64(8)
        parent = None
        weights = counts.astype(float)
        for d in range(depth, top - 1, -1):
            if d < depth:  # shorten the context by its oldest byte and merge
                key = ((context >> np.uint64(8)) << np.uint64(8)) | symbol
                key, parent = np.unique(key, return_inverse=True)
                self.levels[d + 1]["parent"] = parent
                weights = np.bincount(parent, weights, len(key))
                context, symbol = key >> np.uint64(8), key & np.uint64(0xFF)
            self.levels[d] = {"entries": len(symbol), "bits": self._bits(context, symbol, weights)}
        self._weigh()

    @staticmethod
    def _bits(context: np.ndarray, symbol: np.ndarray, weights: np.ndarray) -> list[tuple]:
        out = []
        for k in range(8):
            node = (context << np.uint64(8)) | (symbol >> np.uint64(8 - k))  # sorted, as entries are by context and byte
            first = np.concatenate(([True], node[1:] != node[:-1]))
            of = np.cumsum(first) - 1
            bit = ((symbol >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
            both = np.bincount(of * 2 + bit, weights, 2 * (of[-1] + 1 if len(of) else 0)).reshape(-1, 2)
            out.append((of, both[:, 0], both[:, 1], np.flatnonzero(first)))
        return out

    def _weigh(self) -> None:
        self.weight = {}
        for k in range(8):
            below = None
            for d in range(self.depth, self.top - 1, -1):
                of, n0, n1, first = self.levels[d]["bits"][k]
                pe = log_kt(n0, n1)
                if d == self.depth:
                    pw = pe
                    alpha = np.ones_like(pe)
                else:
                    low = self.levels[d + 1]
                    up = of[low["parent"][low["bits"][k][3]]]  # node of each node below
                    pw = _LOG_HALF + np.logaddexp(pe, np.bincount(up, below, len(pe)))
                    alpha = np.exp(_LOG_HALF + pe - pw)
                below = pw
                self.weight[d, k] = (alpha, pw)

    def deep_bits(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each bit: (bit, probability of a one at every deepest entry, whether any node on its path was trained)."""
        for k in range(8):
            at = np.arange(self.levels[self.depth]["entries"])
            path = []
            for d in range(self.depth, self.top - 1, -1):
                of, n0, n1, _ = self.levels[d]["bits"][k]
                node = of[at]
                path.append((n0[node], n1[node], self.weight[d, k][0][node]))
                if d > self.top:
                    at = self.levels[d]["parent"][at]
            p = np.full(len(path[0][0]), np.nan)
            for n0, n1, alpha in path:
                p = mix_in(p, n0, n1, alpha)
            yield k, p, ~np.isnan(p)


def mix_in(deeper: np.ndarray, n0: np.ndarray, n1: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """One step up the path: an untrained node changes nothing, the deepest trained node stands alone."""
    own = (n1 + 0.5) / (n0 + n1 + 1.0)
    return np.where(n0 + n1 == 0, deeper, np.where(np.isnan(deeper), own, alpha * own + (1 - alpha) * deeper))


def heap_node(symbol: np.ndarray, k: int) -> np.ndarray:
    """Number 1..255 of the node that bit ``k`` of a byte is decided at."""
    return (1 << k) | (symbol >> (8 - k))


def weigh_top(nodes: pd.DataFrame) -> dict[str, np.ndarray]:
    """Contexts of one and of no byte from (last, node, n0, n1, below): counts, and how much of the mix is their own."""
    n = np.zeros((2, 256, 256))
    below = np.zeros((256, 256))
    at = nodes["last"].to_numpy(), nodes["node"].to_numpy()
    n[0][at], n[1][at], below[at] = nodes["n0"].to_numpy(), nodes["n1"].to_numpy(), nodes["below"].to_numpy()
    pe = log_kt(n[0], n[1])
    pw = _LOG_HALF + np.logaddexp(pe, below)
    pw = np.where(n.sum(0) == 0, 0.0, pw)
    root0, root1 = n[0].sum(0), n[1].sum(0)
    pe0 = log_kt(root0, root1)
    pw0 = _LOG_HALF + np.logaddexp(pe0, pw.sum(0))
    return {"n0": n[0], "n1": n[1], "alpha": np.exp(np.minimum(0, _LOG_HALF + pe - pw)), "root0": root0, "root1": root1, "root_alpha": np.exp(_LOG_HALF + pe0 - pw0)}


def log10_bytes(tree: Subtree, codes: np.ndarray, top: dict[str, np.ndarray]) -> np.ndarray:
    """log10 of the probability of the last byte of every code, given its context."""
    symbol = (codes & np.uint64(0xFF)).astype(np.int64)
    last = (codes >> np.uint64(8 * tree.depth)).astype(np.int64) & 0xFF
    total = np.zeros(len(codes))
    for k, p, _ in tree.deep_bits():
        node = heap_node(symbol, k)
        p = mix_in(p, top["n0"][last, node], top["n1"][last, node], top["alpha"][last, node])
        p = mix_in(p, top["root0"][node], top["root1"][node], top["root_alpha"][node])
        p = np.where(np.isnan(p), 0.5, p)
        bit = (symbol >> (7 - k)) & 1
        total += np.log10(np.where(bit == 1, p, 1 - p))
    return total


# ------------------------------------------------------------------ lookup of many codes


class CodeIndex:
    """Position of each code in a sorted array of distinct codes; open addressing, all steps on whole arrays."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = max(4, int(4 * max(len(keys), 1) - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = self._slot(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            placed = self.slots[at] == left
            left, at = left[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Every code must be among the keys."""
        at = self._slot(codes)
        found = self.slots[at]
        wrong = np.flatnonzero(self.keys[found] != codes)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            found[wrong] = self.slots[at[wrong]]
            wrong = wrong[self.keys[found[wrong]] != codes[wrong]]
        return found


# ------------------------------------------------------------------ requests, buckets, answers

_PIECE = 2_000_000  # bytes whose strings a group sorts at a time


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of several (keys, counts), with the sums of their counts."""
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], (np.add.reduceat(counts, first) if len(first) else counts)


def _counted(arrays: list[np.ndarray], trained: list[bool]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys of the arrays; the count is over the training ones alone."""
    out = []
    for yes in (True, False):
        mine = [a for a, t in zip(arrays, trained, strict=True) if t is yes]
        if mine:
            keys, counts = np.unique(np.concatenate(mine), return_counts=True)
            out.append((keys, counts if yes else np.zeros(len(keys), np.int64)))
    return out


def group_request(texts: list[str | None], trains: list[bool], hashes: WordHashes, depth: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct word hashes and byte strings of a group of documents, with their training counts."""
    parts: dict[str, list] = {"w": [], "b": []}
    held: dict[str, list] = {"w": [], "b": []}
    flags: list[bool] = []
    size = 0

    def flush() -> None:
        for what in "wb":
            parts[what] += _counted(held[what], flags)
            held[what].clear()
        flags.clear()

    for text, yes in zip(texts, trains, strict=True):
        raw = utf8(text).lower()
        held["w"].append(hashes.of(raw.split()))
        held["b"].append(byte_strings(raw, depth))
        flags.append(yes)
        size += len(raw)
        if size >= _PIECE:
            flush()
            size = 0
    flush()
    return {what: _merge(parts[what]) for what in "wb"}


def bucket_of(what: str, keys: np.ndarray, buckets: int, depth: int) -> np.ndarray:
    if what == "w":
        return (keys % np.uint64(buckets)).astype(np.int64)
    two = keys >> np.uint64(8 * (depth - 1))  # the last two context bytes: whole subtrees stay together
    return ((two * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(what: str, keys: np.ndarray, buckets: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = bucket_of(what, keys, buckets, depth)
    return np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=buckets))


def _array(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(data, kind)


def score_documents(docs: DataFrame, depth: int = DEPTH, holdout: int = 10, groups: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability) and
    bits_per_byte (code length of the text with its end, for each byte).

    Documents whose crc32 of the id modulo ``holdout`` is 0 are never trained on.
    """
    source = fields_for(docs, "doc_id", "text")
    groups = groups or max(12, math.ceil(input_megabytes(source) / GROUP_MB))
    buckets = groups
    dealt = source.select(
        F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(groups)).cast("int").alias("g"),
        "doc_id", "text", (crc_remainder("doc_id", holdout) == 0).alias("held_out"),
    )

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        request = group_request(table.column("text").to_pylist(), [not h for h in table.column("held_out").to_pylist()], WordHashes(), depth)
        rows = []
        for what, (keys, counts) in request.items():
            order, ends = _by_bucket(what, keys, buckets, depth)
            for b in range(buckets):
                mine = order[ends[b - 1] if b else 0 : ends[b]]
                if len(mine):
                    rows.append((key[0].as_py(), what, b, keys[mine].astype("<u8").tobytes(), counts[mine].astype("<u4").tobytes()))
        cols = list(zip(*rows, strict=True))
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["g", "what", "bucket", "keys", "counts"])

    asked = checkpoint(dealt.groupBy("g").applyInArrow(ask, "g int, what string, bucket int, keys binary, counts binary"))

    def words_of(table: pa.Table) -> pa.Table:
        keys = [_array(x, "<u8") for x in table.column("keys").to_pylist()]
        counts = [_array(x, "<u4").astype(np.int64) for x in table.column("counts").to_pylist()]
        all_keys, total = _merge(list(zip(keys, counts, strict=True)))
        answers = [total[np.searchsorted(all_keys, k)].astype("<i8").tobytes() for k in keys]
        n = len(answers)
        return pa.table(
            {
                "g": table.column("g").combine_chunks(), "what": pa.array(["w"] * n), "bucket": table.column("bucket").combine_chunks(), "answer": pa.array(answers, pa.binary()),
                "tokens": pa.array([int(total.sum())] + [0] * (n - 1), pa.int64()), "distinct": pa.array([int((total > 0).sum())] + [0] * (n - 1), pa.int64()),
            }
        )

    def tree_of(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, Subtree]:
        keys = [_array(x, "<u8") for x in table.column("keys").to_pylist()]
        counts = [_array(x, "<u4").astype(np.int64) for x in table.column("counts").to_pylist()]
        codes, total = _merge(list(zip(keys, counts, strict=True)))
        return keys, codes, Subtree(codes, total, depth)

    def top_of(table: pa.Table) -> pa.Table:
        _, codes, tree = tree_of(table)
        level = tree.levels[2]
        entry = np.unique((codes >> np.uint64(8 * (depth - 1)) << np.uint64(8)) | (codes & np.uint64(0xFF)))
        rows = []
        for k in range(8):
            _, n0, n1, first = level["bits"][k]
            last = (entry[first] >> np.uint64(16)).astype(np.int64) & 0xFF
            slot = last * 256 + heap_node((entry[first] & np.uint64(0xFF)).astype(np.int64), k)
            sums = [np.bincount(slot, v, 65536) for v in (n0, n1, tree.weight[2, k][1])]
            for s in np.unique(slot):
                rows.append((s // 256, s % 256, sums[0][s], sums[1][s], sums[2][s]))
        cols = list(zip(*rows, strict=True))
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], ["last", "node", "n0", "n1", "below"])

    strings = asked.where("what = 'b'")
    top_rows = strings.groupBy("bucket").applyInArrow(top_of, "last long, node long, n0 double, n1 double, below double")
    top = weigh_top(top_rows.groupBy("last", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below")).toPandas())

    def bytes_of(table: pa.Table) -> pa.Table:
        keys, codes, tree = tree_of(table)
        score = log10_bytes(tree, codes, top)
        answers = [score[np.searchsorted(codes, k)].astype("<f8").tobytes() for k in keys]
        n = len(answers)
        zero = pa.array([0] * n, pa.int64())
        return pa.table({"g": table.column("g").combine_chunks(), "what": pa.array(["b"] * n), "bucket": table.column("bucket").combine_chunks(), "answer": pa.array(answers, pa.binary()), "tokens": zero, "distinct": zero})

    answer_schema = "g int, what string, bucket int, answer binary, tokens long, distinct long"
    answers = checkpoint(
        asked.where("what = 'w'").groupBy("bucket").applyInArrow(words_of, answer_schema)
        .unionByName(strings.groupBy("bucket").applyInArrow(bytes_of, answer_schema))
    )
    totals = answers.agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()

    words_n, words_v = totals["tokens"] or 0, totals["distinct"] or 0
    # the end of every training text is a token as well, and one more distinct one if there is any
    trained = source.where(crc_remainder("doc_id", holdout) != 0).count()
    n_total, v_total = words_n + trained, words_v + (1 if trained else 0)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left.column("text").to_pylist()
        hashes = WordHashes()
        request = group_request(texts, [False] * len(texts), hashes, depth)
        given: dict[str, np.ndarray] = {}
        reply = {(w, b): a for w, b, a in zip(*[right.column(c).to_pylist() for c in ("what", "bucket", "answer")], strict=True)}
        for what, (keys, _) in request.items():
            order, ends = _by_bucket(what, keys, buckets, depth)
            value = np.zeros(len(keys))
            for b in range(buckets):
                mine = order[ends[b - 1] if b else 0 : ends[b]]
                if len(mine):
                    value[mine] = _array(reply[what, b], "<i8" if what == "w" else "<f8")
            given[what] = value
        index = {what: CodeIndex(keys) for what, (keys, _) in request.items()}
        scale = math.log10(n_total + 0.1 * (v_total + 1))
        word_score = np.log10(given["w"] + 0.1) - scale
        end_score = math.log10(trained + 0.1) - scale
        out = []
        for text in texts:
            raw = utf8(text).lower()
            at = index["w"].find(hashes.of(raw.split()))
            n = len(at) + 1
            known = int((given["w"][at] > 0).sum()) + (1 if trained else 0)
            base = float(word_score[at].sum()) + end_score
            total = 0.0
            codes = byte_strings(raw, depth)
            for a in range(0, len(codes), _PIECE):
                total += float(given["b"][index["b"].find(codes[a : a + _PIECE])].sum())
            out.append((n, known, n_total, base, total, -total / math.log10(2) / (len(raw) + 1)))
        cols = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        names = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
        columns = [left.column("doc_id").combine_chunks(), left.column("held_out").combine_chunks(), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]]
        return pa.table(columns, ["doc_id", "held_out", *names])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(score, schema)
