"""Quality rules: gradient-boosted trees over document statistics.

The trees are grown here (histogram splits, logistic loss, monotonic constraints), flattened into numpy node
arrays and applied to whole Arrow batches. One pass over the documents, no shuffle.

Edge cases: a null or empty text has all statistics zero and fails the base rule; repeated rows are scored
one by one; an empty table gives an empty result; without any labelled row of both classes the verdict is
"keep" for every document that passes the base rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WordHashes, fields_for, small_batches, utf8, window_hashes

SYMBOLS = b"#*$%&|<>"
#: (feature, constraint): +1 if a larger value may only raise the quality, -1 only lower it, 0 free.
FEATURES = (
    ("log_words", 0), ("mean_word_chars", 0), ("symbol_share", -1), ("dup_line_share", -1), ("repeat_share", -1),
    ("distinct_share", 0), ("upper_share", 0), ("digit_share", 0), ("punct_share", 0), ("words_per_line", 0),
    ("same_as_last_share", -1), ("top_word_share", 0), ("long_word_share", 0), ("stop_share", 0),
)
MONOTONE = np.array([c for _, c in FEATURES])
#: Bound of the labelled sample that the driver fits on.
MAX_TRAIN = 8000
#: A document is rejected when its estimated probability of good quality is below this.
THRESHOLD = 0.35
_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_PUNCT = b".,;:!?"


def document_statistics(text: str | None, hashes: WordHashes) -> tuple[list[int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features."""
    raw = utf8(text)
    words = raw.split()
    n = len(words)
    if not n:
        return [0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0], [0.0] * len(FEATURES)
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    lines = n_dup = 0
    seen: set[str] = set()
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\f\r"):
            lines += 1
            if line in seen:
                n_dup += 1
            else:
                seen.add(line)
    ids = hashes.of(words)
    windows = window_hashes(ids, 3)
    n_repeat = 0
    if len(windows) > 1:
        order = np.argsort(windows)
        ranked = windows[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            twice = np.zeros(len(windows), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            for j in range(3):
                covered[j : n - 2 + j] |= twice
            n_repeat = int(covered.sum())
    ranked = np.sort(ids)
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    runs = np.diff(np.append(starts, n))
    plain = len(raw) == len(text)  # no character of more than a byte
    lengths = np.fromiter(map(len, words) if plain else (len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, n)
    chars = max(len(raw), 1)
    count = lambda what: len(raw) - len(raw.translate(None, what))
    features = [
        float(np.log1p(n)), word_chars / n, n_symbols / chars, n_dup / max(lines, 1), n_repeat / n,
        len(starts) / n, count(_UPPER) / chars, count(_DIGIT) / chars, count(_PUNCT) / n, n / max(lines, 1),
        float((ids[1:] == ids[:-1]).sum()) / n, float(runs.max()) / n, float((lengths > 12).sum()) / n, float((lengths <= 3).sum()) / n,
    ]
    return [n, word_chars, n_symbols, n_dup, n_repeat], features


# ------------------------------------------------------------------ trees


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 1.0, min_rows: int = 20) -> dict:
    """Boosted trees with logistic loss, as flat node arrays (feature, threshold, left, right, value)."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(x.shape[1])], 1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin = np.full(len(y), base)
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []

    def leaf_value(g: float, h: float, low: float, high: float) -> float:
        return float(min(max(-g / (h + l2), low), high))

    def add(value: float) -> int:
        for k, v in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("value", value)):
            nodes[k].append(v)
        return len(nodes["value"]) - 1

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        me = add(rate * leaf_value(g, h, low, high))
        if level == depth or len(rows) < 2 * min_rows:
            return me
        best = (1e-9, -1, -1, 0.0, 0.0)
        for j in range(x.shape[1]):
            k = len(edges[j])
            if not k:
                continue
            b = binned[rows, j]
            gl = np.cumsum(np.bincount(b, grad[rows], k + 1))[:-1]
            hl = np.cumsum(np.bincount(b, hess[rows], k + 1))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=k + 1))[:-1]
            vl = np.clip(-gl / (hl + l2), low, high)
            vr = np.clip(-(g - gl) / (h - hl + l2), low, high)
            gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
            allowed = (nl >= min_rows) & (len(rows) - nl >= min_rows) & (MONOTONE[j] * (vr - vl) >= 0)
            gain = np.where(allowed, gain, -1)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), j, at, float(vl[at]), float(vr[at]))
        if best[1] < 0:
            return me
        _, j, at, vl, vr = best
        go_left = binned[rows, j] <= at
        mid = (vl + vr) / 2
        bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[int(MONOTONE[j])]
        left = grow(rows[go_left], level + 1, *bounds[0])
        right = grow(rows[~go_left], level + 1, *bounds[1])
        nodes["feature"][me], nodes["threshold"][me] = j, float(edges[j][at])
        nodes["left"][me], nodes["right"][me] = left, right
        return me

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        first = grow(np.arange(len(y)), 0, -np.inf, np.inf)
        roots.append(first)
        margin += _walk({k: np.array(v) for k, v in nodes.items()}, np.array([first]), x, depth)
    model = {k: np.array(v) for k, v in nodes.items()}
    return model | {"roots": np.array(roots), "base": base, "depth": depth}


def _walk(nodes: dict, roots: np.ndarray, x: np.ndarray, depth: int) -> np.ndarray:
    """Sum of the leaves that every row of ``x`` reaches, over the given trees."""
    at = np.broadcast_to(roots, (len(x), len(roots))).copy()
    rows = np.arange(len(x))[:, None]
    for _ in range(depth):
        f = nodes["feature"][at]
        inner = f >= 0
        left = x[rows, np.where(inner, f, 0)] <= nodes["threshold"][at]
        at = np.where(inner, np.where(left, nodes["left"][at], nodes["right"][at]), at)
    return nodes["value"][at].sum(1)


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    if not len(x):
        return np.empty(0)
    return 1 / (1 + np.exp(-(model["base"] + _walk(model, model["roots"], x, model["depth"]))))


# ------------------------------------------------------------------ operator

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def fit_quality_model(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> dict | None:
    """Fit on at most ``max_train`` labelled documents: those whose ids hash lowest, so the choice is the same at every run."""
    chosen = (
        fields_for(labels, "doc_id", "quality").where("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )
    # at most max_train rows of two numbers: a proven bound for the broadcast
    picked = fields_for(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            rows = [document_statistics(t, hashes)[1] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(rows, pa.list_(pa.float64()))], ["quality", "x"])

    rows = picked.select("text", F.col("quality").cast("int").alias("quality")).mapInArrow(run, "quality int, x array<double>").toArrow()
    y = np.array(rows.column("quality").to_pylist(), float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array(rows.column("x").to_pylist(), float)
    order = np.lexsort([*x.T[::-1], y])  # the same trees whatever order the rows arrive in
    return fit_trees(x[order], y[order])


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept."""
    model = fit_quality_model(docs, labels, max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            stats = [document_statistics(t, hashes) for t in b.column(1).to_pylist()]
            counts = np.array([s[0] for s in stats], np.int64).reshape(-1, 5)
            good = np.ones(len(stats)) if model is None else predict(model, np.array([s[1] for s in stats], float).reshape(-1, len(FEATURES)))
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            kept = ~failed & (good >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(counts[:, j]) for j in range(5)], pa.array(failed), pa.array(good), pa.array(kept)], ["doc_id", *_COUNTS, "base_failed", "quality", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, quality double, kept boolean"
    return fields_for(docs, "doc_id", "text").mapInArrow(run, schema)


def passing_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that the base rule and the model keep, with all their columns."""
    small_batches(docs)
    model = fit_quality_model(docs, labels, max_train)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            stats = [document_statistics(t, hashes) for t in b.column(at).to_pylist()]
            counts = np.array([s[0] for s in stats], np.int64).reshape(-1, 5)
            good = np.ones(len(stats)) if model is None else predict(model, np.array([s[1] for s in stats], float).reshape(-1, len(FEATURES)))
            yield b.filter(pa.array((counts[:, 0] >= 50) & (100 * counts[:, 4] <= 50 * counts[:, 0]) & (good >= threshold)))

    return docs.mapInArrow(run, docs.schema)
