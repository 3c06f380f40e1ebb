"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Vectors live on the words and stems that tell the labels apart (likelihood-ratio test against the number of words tried, so
that a larger vocabulary needs stronger evidence). Labelled examples are kept in an inverted index whose postings
are cut into blocks of examples with the largest weight of each word in each block; a query visits blocks in the
order of their upper bounds and stops when no block left can beat its k-th neighbour, so the neighbours are exact.
Neighbours vote by their cosine; the votes are calibrated by isotonic regression of the examples' own labels on
their leave-one-out votes. Evidence: the words of the query and the ids of its neighbours.

The examples are a bounded sample: MAX_TRAIN labelled ids, those that hash lowest, with one text each. The vocabulary is
all words and stems of these texts that pass the test, so index and broadcast are bounded by the sample. Every document is
scored, in one pass without a shuffle.

Edge cases: of several texts under one labelled id the smallest is the example; null or empty texts and texts without a telling word get the rate of toxic examples without one;
without labels of both classes the score is the rate of label 1 (0 without labels); rows are scored one by one; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, crc_remainder, fields_for

MAX_TRAIN = 20_000
NEIGHBOURS, BLOCK = 15, 128
#: A stem is used only if at least this share of the examples that have it are toxic.
STEM_PURITY = 0.9
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")


def text_words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(word: str) -> list[str]:
    """A word and its stems (first 4 to 6 letters, marked by a star), so that inflected forms support each other."""
    return [word, *[word[:k] + "*" for k in (4, 5, 6) if len(word) > k]]


class FeatureCounts(dict):
    """word -> its features among the model's; bounded in memory, exact beyond the bound."""

    def __init__(self, known) -> None:
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> tuple[str, ...]:
        found = tuple(f for f in features(word) if f in self.known)
        if len(self) < CACHE_WORDS:
            self[word] = found
        return found

    def of(self, text: str | None) -> dict[str, int]:
        out: dict[str, int] = {}
        for word, n in Counter(text_words(text)).items():
            for f in self[word]:
                out[f] = out.get(f, 0) + n
        return out


def telling(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Likelihood-ratio statistic (half of G) of documents with a word, a toxic and b others, of n1 and n0."""
    def part(k: np.ndarray, n: int, p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    both = (a + b) / (n1 + n0)
    return part(a, n1, a / n1) + part(b, n0, b / n0) - part(a, n1, both) - part(b, n0, both)


class BlockMaxIndex:
    """Exact top-k cosine over sparse unit vectors. ``vectors``: one {word number: weight} for each example."""

    def __init__(self, vectors: list[dict[int, float]], labels: np.ndarray, ids: np.ndarray, n_words: int) -> None:
        self.labels, self.ids, self.n = labels, ids, len(vectors)
        blocks = max(1, -(-self.n // BLOCK))
        self.bound = np.zeros((n_words, blocks), np.float32)
        postings: dict[tuple[int, int], tuple[list, list]] = {}
        for i, v in enumerate(vectors):
            for w, x in v.items():
                at = postings.setdefault((w, i // BLOCK), ([], []))
                at[0].append(i % BLOCK)
                at[1].append(x)
                self.bound[w, i // BLOCK] = max(self.bound[w, i // BLOCK], np.float32(x))
        self.bound *= np.float32(1.000001)  # an upper bound in spite of rounding
        self.postings = {k: (np.array(p), np.array(x)) for k, (p, x) in postings.items()}

    def nearest(self, query: dict[int, float], k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine above 0; ties go to the lower example number."""
        words, weights = list(query), np.fromiter(query.values(), float, len(query))
        upper = weights @ self.bound[words]
        found, scores = np.empty(0, np.int64), np.empty(0)
        for block in np.argsort(-upper, kind="stable"):
            if upper[block] <= 0 or len(scores) == k and upper[block] < scores[-1]:
                break
            here = np.zeros(BLOCK)
            for w, x in query.items():
                if (p := self.postings.get((w, block))) is not None:
                    here[p[0]] += x * p[1]
            at = np.flatnonzero(here > 0)
            new = at + block * BLOCK
            at, new = at[new != without], new[new != without]
            found, scores = np.concatenate((found, new)), np.concatenate((scores, here[at]))
            best = np.lexsort((found, -np.round(scores, 12)))[:k]
            found, scores = found[best], scores[best]
        return found, scores


def isotonic(votes: np.ndarray, labels: np.ndarray, prior: np.ndarray, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; every pool is drawn to its mean prior with the weight of ``strength`` rows."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []  # [sum of labels, rows, sum of votes, sum of priors]
    for row in zip(labels[order], np.ones(len(votes)), votes[order], prior[order], strict=True):
        pools.append(list(row))
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + strength * p[3] / p[1]) / (p[1] + strength) for p in pools])


class Scorer:
    """Everything that a query needs; built on the driver from the bounded sample."""

    def __init__(self, examples: list[tuple[int, int, dict[str, int]]], words: dict[str, float], rate: float) -> None:
        self.words = {w: i for i, w in enumerate(sorted(words))}
        self.idf = np.array([words[w] for w in sorted(words)])
        vectors, labels, ids, bare = [], [], [], []
        for doc_id, toxic, counts in examples:
            v = self.vector(counts)
            if v:
                vectors.append(v)
                labels.append(toxic)
                ids.append(doc_id)
            else:
                bare.append(toxic)
        self.index = BlockMaxIndex(vectors, np.array(labels, float), np.array(ids, np.int64), len(self.words))
        self.prior = (float(self.index.labels.sum()) + rate) / (len(labels) + 1)
        self.default = (sum(bare) + rate) / (len(bare) + 1)
        self._calibrate(vectors)

    def vector(self, counts: dict[str, int]) -> dict[int, float]:
        raw = {self.words[w]: (1 + np.log(c)) * self.idf[self.words[w]] for w, c in counts.items() if w in self.words}
        norm = np.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()} if norm else {}

    def vote(self, vector: dict[int, float], without: int = -1) -> tuple[float, np.ndarray]:
        at, cosine = self.index.nearest(vector, without=without)
        weight = cosine**2
        return float((weight @ self.index.labels[at] + self.prior) / (weight.sum() + 1)), at

    def _calibrate(self, vectors: list[dict[int, float]]) -> None:
        """Isotonic curves over the leave-one-out votes: for all examples, and apart for 1, 2 and more words."""
        votes = np.array([self.vote(v, i)[0] for i, v in enumerate(vectors)])
        sizes = np.array([min(len(v), 3) for v in vectors], int)
        labels = self.index.labels
        self.curve = isotonic(votes, labels, np.full(len(votes), self.prior), 1.0)
        self.curves = {n: isotonic(votes[sizes == n], labels[sizes == n], self._on(self.curve, votes[sizes == n]), 3.0) for n in (1, 2, 3) if (sizes == n).any()}

    @staticmethod
    def _on(curve: tuple[np.ndarray, np.ndarray], votes):
        return np.interp(votes, *curve) if len(curve[0]) else votes

    def score(self, counts: dict[str, int]) -> tuple[float, list[str], list[int]]:
        v = self.vector(counts)
        if not v:
            return self.default, [], []
        vote, at = self.vote(v)
        x = float(self._on(self.curves.get(min(len(v), 3), self.curve), vote))
        return min(max(x, 0.0), 1.0), sorted(w for w in counts if w in self.words), self.index.ids[at].tolist()


def fit_scorer(docs: DataFrame, labels: DataFrame, holdout: int, remainder: int, max_train: int = MAX_TRAIN) -> Scorer | None:
    chosen = (
        fields_for(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(crc_remainder("doc_id", holdout) != remainder)
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )
    # at most max_train pairs of numbers: a proven bound for the broadcast; one text for each, whatever is repeated
    picked = fields_for(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        toxic: Counter = Counter()
        rows = positive = 0
        for b in batches:
            for y, text in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                mine = {f for word in set(text_words(text.as_py())) for f in features(word)}
                seen.update(mine)
                rows, positive = rows + 1, positive + y
                if y:
                    toxic.update(mine)
        seen[""], toxic[""] = rows, positive
        keys = list(seen)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([seen[w] for w in part], pa.int64()), pa.array([toxic[w] for w in part], pa.int64())], ["word", "seen", "toxic"])

    counts = picked.mapInArrow(words_of, "word string, seen long, toxic long").groupBy("word").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))
    counts = counts.agg(
        F.max(F.when(F.col("word") == "", F.struct("seen", "toxic"))).alias("all"), F.count("*").alias("tried"),
        F.collect_list(F.when((F.col("word") != "") & (F.col("toxic") >= 2) & (F.col("toxic") * 4 >= F.col("seen")), F.struct("word", "seen", "toxic"))).alias("words"),
    ).first()  # words that are seen in a sample of max_train texts and lean to the label
    if counts is None or counts["all"] is None or not counts["all"]["seen"]:
        return None
    n, n1 = counts["all"]["seen"], counts["all"]["toxic"]
    if not n1 or n1 == n:
        return Scorer([], {}, n1 / n)
    a = np.array([w["toxic"] for w in counts["words"]], float)
    b = np.array([w["seen"] for w in counts["words"]], float) - a
    value = telling(a, b, n1, n - n1) if len(a) else a
    stem = np.array([w["word"].endswith("*") for w in counts["words"]], bool)
    keep = np.flatnonzero((value > np.log(max(counts["tried"], 2)) + 2.0) & (a / n1 > b / (n - n1)) & (~stem | (a >= STEM_PURITY * (a + b))))
    words = {counts["words"][i]["word"]: float(np.log(1 + n / counts["words"][i]["seen"])) for i in keep}

    def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = FeatureCounts(words)
        for b in batches:
            found = [counter.of(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))], ["doc_id", "toxic", "words", "counts"])

    rows = picked.mapInArrow(vectors_of, "doc_id long, toxic int, words array<string>, counts array<long>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["words"]))
    return Scorer([(r["doc_id"], r["toxic"], dict(zip(r["words"], r["counts"], strict=True))) for r in rows], words, n1 / n)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, holdout: int = 3, remainder: int = 1, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence_words, evidence_ids (nearest labelled examples)."""
    scorer = fit_scorer(docs, labels, holdout, remainder, max_train)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        counter = FeatureCounts(scorer.words if scorer else {})
        for b in batches:
            out = []
            for text in b.column(2):
                if scorer is None:
                    out.append((0.0, 0, [], []))
                    continue
                s, words, ids = scorer.score(counter.of(text.as_py()))
                out.append((s, int(s >= threshold), words, ids))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.float64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["doc_id", "held_out", "score", "predicted", "evidence_words", "evidence_ids"])

    source = fields_for(docs, "doc_id", "text").select("doc_id", (crc_remainder("doc_id", holdout) == remainder).alias("held_out"), "text")
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence_words array<string>, evidence_ids array<long>")
