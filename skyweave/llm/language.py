"""Language identification as multilingual mixture inference.

Training counts hashed character-level n-grams (three bytes of lower-case letters, words apart by one space) for
every language. A document is a mixture: expectation-maximisation estimates the proportion of each language from
the n-gram likelihoods, then the set of languages is the one with the best penalised likelihood (one more language
must gain more than half the log of the number of n-grams).

The model is a table of SLOTS x languages, 128 kB for each distinct value of ``lang``, whatever the size of the corpus;
counts are summed by a shuffle on (language, block of slots). All languages are learned, and the selected set has as many
as the penalised likelihood wants.

Edge cases: null texts and texts without a letter (Unicode category L) are ``und`` with score 0; without any training
document everything is ``und``; rows are handled one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import crc_remainder, fields_for

SLOTS = 1 << 15
#: Rounds of expectation-maximisation end when no proportion moves by more than TOLERANCE.
ROUNDS, TOLERANCE = 500, 1e-4
#: Counts of so many languages are held in one task before they are sent on.
HELD = 64
_BLOCK = 2048
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def ngrams(text: str | None) -> np.ndarray:
    """Slot of every n-gram of a text; none if it has no letter."""
    clean = _NOT_LETTERS.sub(" ", text or "").lower().strip()
    if not any(map(str.isalpha, clean)):  # letters; the pattern lets other numerals through
        return np.empty(0, np.int64)
    a = np.frombuffer(f" {clean} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    code = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def mixture(log_p: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``log_p`` (n-grams x languages) and the log-likelihood of the counts."""
    p = np.exp(log_p - log_p.max(1, keepdims=True))
    share = np.full(p.shape[1], 1 / p.shape[1])
    weights = counts / counts.sum()
    for _ in range(rounds):
        new = share * (p.T @ (weights / np.maximum(p @ share, 1e-300)))
        done = np.abs(new - share).max() < TOLERANCE
        share = new
        if done:
            break
    return share, float(counts @ (np.log(p @ share + 1e-300) + log_p.max(1)))


def identify(slots: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(languages of the selected set, their proportions), largest first. ``model``: log P(n-gram | language)."""
    kinds, counts = np.unique(slots, return_counts=True)
    log_p, counts = model[kinds].astype(float), counts.astype(float)
    single = counts @ log_p
    if log_p.shape[1] == 1:
        return np.array([0]), np.array([1.0])
    share, _ = mixture(log_p, counts)
    order = np.argsort(-share, kind="stable")
    best = (np.array([single.argmax()]), np.array([1.0]))
    # overlapping n-grams say the same thing three times over
    best_value = single.max() / 3
    for m in range(2, len(order) + 1):
        chosen = order[:m]
        part, value = mixture(log_p[:, chosen], counts)
        value = value / 3 - 0.5 * (m - 1) * np.log(max(counts.sum() / 3, 2.0)) - 2.0 * (m - 1)
        if value <= best_value:
            break
        by = np.argsort(-part, kind="stable")
        best, best_value = (chosen[by], part[by]), value
    return best


def fit_language_model(docs: DataFrame) -> tuple[list[str], np.ndarray] | None:
    """Languages and log P(n-gram | language) from all rows of ``docs`` (text, lang)."""
    source = fields_for(docs, "text", "lang").where("text is not null and lang is not null")
    names = ["lang", "block", "counts"]

    def blocks(lang: str, counts: np.ndarray) -> pa.RecordBatch:
        parts = counts.astype("<i8").reshape(-1, _BLOCK)
        at = np.flatnonzero(parts.any(1))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array([zlib.compress(parts[k].tobytes(), 1) for k in at], pa.binary())], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                slots = ngrams(text.as_py())
                if not len(slots):
                    continue
                if lang not in total:
                    if len(total) >= HELD:
                        yield from (blocks(k, v) for k, v in total.items())
                        total = {}
                    total[lang] = np.zeros(SLOTS, np.int64)
                np.add.at(total[lang], slots, 1)
        yield from (blocks(k, v) for k, v in total.items())

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(_BLOCK, np.int64)
        for x in group.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), "<i8")
        return pa.table({"lang": group.column("lang").slice(0, 1), "block": group.column("block").slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "lang string, block int, counts binary"
    rows = source.mapInArrow(count, schema).groupBy("lang", "block").applyInArrow(add, schema).collect()  # languages x SLOTS numbers at most
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    number = {lang: i for i, lang in enumerate(langs)}
    model = np.full((SLOTS, len(langs)), 0.1, np.float32)
    for r in rows:
        model[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK, number[r["lang"]]] += np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    model = np.log(model / model.sum(0, dtype=np.float64), dtype=np.float32, casting="same_kind") if len(langs) else model
    return langs, model.astype(np.float32)


def identify_languages(docs: DataFrame, holdout: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score (its share of the document), languages and shares of the selected set.

    Learns from text and lang of the rows whose crc32 of the id modulo ``holdout`` is not ``remainder``.
    """
    source = fields_for(docs, "doc_id", "text", "lang").withColumn("held_out", crc_remainder("doc_id", holdout) == remainder)
    fitted = fit_language_model(source.where("not held_out"))
    langs, model = fitted or ([], np.zeros((SLOTS, 0)))
    shared = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32, copy=False))  # SLOTS x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p = shared.value
        for b in batches:
            out = []
            for text in b.column(2):
                slots = ngrams(text.as_py())
                if not len(slots) or not langs:
                    out.append(("und", 0.0, [], []))
                    continue
                chosen, share = identify(slots, log_p)
                out.append((langs[chosen[0]], float(min(max(share[0], 0.0), 1.0)), [langs[c] for c in chosen], share.tolist()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["doc_id", "held_out", "lang_pred", "score", "languages", "shares"])

    return source.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>")
