"""Packing: bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document gives full windows first; its remainder goes to
the open window where it fits best. When it fits in none, the fullest window is completed with the head of the
piece (documents may be cut) and emitted, and the rest is placed again. At the end the leftovers of a partition
are merged, and what is left under one window is cut at powers of two, which need no padding. No shuffle: memory
is bounded by the open windows and one Arrow batch.

Edge cases: a null or empty text is the single end id 0; repeated rows are packed one by one; an empty table
gives an empty result. Sequence numbers hold the partition number in their upper bits.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import fields_for

SEQ_LEN = 1024
OPEN_WINDOWS = 32
TOKENIZER = "byte_bpe_50k.tiktoken"
#: The added tokens of byte_bpe_50k.json, which the rank file lacks.
ADDED = {"<|endoftext|>": 50256}
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ENCODERS: dict[str, Callable] = {}


#: Runs of white space (Unicode White_Space) beyond which the pattern's look-ahead would exhaust the stack of its engine.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def _without_long_space(encode: Callable[[str], list[int]], piece: Callable[[str], list[int]]) -> Callable[[str], list[int]]:
    """``encode`` with long runs of white space cut out by the pattern's own rule: a run is one piece, without its last
    character if text follows, which starts with that character."""

    def run(text: str) -> list[int]:
        out, at = [], 0
        for m in _LONG_SPACE.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            if m.start() > at:
                out += encode(text[at : m.start()])
            out += piece(text[m.start() : end])
            at = end
        return out + encode(text[at:]) if at else encode(text)

    return run


def encoder(path: str | None = None, added: dict[str, int] | None = None) -> Callable[[str], list[int]]:
    """``path``: a rank file of a byte-level BPE; the default holds the same vocabulary as byte_bpe_50k.json, and
    gives the same ids (see the tests) several times faster. Strings of ``added`` tokens get their ids; without any,
    they are ordinary text."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path(TOKENIZER)
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        whole = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _ENCODERS[path] = _without_long_space(whole.encode_ordinary, whole._encode_single_piece)
    ordinary = _ENCODERS[path]
    if not added:
        return ordinary
    parts = re.compile("(" + "|".join(map(re.escape, added)) + ")")

    def encode(text: str) -> list[int]:
        if not any(a in text for a in added):
            return ordinary(text)
        return [i for p in parts.split(text) for i in ([added[p]] if p in added else ordinary(p))]

    return encode


def document_encoder(path: str | None = None) -> Callable[[str], list[int]]:
    """Ids of a document as ``tokenizers`` gives them with byte_bpe_50k.json; a vocabulary of one's own has no added tokens."""
    return encoder(path, None if path else ADDED)


class Packer:
    """Online packing of (doc_id, ids) into windows of ``size`` with at most ``windows`` open at a time.

    ``done`` collects finished pieces (doc_id, start, length, crc, doc_tokens, sequence, offset).
    """

    def __init__(self, size: int = SEQ_LEN, windows: int = OPEN_WINDOWS, first: int = 0) -> None:
        self.size, self.windows, self.next = size, windows, first
        self.open: list[tuple[int, list]] = []  # (fill, pieces), pieces: (doc_id, start, ids, doc_tokens)
        self.done: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.done.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.size:
            self._emit([(doc_id, at, ids[at : at + self.size], total)])
            at += self.size
        if at < total:
            self._place((doc_id, at, ids[at:], total))

    def _place(self, piece: tuple) -> None:
        doc_id, start, ids, total = piece
        room, best = self.size + 1, -1
        for k, (fill, _) in enumerate(self.open):
            left = self.size - fill
            if len(ids) <= left < room:
                room, best = left, k
        if best >= 0:
            fill, pieces = self.open[best]
            pieces.append(piece)
            if fill + len(ids) == self.size:
                self.open.pop(best)
                self._emit(pieces)
            else:
                self.open[best] = (fill + len(ids), pieces)
        elif len(self.open) < self.windows:
            self.open.append((len(ids), [piece]))
        else:
            k = max(range(len(self.open)), key=lambda i: self.open[i][0])
            fill, pieces = self.open.pop(k)
            head = self.size - fill
            self._emit([*pieces, (doc_id, start, ids[:head], total)])
            self._place((doc_id, start + head, ids[head:], total))

    def finish(self) -> None:
        """Merge the leftovers; the last window is cut at powers of two."""
        rest = [p for _, pieces in sorted(self.open, key=lambda w: -w[0]) for p in pieces]
        self.open = []
        left = sum(len(p[2]) for p in rest)
        while left:
            want = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left -= want
            pieces = []
            while want:
                doc_id, start, ids, total = rest.pop(0)
                pieces.append((doc_id, start, ids[:want], total))
                if len(ids) > want:
                    rest.insert(0, (doc_id, start + want, ids[want:], total))
                want -= min(want, len(ids))
            self._emit(pieces)

    def take(self) -> pa.RecordBatch | None:
        if not self.done:
            return None
        columns, self.done = list(zip(*self.done, strict=True)), []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in SCHEMA.split(", ")])


def pack_documents(docs: DataFrame, size: int = SEQ_LEN, windows: int = OPEN_WINDOWS, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = document_encoder(tokenizer_path)
        context = TaskContext.get()
        packer = Packer(size, windows, first=(context.partitionId() if context else 0) << 40)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(0)
                packer.add(doc_id, np.array(ids, "<u4"))
                if len(packer.done) >= 20_000:
                    yield packer.take()
        packer.finish()
        if (last := packer.take()) is not None:
            yield last

    return fields_for(docs, "doc_id", "text").mapInArrow(run, SCHEMA)
