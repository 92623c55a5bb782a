"""Hierarchical multi-length packing of documents into training sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from wiretally.llm.common import batches, text_bytes
from wiretally.llm.tokenizer import Encoder, default_tokenizer

LONGEST = 4096
SHORTEST = 256
WINDOW_TOKENS = 1 << 21
STEP_TOKENS = 64 * LONGEST
PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
         "sequence_length long, step_group long")


class Packer:
    """Packs documents held in memory (a window of about WINDOW_TOKENS).

    A document gives full sequences of the longest tier; what is left of it is routed to the tier that is the next power
    of two. Tiers are packed from long to short: a left-over opens a sequence of its tier, the gap takes the longest
    shorter left-overs that fit, and the rest of the gap is cut from the shortest left-over that is longer. So every
    sequence is exactly a tier long; only the last tokens of a partition are laid into shorter powers of two."""

    def __init__(self, longest: int = LONGEST, shortest: int = SHORTEST):
        self.longest, self.shortest = longest, shortest
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.left: list[tuple[int, int, int]] = []  # (length, document, start), sorted

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
        self.docs.append((doc_id, ids))
        full = len(ids) // self.longest * self.longest
        for at in range(0, full, self.longest):
            yield [(self.longest, len(self.docs) - 1, at)]
        if full < len(ids):
            insort(self.left, (len(ids) - full, len(self.docs) - 1, full))

    def fill(self, size: int, pieces: list[tuple[int, int, int]]) -> int:
        """Fill up a sequence of ``size`` that holds ``pieces``; the gap that stays when nothing is left."""
        gap = size - sum(p[0] for p in pieces)
        while gap and self.left:
            k = bisect_right(self.left, (gap, len(self.docs), 0)) - 1
            if k >= 0:
                pieces.append(self.left.pop(k))
                gap -= pieces[-1][0]
            else:
                length, doc, start = self.left.pop(0)
                pieces.append((gap, doc, start))
                insort(self.left, (length - gap, doc, start + gap))
                gap = 0
        return gap

    def packed(self, last: bool) -> Iterator[list[tuple[int, int, int]]]:
        """All sequences of the window. What doesn't fill a sequence waits for the next window, unless this is the last."""
        size = self.longest
        while size >= self.shortest and self.left:
            floor = size // 2 if size > self.shortest else 0
            while self.left and self.left[-1][0] > floor:
                pieces = [self.left.pop()]
                if self.fill(size, pieces):
                    self.left = sorted(pieces)
                    if last:
                        yield from self.tail()
                    return
                yield pieces
            size //= 2

    def tail(self) -> Iterator[list[tuple[int, int, int]]]:
        total = sum(x[0] for x in self.left)
        for bit in reversed(range(total.bit_length())):
            if total >> bit & 1:
                pieces: list[tuple[int, int, int]] = []
                self.fill(1 << bit, pieces)
                yield pieces

    def forget(self) -> None:
        """Drop the ids of the documents that are done."""
        kept = sorted({x[1] for x in self.left})
        self.docs = [self.docs[k] for k in kept]
        self.left = [(n, bisect_left(kept, d), s) for n, d, s in self.left]


def step_groups(lengths: list[int], first: int) -> list[int]:
    """Deal sequences, longest first, to and fro over as many groups as their tokens need, so that each training step
    gets the same mix of lengths."""
    groups = max(1, round(sum(lengths) / STEP_TOKENS))
    order = np.argsort(-np.array(lengths), kind="stable")
    out = np.empty(len(lengths), np.int64)
    turn = np.arange(len(lengths)) % (2 * groups)
    out[order] = first + np.minimum(turn, 2 * groups - 1 - turn)
    return out.tolist()


def pack_documents(docs: DataFrame, tokenizer: str | None = None, longest: int = LONGEST, shortest: int = SHORTEST) -> DataFrame:
    """One row per piece. ``sequence_id`` is the input partition in the high bits and a counter in the low 32;
    ``step_group`` likewise. Each task packs its own rows window by window (about WINDOW_TOKENS ids in memory), without a
    shuffle. A null text is the end id alone; repeated rows and null ids are packed like any other; an empty table gives
    no rows; other columns are ignored. A retried task gives the same rows, as its input partition is the same."""
    tokenizer = tokenizer or default_tokenizer()

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, base = Encoder.at(tokenizer), Packer(longest, shortest), TaskContext.get().partitionId() << 32
        held, ready, sequence, group = 0, [], 0, 0

        def out() -> pa.RecordBatch:
            nonlocal ready, sequence, group, held
            lengths = [sum(p[0] for p in pieces) for pieces in ready]
            dealt = step_groups(lengths, group)
            found = []
            for pieces, length, step in zip(ready, lengths, dealt, strict=True):
                offset = 0
                for n, doc, start in pieces:
                    doc_id, ids = packer.docs[doc]
                    found.append((doc_id, start, n, zlib.crc32(ids[start:start + n].tobytes()), len(ids), base + sequence,
                                  offset, length, base + step))
                    offset += n
                sequence += 1
            group, ready, held = max(dealt, default=group - 1) + 1, [], 0
            packer.forget()
            columns = list(zip(*found, strict=True)) or [()] * 9
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in PIECE.split(", ")])

        for batch in batches(rows, 256):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(text_bytes(batch)), strict=True):
                ready.extend(packer.add(doc_id, ids))
                held += len(ids)
                if held >= WINDOW_TOKENS:
                    ready.extend(packer.packed(last=False))
                    yield out()
        ready.extend(packer.packed(last=True))
        yield out()

    return docs.select("doc_id", "text").mapInArrow(pack, PIECE)
