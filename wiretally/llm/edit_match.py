"""Benchmark items in documents up to an edit budget: pigeonhole pieces, then Myers' bit-parallel distance.

Text is a sequence of lower-cased words without marks at their ends; an edit inserts, deletes or replaces a word. An item of
m words may have e = floor(m * budget) edits; cut into e + 1 pieces, one piece at least stands unchanged in any match.
Documents are read once for each block of items; a block is bounded in bytes, so what tasks hold doesn't grow with the
benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import U64, batches, text_bytes, window_hashes, word_hashes

BUDGET = 0.2
#: UTF-8 bytes of the items that one pass over the documents looks for.
BLOCK_BYTES = 4 << 20
MARKS = b".,;:!?\"'()[]{}<>*#$%&|-_"
HIT = "doc_id long, item_id long, distance long, budget long, first_word long, end_word long"


def match_words(text: bytes) -> list[bytes]:
    """Lower-cased words without marks at their ends; words of marks alone are left out."""
    return [w for w in (x.strip(MARKS) for x in text.lower().split()) if w]


def edits_of(length: int, budget: float = BUDGET) -> int:
    return int(length * budget)


def pieces(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of edits + 1 pieces that differ by one word at most."""
    cuts = [length * k // (edits + 1) for k in range(edits + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_match(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of ``item`` to any stretch of ``text``, and where the first such stretch ends (Myers, 1999)."""
    m, places = len(item), {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score, best, end = full, 0, m, m, 0
    for at, w in enumerate(text):
        same = places.get(w, 0)
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        plus, minus = (down | ~(diagonal | up)) & full, up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = (minus | ~(diagonal | plus)) & full, plus & diagonal
        if score < best:
            best, end = score, at + 1
    return best, end


class Items:
    """A block of items, ready to be looked for: piece hashes by piece length, sorted."""

    def __init__(self, rows: list[tuple[int, bytes]], budget: float):
        self.items = []
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        for item_id, text in rows:
            hashes = word_hashes(match_words(text))
            if not len(hashes):
                continue
            edits = edits_of(len(hashes), budget)
            for start, n in pieces(len(hashes), edits):
                by_length.setdefault(n, []).append((int(window_hashes(hashes[start:start + n], n)[0]), len(self.items), start))
            self.items.append((item_id, hashes.tolist(), edits))
        self.pieces = {}
        for n, found in by_length.items():
            found.sort()
            self.pieces[n] = (np.array([x[0] for x in found], U64), np.array([x[1] for x in found]), np.array([x[2] for x in found]))

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(item id, distance, budget, first and end word) of every item that the text holds."""
        hashes = word_hashes(words)
        near: dict[int, list[int]] = {}
        for n, (keys, items, starts) in self.pieces.items():
            if len(hashes) < n:
                continue
            here = window_hashes(hashes, n)
            low = np.searchsorted(keys, here)
            for at in np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == here):
                k = low[at]
                while k < len(keys) and keys[k] == here[at]:
                    near.setdefault(int(items[k]), []).append(int(at - starts[k]))
                    k += 1
        for k, begins in sorted(near.items()):
            item_id, item, edits = self.items[k]
            best = None
            begins, run = sorted(set(begins)), None
            for b in [*begins, None]:  # overlapping neighbourhoods are searched as one
                lo, hi = (None, None) if b is None else (max(0, b - edits), min(len(hashes), b + len(item) + edits))
                if run and b is not None and lo <= run[1]:
                    run[1] = max(run[1], hi)
                    continue
                if run:
                    distance, end = best_match(item, hashes[run[0]:run[1]].tolist())
                    if distance <= edits and (best is None or distance < best[0]):
                        best = (distance, run[0] + max(0, end - len(item)), run[0] + end)
                run = [lo, hi] if b is not None else None
            if best:
                yield item_id, best[0], edits, best[1], best[2]


def item_blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The items, streamed through the driver in blocks of at most ``most`` bytes (one item at least)."""
    held, block = 0, []
    rows = benchmark.where("text is not null").select("item_id", F.encode("text", "utf-8").alias("text"))
    for r in rows.toLocalIterator():
        if block and held + len(r.text) > most:
            yield block
            held, block = 0, []
        block.append((r.item_id, bytes(r.text)))
        held += len(r.text)
    if block:
        yield block


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """One row per document row and item within its budget: the best match and where it lies (in words).

    Null or empty texts and items match nothing; repeated items are found each; an item of fewer words than 1 / budget
    must stand unchanged. An empty benchmark gives no rows; other columns are ignored."""
    found = None
    for block in item_blocks(benchmark):
        def run(rows: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = Items(block, budget)
            for batch in batches(rows, 512):
                hits = [(d, *hit) for d, x in zip(batch.column("doc_id").to_pylist(), text_bytes(batch), strict=True)
                        for hit in items.matches(match_words(x))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*hits, strict=True)) or [()] * 6)],
                                                 [x.split()[0] for x in HIT.split(", ")])

        part = docs.select("doc_id", "text").mapInArrow(run, HIT)
        found = part if found is None else found.union(part)
    return docs.sparkSession.createDataFrame([], HIT) if found is None else found


def without_benchmark(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The documents that hold no item; all columns stay. Judged row by row, so equal or missing doc_ids don't mix."""
    kept = docs
    for block in item_blocks(benchmark):
        def run(rows: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = Items(block, budget)
            for batch in batches(rows, 512):
                clean = [next(items.matches(match_words(x)), None) is None for x in text_bytes(batch)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
