"""Removal of repeated word windows: a count-min sketch tells which windows may repeat, and only those are grouped exactly.

1. Documents are dealt into chunks of about CHUNK bytes of text, written once (compressed in pieces, as a chunk moves twice).
   A chunk settles by itself what repeats in it.
2. Each chunk gives its partial sketch: its distinct windows, cut by hash into blocks of the sketch, each a sorted list of cell
   numbers. One task per block adds the partial sketches up to counters (ROWS rows of at least four cells to a window), so
   neither the sketch nor a block of it grows in one place. A window's estimate is the least of its counters, never less than
   the number of chunks that hold it; what is estimated at two or more goes back to its chunks.
3. Second pass: each chunk hands in a row for every window so named (its 96-bit hash and its least doc_id in the chunk).
   Windows with one hash are put together exactly, and the chunks learn which of theirs start in a lesser document elsewhere.
   A window that a third of all documents share is one row a chunk.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm.common import U64, mixed, tokens, written

SIZE = 20
#: Bytes of text in a chunk; a longer document is one by itself.
CHUNK = 8 << 20
#: Windows to a block of the sketch. On corpora of many TB, raise both so that a chunk has some windows for each block.
BLOCK = 2 << 20
#: Bytes of text compressed together.
PIECE = 64 << 10
#: Bytes of text whose words are hashed at a time; what a worker holds besides a chunk is some dozen times as much.
HASHED = 256 << 10
CELL_BITS = 26
ROWS = 3
LAST = (1 << 63) - 1


def groups(rows: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows that come sorted by a column, value by value."""
    key, held = None, []
    for batch in rows:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            if held and values[a] != key:
                yield int(key), held
                held = []
            key = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield int(key), held


def window_codes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each ``size`` consecutive values, from those of 1, 2, 4, ... values."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    built, done, width, code = None, 0, 1, hashes
    with np.errstate(over="ignore"):
        while True:
            if size & width:
                built = code[:n] if built is None else mixed(built * U64(3) + code[done:done + n])
                done += width
            if done == size:
                return mixed(built + U64(size))
            code = mixed(code[:-width] * U64(3) + code[width:])
            width *= 2


_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)  # odd: each power has an inverse
_BYTES = [mixed(np.arange(256, dtype=U64) + U64(1000 * k)) for k in range(2)]
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The powers 0 .. n - 1 of a base modulo 2 ** 64, remembered up to the greatest n of usual size."""
    size = 1 << max(10, (n - 1).bit_length())
    known = _powers.get((base, size))
    if known is None:
        with np.errstate(over="ignore"):
            known = np.cumprod(np.append(U64(1), np.full(size - 1, base, U64)), dtype=U64)
        if size <= 1 << 21:
            _powers[base, size] = known
    return known[:n]


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word of some texts, and how many words each text has. A word's hash is its part of a
    running sum of byte values times powers of a base, moved back to power 0."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    out = []
    with np.errstate(over="ignore"):
        for base, values in zip(_BASES, _BYTES, strict=True):
            total = np.cumsum(values[data] * _power(base, len(data)), dtype=U64)
            out.append(mixed((total[end - 1] - total[start - 1]) * _power(pow(base, -1, 1 << 64), len(data))[start]))
    begins = np.cumsum([1, *(len(x) + 1 for x in texts)])
    return out[0], out[1], np.diff(np.searchsorted(start, begins))


class Chunk:
    """The windows of some documents, which come in the order of their doc_ids: both halves of each hash, the place in the
    joined words, and the document (its place in the chunk)."""

    def __init__(self, texts: list[bytes], size: int):
        parts, held, bulk = [], [], 0
        for k, x in enumerate(texts):
            held.append(x)
            bulk += len(x)
            if bulk >= HASHED or k == len(texts) - 1:
                parts.append(word_codes(held))
                held, bulk = [], 0
        high, low, lengths = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, U64), np.empty(0, U64), np.empty(0, np.int64))
        self.begins = np.append(0, np.cumsum(lengths))
        document = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        n = max(0, len(high) - size + 1)
        self.place = np.flatnonzero(document[:n] == document[size - 1:]) if n else np.empty(0, np.int64)
        self.document = document[self.place]
        self.high, self.low = window_codes(high, size)[self.place], (window_codes(low, size)[self.place] >> U64(32)).astype(np.uint32)

    def cells(self, blocks: int) -> np.ndarray:
        """Block and cell of each window, as one number."""
        return ((self.high % U64(blocks)) << U64(CELL_BITS)) | (self.low >> np.uint32(32 - CELL_BITS)).astype(U64)

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the windows sorted by hash, equal ones in page order, and where a new hash begins."""
        order = np.argsort(self.high, kind="stable")
        high, low = self.high[order], self.low[order]
        same = high[1:] == high[:-1]
        if np.any(low[1:][same] != low[:-1][same]):  # equal halves of unequal hashes
            order = np.lexsort((np.arange(len(self.high)), self.low, self.high))
            high, low = self.high[order], self.low[order]
        return order, np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))[:len(order)]


def packed(cells: np.ndarray) -> bytes:
    """A sorted list of distinct numbers below 2 ** 32 as differences, of two bytes where all fit."""
    steps = np.diff(cells.astype(np.int64), prepend=0)
    return b"\2" + steps.astype("<u2").tobytes() if steps.max(initial=0) < 65536 else b"\4" + steps.astype("<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<u2" if data[:1] == b"\2" else "<u4", offset=1), dtype=np.int64)


def estimates(lists: list[np.ndarray]) -> np.ndarray:
    """Count-min estimate of each listed cell number over all lists, in the order of the lists."""
    values = np.concatenate(lists).astype(U64)
    width = 1 << max(10, math.ceil(math.log2(4 * max(1, len(values)))))
    least = np.full(len(values), np.iinfo(np.int64).max)
    for row in range(ROWS):
        cell = (mixed(values ^ (U64(row + 1) << U64(40))) & U64(width - 1)).astype(np.int64)
        least = np.minimum(least, np.bincount(cell, minlength=width)[cell])
    return least


def _chunks(docs: DataFrame, most: int) -> DataFrame:
    """(chunk, piece, docs, sizes, texts) of all rows: some consecutive documents, their texts compressed together."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        codec = pa.Codec("zstd", 3)
        state = {"chunk": TaskContext.get().partitionId() << 32, "piece": 0, "bulk": 0}
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def made() -> pa.RecordBatch:
            row = {**{k: state[k] for k in ("chunk", "piece")}, "docs": list(ids), "sizes": [len(x) for x in texts],
                   "texts": codec.compress(b"".join(texts), asbytes=True)}
            state["piece"] += 1
            state["bulk"] += held
            if state["bulk"] >= most:
                state.update(chunk=state["chunk"] + 1, piece=0, bulk=0)
            ids.clear()
            texts.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in rows:
            for doc, x in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(doc)
                texts.append(x or b"")
                held += len(texts[-1])
                if held >= min(most, PIECE) or len(ids) >= 4096:
                    yield made()
                    held = 0
        if ids:
            yield made()

    schema = pa.schema([("chunk", pa.int64()), ("piece", pa.int32()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary())])
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "chunk long, piece int, docs array<long>, sizes array<long>, texts binary")


def _texts(parts: list[pa.RecordBatch]) -> tuple[list[int | None], list[bytes]]:
    """doc_ids and texts of a chunk by doc_id; null counts as the greatest."""
    rows = []
    for p in parts:
        for docs, sizes, packed_texts in zip(p.column("docs").to_pylist(), p.column("sizes").to_pylist(), p.column("texts").to_pylist(), strict=True):
            data, at = pa.Codec("zstd").decompress(packed_texts, sum(sizes), asbytes=True) if sum(sizes) else b"", 0
            for doc, n in zip(docs, sizes, strict=True):
                rows.append((doc, data[at:at + n]))
                at += n
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    return [r[0] for r in rows], [r[1] for r in rows]


def _partial_sketches(chunks: DataFrame, size: int, blocks: int) -> DataFrame:
    """(block, chunk, cells): for each chunk the distinct cells of its windows. A chunk read in two parts gives two lists, which
    may only raise an estimate."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, parts in groups(rows, "chunk"):
            cells = np.unique(Chunk(_texts(parts)[1], size).cells(blocks))
            block, first = np.unique(cells >> U64(CELL_BITS), return_index=True)
            lists = np.split(cells & U64((1 << CELL_BITS) - 1), first[1:]) if len(cells) else []
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(np.full(len(block), chunk)),
                                              pa.array([packed(x) for x in lists], pa.binary())], ["block", "chunk", "cells"])

    return chunks.mapInArrow(run, "block int, chunk long, cells binary")


def _named(sketches: DataFrame, partitions: int) -> DataFrame:
    """(chunk, block, cells): of each partial sketch the cells estimated at two or more over all."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in groups(rows, "block"):
            chunk = [c for p in parts for c in p.column("chunk").to_pylist()]
            lists = [unpacked(x) for p in parts for x in p.column("cells").to_pylist()]
            ends = np.cumsum([len(x) for x in lists])[:-1]
            found = [packed(x[e >= 2]) if (e >= 2).any() else None for x, e in zip(lists, np.split(estimates(lists), ends), strict=True)]
            kept = [k for k, x in enumerate(found) if x is not None]
            yield pa.RecordBatch.from_arrays([pa.array([chunk[k] for k in kept], pa.int64()), pa.array([block] * len(kept), pa.int32()),
                                              pa.array([found[k] for k in kept], pa.binary())], ["chunk", "block", "cells"])

    return sketches.repartition(partitions, "block").sortWithinPartitions("block").mapInArrow(run, "chunk long, block int, cells binary")


def _chunk_by_chunk(chunks: DataFrame, told: DataFrame, partitions: int) -> DataFrame:
    """Rows of both, chunk by chunk: what was told it, then its documents."""
    both = told.withColumn("kind", F.lit(0)).unionByName(chunks.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition(partitions, "chunk").sortWithinPartitions("chunk", "kind", "piece")


def _split(parts: list[pa.RecordBatch]) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch]]:
    """What the chunk was told and its documents."""
    told, own = [], []
    for p in parts:
        cut = int(np.searchsorted(p.column("kind").to_numpy(), 1))
        told.append(p.slice(0, cut))
        own.append(p.slice(cut))
    return [p for p in told if p.num_rows], [p for p in own if p.num_rows]


def _numbers(docs: list[int | None]) -> np.ndarray:
    return np.array([LAST if d is None else d for d in docs], np.int64)


def _repeat_rows(chunks: DataFrame, named: DataFrame, size: int, blocks: int, partitions: int) -> DataFrame:
    """(high, low, chunk, doc, at): each distinct window that may repeat in other chunks, with its least document in this one and
    the number of its first place there."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, parts in groups(rows, "chunk"):
            told, own = _split(parts)
            if not told or not own:
                continue
            cells = np.unique(np.concatenate([unpacked(x) + (b << CELL_BITS) for p in told for b, x in zip(
                p.column("block").to_pylist(), p.column("cells").to_pylist(), strict=True)])).astype(U64)
            docs, texts = _texts(own)
            chunk, doc = Chunk(texts, size), _numbers(docs)
            if not len(chunk.place):
                continue
            order, new = chunk.order()
            firsts = order[new]
            wanted = chunk.cells(blocks)[firsts]
            at = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
            firsts = np.sort(firsts[cells[at] == wanted])  # in page order, doc_ids compress
            for k in range(0, len(firsts), 100_000):
                part = firsts[k:k + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunk.high[part].view(np.int64)), pa.array(chunk.low[part].view(np.int32)), pa.array(np.full(len(part), number)),
                     pa.array(doc[chunk.document[part]]), pa.array(part.astype(np.int32))], ["high", "low", "chunk", "doc", "at"])

    return _chunk_by_chunk(chunks, named, partitions).mapInArrow(run, "high long, low int, chunk long, doc long, at int")


def _covered_words(chunk: Chunk, doc: np.ndarray, told: np.ndarray | None, size: int) -> np.ndarray:
    """Which words of a chunk go: those of windows that come earlier in it, or in other chunks by the numbers it was told. Arrays
    of the length of the chunk are given up as soon as they have been used."""
    order, new = chunk.order()
    goes = np.zeros(len(order), bool)
    if len(order):
        group, document = np.cumsum(new, dtype=np.int32) - 1, chunk.document[order]
        # In the chunk: a lesser document has it, or an earlier place in the same one.
        hit = np.append(False, document[1:] == document[:-1]) & ~new
        of = doc[document]
        del document
        hit |= of > of[new][group]
        del of
        if told is not None:
            place = np.empty(len(order), np.int32)
            place[order] = group
            elsewhere = np.zeros(int(group[-1]) + 1, bool)
            elsewhere[place[told]] = True
            del place
            hit |= elsewhere[group]
        goes[order] = hit
        del group, hit
    del order, new
    starts, total = chunk.place[goes], int(chunk.begins[-1])
    edge = np.bincount(starts, minlength=total + 1)
    edge -= np.bincount(starts + size, minlength=total + 1)
    return np.cumsum(edge)[:-1] > 0


def _cut(chunks: DataFrame, covered: DataFrame, size: int, partitions: int) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in groups(rows, "chunk"):
            told, own = _split(parts)
            if not own:
                continue
            docs, texts = _texts(own)
            chunk, doc = Chunk(texts, size), _numbers(docs)
            told = np.concatenate([p.column("at").flatten().to_numpy() for p in told]) if told else None
            removed, begins = _covered_words(chunk, doc, told, size), chunk.begins
            del chunk  # its hashes are not needed for the texts
            for k in range(0, len(docs), 1000):
                part = slice(k, k + 1000)
                n, gone, kept = np.diff(begins[k:k + 1001]), [], []
                for text, a, b in zip(texts[part], begins[k:k + 1000].tolist(), begins[k + 1:k + 1001].tolist(), strict=False):
                    words, out = tokens(text), removed[a:b]
                    gone.append(int(out.sum()))
                    kept.append(b" ".join(words if not gone[-1] else [words[k] for k in np.flatnonzero(~out).tolist()]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[part], pa.int64()), pa.array([x.decode() for x in kept], pa.string()), pa.array(n),
                     pa.array(gone, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
                    ["doc_id", "text", "n_words", "n_removed", "kept_sha256"])

    return _chunk_by_chunk(chunks, covered, partitions).mapInArrow(
        run, "doc_id long, text string, n_words long, n_removed long, kept_sha256 string")


def cut_repeats(docs: DataFrame, size: int = SIZE, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(doc_id, text, n_words, n_removed, kept_sha256) for each row of ``docs`` (doc_id, text): the words that are left, joined by
    one space. A word goes that a window of ``size`` words covers which also starts in a document with a smaller doc_id, or
    earlier in the same document; windows are judged on the input.

    A null text has no words. Rows with equal doc_ids are different documents and don't judge each other; a null doc_id counts
    as the greatest. Extra columns are not carried, whatever their names. An empty table gives no rows."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = written(_chunks(docs, chunk), "chunks")
    bulk = chunks.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, b) -> a + b)"))).first()[0] or 0
    blocks = max(1, math.ceil(bulk / 6 / block))  # a word takes about six bytes
    named = written(_named(_partial_sketches(chunks, size, blocks), partitions), "named")
    rows = _repeat_rows(chunks, named, size, blocks, partitions)
    least = F.min("doc").over(Window.partitionBy("high", "low"))
    covered = rows.withColumn("least", least).where("doc > least").groupBy("chunk").agg(F.collect_list("at").alias("at"))  # bounded by the chunk
    return _cut(chunks, covered, size, partitions)
