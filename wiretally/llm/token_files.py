"""Token ids in files: Simple-8b words with escapes and block offsets.

A file is one shard: Parquet rows in order, each a *segment* of whole documents. Parquet is only the container
(written by Spark's own committer, so a lost task leaves nothing behind); a segment's ``payload`` is

    magic "S8B1" | 4 x u32: documents, ids, words, escapes
    i64 doc ids | u8 flags (1: doc id is null) | u32 ids per document
    u32 first word, u32 first escape of each block of 4096 ids
    u64 words: selector in the low 4 bits, then 60 bits of ids | u32 escaped ids

A word with selector s holds COUNTS[s] ids of WIDTHS[s] bits. An id of ESCAPE or more is written as ESCAPE and stands
in full among the escaped ids. No word crosses a block, so any block decodes alone; decoding handles all words of a
selector at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import batches, text_bytes
from wiretally.llm.tokenizer import Encoder, default_tokenizer
from wiretally.session import scratch_path

# Fixed values of Simple-8b: ids and bits per id for each selector (15 bits at most here, by the escape).
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15)
ESCAPE = (1 << 15) - 1
BLOCK = 4096
SEGMENT_IDS = 1 << 18
SEGMENT = "shard int, segment long, first_id long, n_ids long, payload binary"


def _runs(narrow: np.ndarray, count: int) -> np.ndarray:
    """Where in each row ``count`` narrow ids begin, for its first BLOCK places."""
    span = 1
    while span * 2 <= count:
        narrow, span = narrow[:, :-span] & narrow[:, span:], span * 2
    return narrow[:, :BLOCK] & narrow[:, count - span:count - span + BLOCK]


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all blocks, and where each block's words begin; no id is above ESCAPE."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    rows = np.zeros((blocks, BLOCK + COUNTS[0]), np.uint16)  # an unfilled last word is filled up with zeros
    for k in range(blocks):
        rows[k, :min(BLOCK, n - k * BLOCK)] = ids[k * BLOCK:(k + 1) * BLOCK]
    kind = np.full((blocks, BLOCK), len(COUNTS) - 1, np.uint8)
    for s in reversed(range(len(COUNTS) - 1)):  # ends with the selector that takes most ids
        np.copyto(kind, np.uint8(s), where=_runs(rows < 1 << WIDTHS[s], COUNTS[s]))
    take, starts, first = np.array(COUNTS, np.uint8)[kind], [], []
    for k in range(blocks):
        first.append(len(starts))
        step, at, base, end = take[k].tobytes(), 0, k * rows.shape[1], min(BLOCK, n - k * BLOCK)
        while at < end:
            starts.append(base + at)
            at += step[at]
    starts = np.array(starts, np.int64)
    flat, kind = rows.ravel(), kind[starts // rows.shape[1], starts % rows.shape[1]] if blocks else np.empty(0, np.uint8)
    words = kind.astype(np.uint64)
    for s in range(len(COUNTS)):
        own = np.flatnonzero(kind == s)
        at, built = starts[own], words[own]
        for k in range(COUNTS[s] if len(own) else 0):
            built |= flat[at + k].astype(np.uint64) << np.uint64(4 + k * WIDTHS[s])
        words[own] = built
    return words, np.array(first, np.int64)


def unpack_blocks(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of all blocks, whose words begin at ``first``; escapes still stand as ESCAPE."""
    kind = (words & np.uint64(15)).astype(np.int64)
    counts, block = np.array(COUNTS)[kind], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words))))
    begins = np.cumsum(counts) - counts
    rows = np.zeros((len(first), BLOCK + COUNTS[0]), np.uint32)
    places, flat = begins - begins[first][block] + block * rows.shape[1], rows.ravel()
    for s in range(len(COUNTS)):
        own = np.flatnonzero(kind == s)
        at, held, low = places[own], words[own], np.uint64((1 << WIDTHS[s]) - 1)
        for k in range(COUNTS[s] if len(own) else 0):
            flat[at + k] = held >> np.uint64(4 + k * WIDTHS[s]) & low
    return rows[:, :BLOCK].ravel()[:n]


def encode_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids) if ids else np.empty(0, "<u4")
    over = flat >= ESCAPE
    small = np.where(over, ESCAPE, flat)
    words, first_word = pack_blocks(small)
    first_escape = np.concatenate(([0], np.cumsum(over)))[np.arange(0, len(flat), BLOCK)] if len(flat) else np.empty(0)
    parts = [np.array([len(ids), len(flat), len(words), int(over.sum())], "<u4"),
             np.array([0 if d is None else d for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"),
             np.array([len(x) for x in ids], "<u4"), first_word.astype("<u4"), first_escape.astype("<u4"),
             words.astype("<u8"), flat[over].astype("<u4")]
    return b"S8B1" + b"".join(p.tobytes() for p in parts)


def decode_segment(payload: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    if payload[:4] != b"S8B1":
        raise ValueError("not a Simple-8b segment")
    docs, n, n_words, n_escapes = np.frombuffer(payload, "<u4", 4, 4).tolist()
    at = 20

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(payload, kind, count, at)
        at += part.nbytes
        return part

    doc_ids, null, lengths = take("<i8", docs).tolist(), take("u1", docs), take("<u4", docs)
    blocks = -(-n // BLOCK)
    first, _ = take("<u4", blocks).astype(np.int64), take("<u4", blocks)
    words, escapes = take("<u8", n_words), take("<u4", n_escapes)
    flat = unpack_blocks(words, first, n)
    flat[flat == ESCAPE] = escapes
    ends = np.cumsum(lengths.astype(np.int64))
    return [None if z else d for d, z in zip(doc_ids, null, strict=True)], np.split(flat.astype("<u4"), ends[:-1]) if docs else []


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, shards: int | None = None) -> None:
    """Encode ``text`` (null: empty; END_ID closes each document) and write shards in ascending doc_id order.

    Range partitioning deals the documents out, so no task sees more than a shard. Rows with the same doc_id stay side
    by side, ordered by text; null ids come first; an empty table gives an empty file set; other columns are ignored."""
    tokenizer = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, segment, first = Encoder.at(tokenizer), TaskContext.get().partitionId(), 0, 0
        doc_ids, ids, held = [], [], 0

        def full() -> pa.RecordBatch:
            nonlocal doc_ids, ids, held, segment, first
            row = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int64()), pa.array([first], pa.int64()),
                 pa.array([held], pa.int64()), pa.array([encode_segment(doc_ids, ids)], pa.binary())],
                ["shard", "segment", "first_id", "n_ids", "payload"])
            segment, first, doc_ids, ids, held = segment + 1, first + held, [], [], 0
            return row

        for batch in batches(rows, 256):
            for d, x in zip(batch.column("doc_id").to_pylist(), encoder(text_bytes(batch)), strict=True):
                doc_ids.append(d)
                ids.append(x)
                held += len(x)
                if held >= SEGMENT_IDS:
                    yield full()
        if doc_ids:
            yield full()

    (docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(encode, SEGMENT).write.option("compression", "none").parquet(path))


def read_token_files(spark, path: str) -> DataFrame:
    """Per document (doc_id, start, ids): ids of all documents before it, and its own, decoded from the files."""
    files = spark.read.schema(SEGMENT).parquet(path)
    # One number per shard reaches the driver: as many as there are files.
    totals = {r.shard: r.n for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    before, at = {}, 0
    for shard in sorted(totals):
        before[shard], at = at, at + totals[shard]

    def decode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 1):
            row = batch.to_pylist()[0]
            doc_ids, ids = decode_segment(row["payload"])
            starts = np.cumsum([before[row["shard"]] + row["first_id"]] + [len(x) for x in ids])[:-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()),
                 pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "start", "ids"])

    return files.mapInArrow(decode, "doc_id long, start long, ids binary")


def token_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write, read back, and state per document start, n_tokens and the crc32 of its ids."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer)
    read = read_token_files(docs.sparkSession, path)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))
