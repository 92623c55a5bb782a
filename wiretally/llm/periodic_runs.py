"""Runs of words that repeat with a short period, found from minimizers of several scales.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at least max(LEAST, TIMES * q) words
long, that no neighbouring word extends. At scale k (16, 32, 64, ...) the periods from k/2 + 1 to k are found:

1. Every place gets a hash of the k words from it on. Inside a run of such a period, stretches of k words are equal only if
   they lie a multiple of q apart, since k covers a whole period.
2. In each window of k/2 places the first one of least hash is a minimizer. A run holds two windows q apart with equal content,
   so two neighbours among the equal minimizers lie exactly q apart there: such pairs are the seeds.
3. A seed is kept if one side of it goes on with the period for k/4 words, as a run of four periods must, and is then extended word by
   word in both directions as far as words q apart are equal.

Periods up to SHORT, too short for minimizers, are found by comparing the text with itself q words on. A stretch that also has
a smaller period has come up before, with that one. Nothing is compared with everything: work is n log n for n words."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import U64, batches, mixed, tokens

TIMES = 4
LEAST = 6
SHORT = 8
#: Words that are looked at together; a longer document is looked at by itself.
TOGETHER = 1 << 16


def _stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the maximal stretches of at least ``least`` true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], equal.view(np.int8), [0]))))
    start, length = edge[::2], edge[1::2] - edge[::2]
    return start[length >= least], length[length >= least]


def _equal_ahead(x: np.ndarray, at: int, lag: int) -> int:
    """How many words from ``at`` on equal those ``lag`` words later."""
    n, step = 0, 64
    while at + n + lag < len(x):
        end = min(at + n + step, len(x) - lag)
        wrong = np.flatnonzero(x[at + n:end] != x[at + n + lag:end + lag])
        if len(wrong):
            return n + int(wrong[0])
        n, step = end - at, step * 4
    return n


def _minimizers(code: np.ndarray, window: int) -> np.ndarray:
    """Places that hold the first least value of some ``window`` consecutive places; the window is a power of two."""
    least, place, span = code, np.arange(len(code)), 1
    while span < window:
        right = least[span:] < least[:-span]
        place = np.where(right, place[span:], place[:-span])
        least = np.where(right, least[span:], least[:-span])
        span *= 2
    return np.unique(place)


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    n, found = len(words), {}
    for lag in range(1, min(SHORT, n // TIMES) + 1):
        for start, length in zip(*(x.tolist() for x in _stretches(words[:-lag] == words[lag:], max(LEAST, TIMES * lag) - lag)), strict=True):
            found.setdefault((start, length + lag), lag)
    backward = words[::-1]
    codes, width = {1: mixed(words.astype(U64) + U64(1))}, 1
    while SHORT * 2 <= n and TIMES * (width + 1) <= n:
        code = codes[width]
        if len(code) <= width:
            break
        with np.errstate(over="ignore"):
            codes[width * 2] = mixed(code[:-width] * U64(3) + code[width:])
        width *= 2
        if width < 2 * SHORT:
            continue
        k, code, quarter = width, codes[width], codes[width // 4]
        if len(code) < k // 2:
            break
        place = _minimizers(code, k // 2)
        order = np.argsort(code[place], kind="stable")
        first, second = place[order[:-1]], place[order[1:]]
        lag = second - first
        seed = (code[first] == code[second]) & (lag > k // 2) & (lag <= k)
        first, lag = first[seed], lag[seed]
        before, behind = first - k // 4, first + k
        goes_on = np.zeros(len(first), bool)
        inside = before >= 0
        goes_on[inside] = quarter[before[inside]] == quarter[before[inside] + lag[inside]]
        inside = behind + lag < len(quarter)
        goes_on[inside] |= quarter[behind[inside]] == quarter[behind[inside] + lag[inside]]
        first, lag = first[goes_on], lag[goes_on]
        reached = {}  # by lag: the end of the stretch extended last
        for k in np.argsort(first, kind="stable").tolist():
            at, q = int(first[k]), int(lag[k])
            if at < reached.get(q, 0):
                continue
            ahead, back = _equal_ahead(words, at, q), _equal_ahead(backward, n - at - q, q)
            reached[q] = at + ahead
            if back + ahead + q >= max(LEAST, TIMES * q):
                found.setdefault((at - back, back + ahead + q), q)
    return sorted((start, length, q) for (start, length), q in found.items())


def runs_of_many(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of several word lists, looked at as one sequence with a word of its own kind between any two."""
    number: dict[bytes, int] = {}
    parts, begins, at = [], [], 0
    for k, words in enumerate(texts):
        begins.append(at)
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        parts.append(np.array([-1 - k]))
        at += len(words) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = runs_of(np.concatenate(parts)) if parts else []
    for (start, length, q), k in zip(found, (np.searchsorted(begins, [r[0] for r in found], "right") - 1).tolist(), strict=True):
        out[k].append((start - begins[k], length, q))
    return out


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic tail in about a tenth of the documents: from word a on, word i is word a + (i - a) % p. A null
    doc_id gets none."""
    code = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if code is None or code % 10 or not words:
        return words
    g = code // 10
    a = g % len(words)
    tail = words[a:a + 1 + (len(words) - a) // (3 + g % 8)]
    return words[:a] + (tail * ((len(words) - a) // len(tail) + 1))[:len(words) - a]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """What is left when each run keeps its first period only, wherever another run doesn't drop that too."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, length, q in runs:
        gone[start + q:start + length] = True
    return [words[k] for k in np.flatnonzero(~gone).tolist()]


def collapse_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """(doc_id, text, runs) for each row of ``docs`` (doc_id, text): the words left, joined by one space, and all runs as (start, length,
    period) by start, then period. ``plant`` first gives some documents a periodic tail (see ``planted``).

    Rows are judged one by one: repeated rows, equal and null doc_ids make no difference. A null text has no words. Extra
    columns are not carried, whatever their names. An empty table gives no rows. A document is held whole by one task, with a
    few numbers per word; no rows are shuffled."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 256):
            texts = [planted(w, d) if plant else w for w, d in zip(
                (tokens(x or b"") for x in batch.column("text").to_pylist()), batch.column("doc_id").to_pylist(), strict=True)]
            found, held, size = [], [], 0
            for k, words in enumerate(texts):
                held.append(words)
                size += len(words)
                if size >= TOGETHER or k == len(texts) - 1:
                    found += runs_of_many(held)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([b" ".join(collapsed(w, r)).decode() for w, r in zip(texts, found, strict=True)], pa.string()),
                 pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in found],
                          pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))], ["doc_id", "text", "runs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, text string, runs array<struct<start:long,length:long,period:long>>")


def run_digests(docs: DataFrame) -> DataFrame:
    """Digest columns of ``collapse_runs`` with planted tails: n_runs, the strongest run (start, length, period, exponent_milli;
    nulls without a run), runs_sha256 and collapsed_sha256."""
    better = ("(best, r) -> CASE WHEN best IS NULL OR CAST(r.length AS DECIMAL(20,0)) * best.period > CAST(best.length AS DECIMAL(20,0)) * r.period"
              " THEN r ELSE best END")
    kind = "STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>"
    return collapse_runs(docs, plant=True).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.expr(f"aggregate(runs, CAST(NULL AS {kind}), {better})").alias("best"),
        F.sha2(F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.*", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
