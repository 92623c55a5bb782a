"""Exact removal of repeated byte strings: suffix sorting by a difference cover, shared out by content.

1. Whole copies: of equal texts only the one with the least doc_id is looked at; the others are covered from end to end.
2. Anchors (winnowing): a string of LENGTH bytes belongs to the first place in it where the hash of ANCHOR bytes is least, the
   same wherever the string occurs. Anchors of one document only are dropped.
3. Equal strings have equal anchors. So the text around an anchor (the starts that belong to it, and LENGTH bytes from
   each) goes to the shard of the anchor's hash; occurrences with equal surroundings are one, whose least
   doc_id counts. What is found for that one goes to all its places in the least document.
4. Each shard sorts its suffixes by the difference cover {1, 2} mod 3: sampled suffixes get names by triples of 8-byte
   symbols, then by triples of names (72 bytes, more than LENGTH, are told apart, so the recursion ends), the others are
   merged by their first bytes and the rank that follows. Neighbours in that order are compared over LENGTH bytes: a run of
   equal prefixes is one string, and every start but those of the least doc_id is covered.
5. An anchor with more than ANCHOR_BYTES of distinct surroundings (a phrase with ever other neighbours) goes to no shard:
   its strings, 31 at most for each surroundings, are grouped by a 128-bit hash wherever they are, and the least doc_id of
   each string is joined back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import U64, batches, dropped, mixed, text_bytes, written

LENGTH = 50
ANCHOR = 20
WINDOW = LENGTH - ANCHOR + 1
#: Bytes of surroundings that a task sorts at once.
SHARD_BYTES = 1 << 20
#: Bytes of texts in which anchors are looked for at once; few enough for a processor's cache.
TOGETHER_BYTES = 64 << 10
#: Bytes of distinct surroundings from which on an anchor is not sorted in one task.
ANCHOR_BYTES = 256 << 10
LAST = (1 << 63) - 1
#: Three ranks below this fit one 64-bit number, as those of a shard do.
PACKED = 1 << 21


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of a text, their hashes, and the first and last start of the strings that each belongs to: those
    of LENGTH bytes in which it is the first place of the least hash."""
    return anchors_of([text])[1:]


def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of some texts, looked for in all of them at once; before it the number of the text of each anchor."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    begins = np.append(0, ends[:-1])[:len(texts)]
    whole = b"".join(texts)
    if len(whole) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    word = np.lib.stride_tricks.sliding_window_view(np.frombuffer(whole, np.uint8), 8).copy().view(U64).ravel()
    n = len(whole) - ANCHOR + 1
    with np.errstate(over="ignore"):
        built = mixed(mixed(word[:n] + word[8:8 + n] * U64(0x9E3779B97F4A7C15)) ^ word[ANCHOR - 8:ANCHOR - 8 + n])
    # The first place of the least hash in windows of 1, 2, 4, ... places, and of WINDOW at last.
    least, ahead, span = built, np.zeros(n, np.uint8), 1
    while span < WINDOW:
        step = min(span, WINDOW - span)
        less = least[step:] < least[:-step]
        least, ahead = np.minimum(least[step:], least[:-step]), np.where(less, ahead[step:] + np.uint8(step), ahead[:-step])
        span += step
    text = np.repeat(np.arange(len(texts)), ends - begins)[:len(least)]
    start = np.flatnonzero(np.arange(len(least)) + LENGTH <= ends[text])  # the strings that lie in one text
    owner = start + ahead[start]
    new = np.append(True, owner[1:] != owner[:-1])[:len(owner)]
    first, last, place = start[new], start[np.append(new[1:], True)[:len(new)]], owner[new]
    of = text[first]
    return of, place - begins[of], built[place], first - begins[of], last - begins[of]


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks, from 1, of rows by their keys. Three keys below PACKED are sorted as one number."""
    if len(keys) == 3 and all(len(k) and k.max() < PACKED for k in keys):
        keys = (keys[0] << 42 | keys[1] << 21 | keys[2],)
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.append(1, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))[:len(order)]
    return rank


def suffix_order(text: np.ndarray) -> np.ndarray:
    """All places of a text (uint8, zeros between its parts) in the order of their suffixes, to 72 bytes at least."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(96, np.uint8)))
    word = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n + 80].copy().view(">u8").ravel().astype(U64)
    sample = np.arange(n + 3)[np.arange(n + 3) % 3 != 0]

    name = np.zeros(n + 60, np.int64)
    symbol = _ranks(word[:n + 60])
    name[sample] = _ranks(*(symbol[sample + k] for k in (0, 8, 16)))  # triples of symbols
    rank = np.zeros(n + 60, np.int64)
    rank[sample] = _ranks(*(name[sample + k] for k in (0, 24, 48)))  # triples of names
    zero, one, two = (np.arange(k, n, 3) for k in range(3))
    order01 = np.concatenate((zero, one))
    order01 = order01[np.argsort(padded[order01].astype(np.int64) << 40 | rank[order01 + 1])]
    order02 = np.concatenate((zero, two))
    order02 = order02[np.argsort(padded[order02].astype(np.int64) << 48 | padded[order02 + 1].astype(np.int64) << 40 | rank[order02 + 2])]
    taken = np.concatenate((one, two))
    taken = taken[np.argsort(rank[taken], kind="stable")]
    # Merge: a suffix's place is how many of each class come before it.
    place = np.zeros(n, np.int64)
    place[taken] += np.arange(len(taken))
    for order in (order01, order02):
        is_zero = order % 3 == 0
        place[order[~is_zero]] += np.cumsum(is_zero)[~is_zero]
        place[order[is_zero]] += np.cumsum(~is_zero)[is_zero]
    by_zero = order01[order01 % 3 == 0]
    place[by_zero] += np.arange(len(by_zero))
    return np.argsort(place, kind="stable")


def repeated_starts(parts: list[bytes], owned: np.ndarray, docs: np.ndarray) -> list[np.ndarray]:
    """For each part (the first ``owned`` places of which are starts) the starts whose LENGTH bytes also start in a part of
    a lesser document."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    begins = np.cumsum(lengths) - lengths
    part = np.repeat(np.arange(len(parts)), lengths)
    own = np.arange(len(text)) - begins[part] < owned[part]
    order = suffix_order(text)
    order = order[own[order]]
    padded = np.concatenate((text, np.zeros(64, np.uint8)))
    word = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(U64).ravel()
    same = np.ones(max(0, len(order) - 1), bool)
    for k in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        w = word[order + k]
        same &= w[1:] == w[:-1]
    found = [np.empty(0, np.int64)] * len(parts)
    if not len(order):
        return found
    run = np.cumsum(np.append(0, ~same))
    doc = docs[part[order]]
    least = np.minimum.reduceat(doc, np.flatnonzero(np.append(True, ~same)))[run]
    hit = np.sort(order[doc > least])
    cuts = np.flatnonzero(np.diff(part[hit])) + 1
    for at in np.split(hit, cuts) if len(hit) else []:
        k = part[at[0]]
        found[k] = at - begins[k]
    return found


def _together(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in turn, as many at once as have TOGETHER_BYTES, with the number of the first."""
    begin, size = 0, 0
    for k, x in enumerate(texts):
        size += len(x)
        if size >= TOGETHER_BYTES or k == len(texts) - 1:
            yield begin, texts[begin:k + 1]
            begin, size = k + 1, 0


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """(anchor, row, place) of all anchors. ``place`` also holds, in 5 bits each, how far before it the first of its strings
    starts, and how many more follow, so that anchors need not be looked for again."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 128):
            row = batch.column("row").to_numpy()
            for a, texts in _together(text_bytes(batch)):
                of, place, code, first, last = anchors_of(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code.view(np.int64)), pa.array(row[a + of]), pa.array((place * 32 + place - first) * 32 + last - first)], ["anchor", "row", "place"])

    return docs.select("row", "text").mapInArrow(run, "anchor long, row long, place long")


def _shared(spread: DataFrame) -> DataFrame:
    """(row, place) of the anchors that two rows or more have. Rows come sorted by anchor; one anchor is held at a time, and of that
    only what may yet turn out to be a single row's."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in rows:
            a, r, p = (batch.column(k).to_numpy() for k in range(3))
            if held is not None:
                a, r, p = np.append(held[0], a), np.append(held[1], r), np.append(held[2], p)
            if not len(a):
                continue
            new = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            many = np.maximum.reduceat(r, new) != np.minimum.reduceat(r, new)
            keep = np.repeat(many, np.diff(np.append(new, len(a))))
            cut = new[-1]
            if many[-1]:  # known to be shared: give it out now, keep two rows to recognise the rest by
                two = [cut + int(r[cut:].argmin()), cut + int(r[cut:].argmax())]
                out, held = keep, (a[two], r[two], p[two])
                out[two] = False
            else:
                out, held = keep & (np.arange(len(a)) < cut), (a[cut:], r[cut:], p[cut:])
            yield pa.RecordBatch.from_arrays([pa.array(r[out]), pa.array(p[out])], ["row", "place"])
        if held is not None and held[1].min() != held[1].max():
            yield pa.RecordBatch.from_arrays([pa.array(held[1]), pa.array(held[2])], ["row", "place"])

    n = int(spread.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(run, "row long, place long")


def _codes(text: bytes, places: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes at each place."""
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), ANCHOR)[places]
    a, b, c = (np.ascontiguousarray(windows[:, k:k + 8]).view(U64).ravel() for k in (0, 8, ANCHOR - 8))
    return mixed(mixed(mixed(a) ^ b) ^ c).view(np.int64)


def _surrounding_rows(docs: DataFrame) -> DataFrame:
    """docs (row, doc, text, places): for each shared anchor its hash, its surroundings and where they begin."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 64):
            out = ([], [], [], [], [], [])
            for row, doc, x, packed in zip(batch.column("row").to_pylist(), batch.column("doc").to_pylist(), text_bytes(batch),
                                           batch.column("places").to_pylist(), strict=True):
                packed = np.array(packed, np.int64)
                place, starts = packed >> 10, (packed & 31) + 1
                first = place - (packed >> 5 & 31)
                out[0].append(_codes(x, place))
                out[1].append(np.full(len(place), row))
                out[2].append(np.full(len(place), doc))
                out[3].append(first)
                out[4].append(starts)
                out[5].extend(x[a:b] for a, b in zip(first.tolist(), (first + starts - 1 + LENGTH).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out[:5]), pa.array(out[5], pa.binary())],
                                             ["anchor", "row", "doc", "first", "starts", "bytes"])

    return docs.select("row", "doc", "text", "places").mapInArrow(
        run, "anchor long, row long, doc long, first long, starts long, bytes binary")


SPAN = "row long, first long, end long, part long"


def _spans(row: np.ndarray, first: np.ndarray, end: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (row, first, end, part)], ["row", "first", "end", "part"])


def _sorted_shards(parts: DataFrame) -> DataFrame:
    """Covered spans (row, first, end) of distinct surroundings, sorted shard by shard; part: where those begin."""
    def judge(held: list[pa.Table]) -> pa.RecordBatch:
        whole = pa.concat_tables(held)
        row, doc, first, starts = (whole.column(c).to_numpy() for c in ("row", "doc", "first", "starts"))
        found = repeated_starts(whole.column("bytes").to_pylist(), starts, doc)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        at, of = np.concatenate(found), np.repeat(np.arange(len(found)), sizes)
        new = np.append(True, (of[1:] != of[:-1]) | (np.diff(at) > LENGTH))[:len(at)]
        a, b, of = at[new], at[np.append(new[1:], True)[:len(at)]], of[new]
        return _spans(row[of], first[of] + a, first[of] + b + LENGTH, first[of])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rest = [], 0, []
        for batch in chain(rows, (None,)):
            some = [*rest, *([] if batch is None else [pa.Table.from_batches([batch])])]
            if not some:
                continue
            some = pa.concat_tables(some)
            anchor = some.column("anchor").to_numpy()
            new = np.append(True, anchor[1:] != anchor[:-1])[:len(anchor)]
            cut = len(anchor) if batch is None else int(np.flatnonzero(new)[-1]) if len(anchor) else 0
            rest, alone = [some.slice(cut)], new & np.append(new[1:], True)[:len(new)]
            some = some.slice(0, cut).filter(pa.array(~alone[:cut]))
            more = pc.sum(pc.binary_length(some.column("bytes"))).as_py() or 0
            if held and (size + more > SHARD_BYTES):
                yield judge(held)
                held, size = [], 0
            if some.num_rows:
                held.append(some)
                size += more
        if held:
            yield judge(held)

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(run, SPAN)


def _string_rows(parts: DataFrame) -> DataFrame:
    """Of surroundings (row, doc, first, starts, bytes): each string of LENGTH bytes that belongs to the anchor, by hash."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in batches(rows, 2048):
            starts = batch.column("starts").to_numpy()
            codes = [xxhash.xxh3_128_digest(x[k:k + LENGTH]) for x, n in zip(batch.column("bytes").to_pylist(), starts.tolist(), strict=True) for k in range(n)]
            ends = np.cumsum(starts)
            at = np.arange(len(codes)) - np.repeat(ends - starts, starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes, pa.binary()), *(pa.array(np.repeat(batch.column(c).to_numpy(), starts)) for c in ("row", "doc", "first")),
                 pa.array(at.astype(np.int32))], ["code", "row", "doc", "part", "at"])

    return parts.select("row", "doc", "first", "starts", "bytes").mapInArrow(run, "code binary, row long, doc long, part long, at int")


def _hashed_strings(parts: DataFrame) -> DataFrame:
    """The same spans as _sorted_shards gives, for anchors of any number of surroundings."""
    strings = _string_rows(parts)
    least = written(strings.groupBy("code").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("high > low"), "strings")
    # The starts of one part lie closer than LENGTH, so what they cover is one span.
    return strings.join(least.select("code", "low"), "code").where("doc > low").groupBy("row", "part").agg(
        F.min("at").alias("a"), F.max("at").alias("b")).select(
        "row", (F.col("part") + F.col("a")).alias("first"), (F.col("part") + F.col("b") + LENGTH).alias("end"), "part")


def covered_spans(rows: DataFrame) -> DataFrame:
    """(row, spans): the covered spans of each distinct text (row, doc, text) that has any, unmerged, in no order."""
    shared = written(_shared(_anchor_rows(rows)), "shared")
    wanted = shared.groupBy("row").agg(F.collect_list("place").alias("places"))  # bounded by a text's length
    parts = written(_surrounding_rows(rows.join(wanted, "row")), "surroundings")
    dropped(shared)
    # Equal surroundings are one; all but the least document's are covered throughout.
    key = ["anchor", F.xxhash64("bytes").alias("code"), F.length("bytes").alias("size"), "starts"]
    least = parts.groupBy(*key).agg(F.min(F.struct("doc", "row", "first")).alias("least"), F.first("bytes").alias("bytes"))
    least = written(least, "distinct")
    # All other places of the same surroundings. In a greater document they are covered throughout; in the least document
    # (another place in it, or another row with its doc_id) by what is found for the one place that the shard looks at.
    others = written(parts.withColumns({"code": F.xxhash64("bytes"), "size": F.length("bytes")}).drop("bytes").join(
        least.select("anchor", "code", "size", "starts", "least"), ["anchor", "code", "size", "starts"]).where(
        "row != least.row or first != least.first").select("row", "first", "starts", F.expr("doc > least.doc").alias("greater"),
                                                           F.col("least.row").alias("of_row"), F.col("least.first").alias("of_first")), "others")
    dropped(parts)  # nothing reads the surroundings of every place any more
    copies = others.where("greater").select("row", "first", (F.col("first") + F.col("starts") - 1 + LENGTH).alias("end"))
    heavy = written(least.groupBy("anchor").agg(F.sum("size").alias("of_anchor")).where(F.col("of_anchor") > ANCHOR_BYTES), "heavy").select("anchor")
    distinct = least.select("anchor", "least.row", "least.doc", "least.first", "starts", "bytes")
    found = written(_sorted_shards(distinct.join(heavy, "anchor", "left_anti")), "found")
    if not heavy.isEmpty():
        found = found.union(written(_hashed_strings(written(distinct.join(heavy, "anchor", "left_semi"), "frequent")), "found"))
    dropped(least)
    again = found.select(F.col("row").alias("of_row"), F.col("part").alias("of_first"), F.col("first").alias("a"), F.col("end").alias("b")).join(
        others.where("not greater"), ["of_row", "of_first"]).select(
        "row", (F.col("first") + F.col("a") - F.col("of_first")).alias("first"), (F.col("first") + F.col("b") - F.col("of_first")).alias("end"))
    return copies.union(found.drop("part")).union(again).groupBy("row").agg(F.collect_list(F.struct("first", "end")).alias("spans"))


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text, how many bytes go, and in how many runs."""
    kept, at, removed, runs, last = [], 0, 0, 0, -1
    for first, end in sorted(spans):
        if first > last:
            kept.append(text[at:first])
            runs += 1
        else:
            first = last
        if end > last:
            removed += end - max(first, 0)
            at = last = end
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cut and the columns n_bytes, n_removed, n_spans, kept_sha256 put behind.

    Each byte goes that a string of LENGTH bytes covers which also starts in a document with a smaller doc_id, judged on the
    input. A null text stays null and counts as empty. Rows with equal doc_ids don't judge each other; a null doc_id counts
    as greater than all. A cut may part the bytes of a character: the text drops such bytes, the digest keeps them. An empty
    table gives no rows."""
    clash = [c for c in docs.columns if c in ("_row", "_doc", "_key", "_least", "spans", "n_bytes", "n_removed", "n_spans", "kept_sha256")]
    docs = docs.drop(*clash)
    own = docs.withColumns({"_doc": F.coalesce("doc_id", F.lit(LAST)), "_key": F.sha2(F.coalesce("text", F.lit("")), 256)})
    own = own.withColumn("_row", F.xxhash64("_doc", "_key"))
    least = written(own.groupBy("_key").agg(F.min("_doc").alias("_least")), "texts")
    # Of equal rows one stays; the join has dealt them out by the same columns, so the texts move once.
    firsts = own.join(least, "_key").where("_doc = _least").dropDuplicates(["_doc", "_key"])
    firsts = written(firsts.select(F.col("_row").alias("row"), F.col("_doc").alias("doc"), "text"), "firsts")
    spans = covered_spans(firsts).withColumnRenamed("row", "_row")
    dropped(firsts)
    joined = own.join(least, "_key").join(spans, "_row", "left")
    names = docs.columns
    schema = docs.limit(0).withColumns({"n_bytes": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"),
                                        "kept_sha256": F.lit("")}).schema

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 256):
            texts, made = [], []
            for x, doc, first, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("_doc").to_pylist(),
                                            batch.column("_least").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = x or b""
                whole = doc > first and len(raw) >= LENGTH
                kept, removed, runs = cut(raw, [(0, len(raw))] if whole else [(s["first"], s["end"]) for s in found or []])
                texts.append(None if x is None else kept.decode("utf-8", "ignore"))
                made.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest()))
            n, removed, runs, digest = list(zip(*made, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names] +
                [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())],
                [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.select(*names, "_doc", "_least", "spans").mapInArrow(run, schema)
