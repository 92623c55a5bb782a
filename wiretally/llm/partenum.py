"""Exact Jaccard self-join of word n-gram sets by PartEnum signatures, and its connected components.

Sizes are cut into intervals [lo, hi] with hi = floor(lo / threshold), so that similar sets lie in the same interval or in
neighbouring ones. Band j joins sets of interval j with those of intervals j and j - 1. Two sets of band j that are similar
enough differ in at most k = floor((1 - t) / (1 + t) * 2 hi) elements. The domain (hashes of shingles) is dealt into
k + 1 + e parts: the sets agree in e + 1 parts at least. A signature is the content of one part with its band and number.

A part in which a set has fewer than LEAST_HELD elements would put sets together that have little in common. A set that has at
most e such parts leaves their signatures out: agreeing parts are equal, so its partners still share one of the other e + 1
with it. A set with more of them keeps all its signatures, so that two such sets meet as well. So no pair is lost.

Equal sets are one node. A signature's sets are first compared with the least of them only (a star, never all pairs);
verified links give components; where a signature's sets then still lie in different components, further stars with other
centres follow, and at last those pairs across components that parity bits can't tell apart are verified, too.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import U64, batches, dropped, mixed, text_bytes, tokens, window_hashes, word_hashes, written
from wiretally.llm.components import components

SETS = "doc_id long, n_shingles long, set_key long"
LEAST_HELD = 2
#: Further stars, each with other centres, before sets of different components are compared with each other.
STAR_ROUNDS = 4
#: Further stars end as soon as less than one in so many of their pairs is a link.
FEW_TIES = 50
#: Sets of a group that are compared with each other, or with as many others, in one task.
BLOCK_ROWS = 2048
#: Parity bits for each element that a set may have of its own beside an equally large similar one; with few of them, many pairs
#: of a family that are just not similar enough look alike.
PARITY_BITS = 24
#: Words of 64 bits to which parities are folded at least for a first look at all pairs, and bits of them for each element in which
#: similar sets may differ.
SHORT_WORDS = 2
SHORT_BITS = 4
#: Words of folded parities that a side of a tile of pairs has at most at a first look, and words of parities at the second.
TILE_WORDS = 1 << 15
PIECE_WORDS = 1 << 18
#: Up to so many sets all pairs are looked at in full.
SMALL = 48
#: Bits by which documents are told whose elements are wanted.
MARKS = 1 << 24


class Bands:
    def __init__(self, threshold: tuple[int, int]):
        self.num, self.den = threshold
        self.tops: list[int] = []

    def interval(self, size: int) -> int:
        while not self.tops or self.tops[-1] < size:
            self.tops.append((self.tops[-1] + 1 if self.tops else 1) * self.den // self.num)
        return bisect_left(self.tops, size)

    def parts(self, band: int) -> tuple[int, int]:
        """How many parts the domain has in a band, and how many of them may be left out for having few elements."""
        self.interval(1)
        while len(self.tops) <= band:
            self.interval(self.tops[-1] + 1)
        differ = (self.den - self.num) * 2 * self.tops[band] // (self.den + self.num)
        spare = 0 if differ < 2 else 1 + differ // 10
        return differ + 1 + spare, spare


class Sets:
    """Shingle sets of some texts, one behind the other: sorted distinct ``elements``, ``sizes`` and ``begins``."""

    def __init__(self, texts: list[bytes], size: int):
        words = [tokens(x.lower()) for x in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        windows = np.where(lengths > size, lengths - size + 1, np.minimum(lengths, 1))
        hashes, ends, places = word_hashes([w for x in words for w in x]), np.cumsum(lengths), np.cumsum(windows)
        begins, rows = ends - lengths, np.repeat(np.arange(len(words)), windows)
        wide = window_hashes(np.append(hashes, np.zeros(size, U64)), size)
        found = wide[begins[rows] + np.arange(len(rows)) - (places - windows)[rows]]
        for k in np.flatnonzero((lengths > 0) & (lengths < size)).tolist():
            found[places[k] - 1] = window_hashes(hashes[begins[k]:ends[k]], int(lengths[k]))[0]
        for a, b in zip((places - windows).tolist(), places.tolist(), strict=True):
            found[a:b].sort()
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
        self.elements, self.rows = found[new], rows[new]
        self.sizes = np.bincount(self.rows, minlength=len(words))
        self.begins = np.cumsum(self.sizes) - self.sizes

    def keys(self) -> np.ndarray:
        """One 64-bit key per set."""
        with np.errstate(over="ignore"):
            sums = np.append(U64(0), np.cumsum(mixed(self.elements)))
            return mixed(sums[self.begins + self.sizes] - sums[self.begins] + self.sizes.astype(U64)).view(np.int64)

    def parts(self) -> list[np.ndarray]:
        return np.split(self.elements, self.begins[1:]) if len(self.begins) else []

    def signatures(self, bands: Bands) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(signature, row of its set) of the sets in each of their two bands; an empty set has none."""
        held_by = np.flatnonzero(self.sizes)
        if not len(held_by):
            return
        rows = np.repeat(np.arange(len(held_by)), self.sizes[held_by])
        own = np.array([bands.interval(n) for n in self.sizes[held_by].tolist()], np.int64)
        place = mixed(self.elements ^ U64(1))
        content = mixed(place)
        for band in (own, own + 1):
            parts, spare = np.array([bands.parts(k) for k in band.tolist()], np.int64).T
            begins = np.cumsum(parts) - parts
            slot = (place % parts.astype(U64)[rows]).astype(np.int64) + begins[rows]
            held = np.bincount(slot, minlength=int(parts.sum()))
            sums = np.zeros(len(held), U64)
            with np.errstate(over="ignore"):
                np.add.at(sums, slot, content)
                of = np.repeat(np.arange(len(parts)), parts)
                number = (np.arange(len(of)) - begins[of]).astype(U64) + (band.astype(U64) << U64(40))[of]
                code = mixed(sums + mixed(number))
            thin = held < LEAST_HELD
            keep = ~thin | (np.add.reduceat(thin, begins, dtype=np.int64) > spare)[of]
            yield code[keep], held_by[of[keep]]


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 128):
            sets = Sets(text_bytes(batch), size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets.sizes, pa.int64()), pa.array(sets.keys(), pa.int64())], ["doc_id", "n_shingles", "set_key"])

    return docs.select("doc_id", "text").mapInArrow(run, SETS)


def _spread(docs: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """(signature, set_key): one row for each signature of each document's set."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(threshold)
        for batch in batches(rows, 128):
            sets = Sets(text_bytes(batch), size)
            keys = sets.keys()
            for found, of in sets.signatures(bands):
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(keys[of])], ["signature", "set_key"])

    return docs.select("text").mapInArrow(run, "signature long, set_key long")


def _stars(spread: DataFrame) -> DataFrame:
    """(signature, first, other): the members of every signature that two or more sets have, each beside the least one.
    Rows come sorted, so a task holds one row of a signature at a time."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (signature, first member, last member)
        for batch in rows:
            if not batch.num_rows:
                continue
            s, k = (batch.column(i).to_numpy() for i in (0, 1))
            if last is not None:
                s, k = np.append(last[0], s), np.append(last[2], k)
            new = np.append(True, s[1:] != s[:-1])
            first = k[np.flatnonzero(new)][np.cumsum(new) - 1]
            if last is not None:
                first[:int(np.flatnonzero(np.append(new[1:], True))[0]) + 1] = last[1]
            other = ~new & (np.append(0, k[:-1]) != k)
            last = (s[-1], first[-1], k[-1])
            yield pa.RecordBatch.from_arrays([pa.array(s[other]), pa.array(first[other]), pa.array(k[other])], ["signature", "first", "other"])

    n = int(spread.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(n, "signature").sortWithinPartitions("signature", "set_key").mapInArrow(run, "signature long, first long, other long")


def _likely(pairs: DataFrame, parities: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) whose parities differ in no more bits than similar sets may."""
    num, den = threshold

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 1024):
            hit = []
            for a, b, m, n in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "m", "n")), strict=True):
                least = min(len(a), len(b)) // 8
                hit.append(int(np.bitwise_count(_folded(a, least) ^ _folded(b, least)).sum()) <= (den - num) * (m + n) // (den + num))
            yield batch.select(["u", "v"]).filter(pa.array(hit, pa.bool_()))

    u = parities.select(F.col("set_key").alias("u"), F.col("n").alias("m"), F.col("parity").alias("a"))
    v = parities.select(F.col("set_key").alias("v"), "n", F.col("parity").alias("b"))
    return pairs.select("u", "v").join(u, "u").join(v, "v").select("u", "v", "m", "n", "a", "b").mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, sets: DataFrame, parities: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough, by their elements. Those go out only for pairs that parities don't tell apart."""
    num, den = threshold

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 256):
            hit = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = np.frombuffer(a, U64), np.frombuffer(b, U64)
                at = np.minimum(np.searchsorted(a, b), len(a) - 1)
                both = int((a[at] == b).sum())
                hit.append(both * den >= num * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(hit, pa.bool_()))

    likely = written(_likely(pairs, parities, threshold), "likely")
    sets = _marked(sets, likely.select(F.explode(F.array("u", "v")).alias("named")), "set_key")
    a, b = (sets.select(F.col("set_key").alias(c), F.col("elements").alias(d)).join(likely, c) for c, d in (("u", "a"), ("v", "b")))
    return a.join(b, ["u", "v"]).select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _fits(a: str, b: str, threshold: tuple[int, int]):
    num, den = threshold
    return F.expr(f"least({a}, {b}) * {den} >= greatest({a}, {b}) * {num}")


def _marked(rows: DataFrame, named: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose ``key`` is in ``named``, and some others, so that most rows that no join needs don't move for it. The bits
    of MARKS places, 64 to a row, are sent to all tasks: a table of bounded size, whatever the number of documents."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod(xxhash64({c}), 64) as int))")
    marks = written(named.groupBy(F.floor(place("named") / 64).alias("word")).agg(F.bit_or(bit("named")).alias("bits")), "marks")
    return rows.join(F.broadcast(marks), (F.floor(place(key) / 64) == F.col("word")) & (F.col("bits").bitwiseAND(bit(key)) != 0), "left_semi")


def _elements(docs: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """(set_key, elements): the sorted hashes of the sets named in ``sets``, from the text of one of their documents."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 128):
            found = Sets(text_bytes(batch), size)
            keys = found.keys()
            own = keys == batch.column("set_key").to_numpy()  # a repeated doc_id may bring other texts
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([x.tobytes() for x in found.parts()], pa.binary())],
                                             ["set_key", "elements"]).filter(pa.array(own, pa.bool_()))

    named = sets.select("set_key", F.col("doc_id").alias("named"))
    return _marked(docs.select("doc_id", "text"), named).join(named, F.col("doc_id").eqNullSafe(F.col("named"))).select("set_key", "text").mapInArrow(
        run, "set_key long, elements binary")


def _labelled(sets: DataFrame, label: DataFrame) -> DataFrame:
    return sets.join(label.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn(
        "c", F.coalesce("component", "set_key")).drop("component")


def _mixed_members(stars: DataFrame, shared: DataFrame, sizes: DataFrame, label: DataFrame) -> DataFrame:
    """(signature, set_key, n, c) of all signatures whose stars cross components."""
    at = written(_labelled(sizes.select("set_key", "n"), label), "labels")
    u, v = at.select(F.col("set_key").alias("first"), F.col("c").alias("cu")), at.select(F.col("set_key").alias("other"), F.col("c").alias("cv"))
    crossing = written(shared.select(F.col("u").alias("first"), F.col("v").alias("other")).join(u, "first").join(v, "other").where("cu <> cv"), "crossing")
    theirs = stars.join(stars.join(crossing, ["first", "other"]).select("signature").distinct(), "signature")
    found = written(theirs.select("signature", F.col("other").alias("set_key")).union(theirs.select("signature", F.col("first").alias("set_key")).distinct()), "meeting")
    # Signatures with the same sets say the same: one of them stays.
    code = F.xxhash64("set_key")
    same = found.groupBy("signature").agg(F.count("*").alias("m"), F.bit_xor(code).alias("x"), F.min(code).alias("l"), F.max(code).alias("g"))
    one = same.groupBy("m", "x", "l", "g").agg(F.min("signature").alias("signature")).select("signature")
    return written(found.join(one, "signature").join(at, "set_key").select("signature", "set_key", "n", "c"), "members")


def _still_mixed(members: DataFrame, label: DataFrame) -> DataFrame:
    now = _labelled(members.drop("c"), label)
    mixed = now.groupBy("signature").agg((F.min("c") != F.max("c")).alias("mixed")).where("mixed").select("signature")
    return written(now.join(mixed, "signature").select("signature", "set_key", "n", "c"), "members")


def _star_pairs(members: DataFrame, turn: int, threshold: tuple[int, int]) -> DataFrame:
    """Each signature's sets beside one of them, by size possible and of another component; every turn has other centres."""
    centre = members.groupBy("signature").agg(F.min_by(F.struct("set_key", "n", "c"), F.xxhash64("set_key", F.lit(turn))).alias("o"))
    return members.join(centre, "signature").where("c <> o.c").where(_fits("n", "o.n", threshold)).select(
        F.least("set_key", "o.set_key").alias("u"), F.greatest("set_key", "o.set_key").alias("v")).distinct()


def _unexplained(members: DataFrame, parities: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (u, v) of sets that share a signature and lie in different components, as far as they may be similar.

    Signatures with the same least member are one group, so sets that are alike meet once for each such member, not once
    for each of the many signatures that they share. A group's members are dealt into blocks of BLOCK_ROWS, and each pair
    of blocks is compared in a task of its own by parities (see there), which tell most pairs apart without their elements."""
    least = members.groupBy("signature").agg(F.min("set_key").alias("least"))
    groups = written(members.join(least, "signature").select("least", "set_key", "n", "c").distinct(), "groups")
    count = groups.groupBy("least").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK_ROWS).cast("int")
    dealt = groups.join(count, "least").join(parities.select("set_key", "parity"), "set_key").withColumns(
        {"own": F.pmod(F.xxhash64("set_key"), blocks), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    return dealt.select("least", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set_key", "n", "c", "parity").groupBy(
        "least", "i", "j").applyInArrow(_near_by_parity(threshold), "u long, v long").distinct()


def _parities(elements: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(set_key, n, parity): bit b tells whether an odd number of elements falls on b. Two sets differ in at least as many
    elements as their parities differ in bits; a longer parity folds to a shorter one."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 256):
            made, sizes = [], []
            for x in batch.column("elements").to_pylist():
                x = np.frombuffer(x, U64)
                sizes.append(len(x))
                bits = max(128 * SHORT_WORDS, 1 << (len(x) * PARITY_BITS * (threshold[1] - threshold[0]) // threshold[1]).bit_length())
                odd = np.bincount((mixed(x ^ U64(0x5BD1E995)) % U64(bits)).astype(np.int64), minlength=bits) & 1
                made.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("set_key"), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], ["set_key", "n", "parity"])

    return elements.mapInArrow(run, "set_key long, n long, parity binary")


def _folded(parity: bytes, least: int) -> np.ndarray:
    """A parity cut to ``least`` words."""
    words = np.frombuffer(parity, U64)
    while len(words) > least:
        words = words[:len(words) // 2] ^ words[len(words) // 2:]
    return words


def _at_first_sight(parity: np.ndarray, n: np.ndarray, num: int, den: int):
    """A test of all pairs of some rows with others by one product of folded parities. Those are so long that sets with nothing in
    common differ in more bits than the largest similar ones may, (den - num) / (den + num) * (n[a] + n[b])."""
    may = (den - num) / (den + num) * n
    wanted = max(SHORT_WORDS, int(SHORT_BITS * 2 * may.max()) // 64 + 1)
    words = min(1 << (wanted - 1).bit_length(), parity.shape[1])
    short = np.bitwise_xor.reduce(parity.reshape(len(parity), -1, words), axis=1)
    slack = (may + 0.25 - np.bitwise_count(short).sum(1)).astype(np.float32)
    bits = lambda rows: np.unpackbits(short[rows].view(np.uint8), axis=1).astype(np.float32)
    return (lambda some, others: slack[some][:, None] + slack[others] >= -2 * (bits(some) @ bits(others).T)), words


def _tiles(left: np.ndarray, right: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``left`` and ``right`` in tiles of at most ``most`` rows a side, 16 to 512."""
    side = min(max(most, 16), 512)
    for x in range(0, len(left), side):
        for y in range(0, len(right), side):
            yield left[x:x + side], right[y:y + side]


def _pieces(a: np.ndarray, b: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(a), max(most, 1)):
        yield a[at:at + max(most, 1)], b[at:at + max(most, 1)]


def _near_by_parity(threshold: tuple[int, int]):
    """For one block pair of a group: pairs across components that size and parity allow to be similar enough."""
    num, den = threshold

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own, key, n, c = (table.column(x).to_numpy() for x in ("own", "set_key", "n", "c"))
        raw = table.column("parity").to_pylist()
        least = min(map(len, raw)) // 8
        parity = np.stack([_folded(x, least) for x in raw])
        may_be, words = _at_first_sight(parity, n, num, den) if len(raw) > SMALL else (None, SHORT_WORDS)
        left, right, us, vs = np.flatnonzero(own == i), np.flatnonzero(own == j), [], []
        for some, others in _tiles(left, right, TILE_WORDS // words):
            apart = c[some][:, None] != c[others]
            a, b = np.nonzero(apart if may_be is None else apart & may_be(some, others))
            a, b = some[a], others[b]
            fits = np.minimum(n[b], n[a]) * den >= np.maximum(n[b], n[a]) * num
            if i == j:
                fits &= key[b] > key[a]
            a, b = a[fits], b[fits]
            for a, b in _pieces(a, b, PIECE_WORDS // least):
                near = np.bitwise_count(parity[b] ^ parity[a]).sum(1) <= (den - num) * (n[b] + n[a]) // (den + num)
                us.append(np.minimum(key[a], key[b])[near])
                vs.append(np.maximum(key[a], key[b])[near])
        empty = [np.empty(0, np.int64)]
        return pa.table({"u": np.concatenate(us or empty), "v": np.concatenate(vs or empty)})

    return run


def jaccard_components(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """(doc_id, n_shingles, component_id): distinct ``size``-word shingles of the lower-cased words of ``text``, and the
    least doc_id reachable over links of Jaccard similarity ``threshold`` (a fraction) or more.

    A text of fewer words is one shingle; null or wordless texts have none and stand alone. Repeated doc_ids count as one
    node for each row; rows with a null doc_id take part and have a null component only where no other id is reachable.
    An empty table gives no rows; other columns are ignored."""
    meta = written(_sets(docs, size), "sets")
    stars = written(_stars(_spread(docs, size, threshold)), "stars")

    sizes = meta.where("n_shingles > 0").groupBy("set_key").agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("doc_id"))
    met = stars.select(F.col("first").alias("set_key")).union(stars.select(F.col("other").alias("set_key"))).distinct()
    sizes = written(sizes.join(met, "set_key"), "met")  # only sets that share a signature with another one
    elements = written(_elements(docs, sizes, size), "elements")
    parities = written(_parities(elements, threshold).dropDuplicates(["set_key"]), "parities")

    def sized(pairs: DataFrame) -> DataFrame:
        a = sizes.select(F.col("set_key").alias("u"), F.col("n").alias("nu"))
        b = sizes.select(F.col("set_key").alias("v"), F.col("n").alias("nv"))
        return pairs.join(a, "u").join(b, "v").where(_fits("nu", "nv", threshold)).select(*pairs.columns)

    # Each set with the star's centre it shares most signatures with: enough to tie most groups together.
    shared = written(stars.groupBy("first", "other").agg(F.count("*").alias("n")).select(F.col("first").alias("u"), F.col("other").alias("v"), "n"), "shared")
    best = written(sized(shared.groupBy("v").agg(F.max_by("u", F.struct("n", "u")).alias("u")).select("u", "v")), "best")
    links = written(_verified(best, elements, parities, threshold), "links")
    label, tried = written(components(links), "label"), best
    members, turn = None, 0
    while turn <= STAR_ROUNDS:
        members = _mixed_members(stars, shared, sizes, label) if members is None else _still_mixed(members, label)
        if members.isEmpty():
            break
        pairs = (_star_pairs(members, turn, threshold) if turn < STAR_ROUNDS else _unexplained(members, parities, threshold))
        pairs = written(pairs.join(tried, ["u", "v"], "left_anti"), "open")
        more = written(_verified(pairs, elements, parities, threshold), "links")
        tried, ties = tried.union(pairs), more.count()
        if ties:
            links = links.union(more)
            label = written(components(links), "label")
        # Stars that tie few of their pairs would tie ever fewer: then the rest is compared at once.
        turn = turn + 1 if turn >= STAR_ROUNDS or ties * FEW_TIES >= pairs.count() else STAR_ROUNDS
    for table in (stars, sizes, elements, parities, shared):
        dropped(table)  # the rest reads the sets and their components only
    by_set = meta.where("n_shingles > 0").join(label.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("component", "set_key"))
    least = by_set.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return (by_set.join(least, "root").select("doc_id", "n_shingles", "component_id")
            .union(meta.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))))


def one_of_each(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of their component. A row that repeats another's doc_id and text stays
    once; rows with a null doc_id stay, as nothing tells them apart."""
    stays = jaccard_components(docs, size, threshold).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(stays, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.union(docs.where("doc_id is null"))
