"""What the operators for training data must not do more often, or larger, than the job needs."""

from __future__ import annotations

import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wiretally.llm import partenum, suffix_dedup
from wiretally.llm.common import shingle_hashes, shuffles_freed, tokens, written
from wiretally.llm.token_files import BLOCK, ESCAPE, pack_blocks, unpack_blocks
from wiretally.llm.tokenizer import END_ID, Encoder, default_tokenizer


def test_a_stem_is_coded_once_whatever_its_case_and_marks(monkeypatch):
    encoder, coded = Encoder(default_tokenizer()), []
    plain = encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda words: coded.extend(x for w in words for x in w.split()) or plain(words))
    text = "Quartzel quartzel QUARTZEL, quartzel.*** quartzel? quartzel"
    ids = encoder([text.encode()])[0].tolist()
    assert ids == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, END_ID]
    assert sorted(coded) == sorted(["quartzel", ",", ".***", "?"])


@pytest.mark.parametrize("text", [
    "it's 'tis don't DON'T I'LL we're we're. x's' '' 's 'S", "ΑΣ ας ΟΔΟΣ. İstanbul İ. ẞ ǅ K Kelvin'", "étude É. é ≮ a≮ ≠",
    "a1 1a 1.5, A1.*** 12 ½. x² …. a…. a….. “quoted” a_b _a_ a__", "<|endoftext|> a<|endoftext|>. <|endoftext|>a ***<|endoftext|>", "名前。 名前. 東京, ａｂｃ ＡＢＣ. кот Кот КОТ!", ""])
def test_words_by_stem_and_marks_have_the_tokenizers_ids(text):
    encoder = Encoder(default_tokenizer())
    for _ in range(2):  # new words, then known ones
        assert encoder([text.encode()])[0].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, END_ID]


@pytest.mark.parametrize("n", [0, 1, BLOCK - 1, BLOCK, 2 * BLOCK + 7])
def test_blocks_decode_together(n):
    ids = np.random.default_rng(n).choice([0, 1, 3, 200, 4000, ESCAPE], n, p=[.5, .2, .1, .1, .05, .05])
    assert unpack_blocks(*pack_blocks(ids), n).tolist() == ids.tolist()


def test_sets_that_just_miss_the_threshold_are_told_apart_without_their_elements(spark):
    rng, base = np.random.default_rng(5), np.arange(147)
    sets = {k: np.sort(partenum.mixed(np.append(rng.choice(base, 137, replace=False), rng.integers(1000, 10**9, 10)).astype(np.uint64))) for k in range(200)}
    sets[200] = sets[0].copy()
    sets[200][5] += np.uint64(1)
    elements = spark.createDataFrame([(k, x.tobytes()) for k, x in sets.items()], "set_key long, elements binary")
    parities = partenum._parities(elements, (85, 100))
    members = spark.createDataFrame([(7, k, len(x), k) for k, x in sets.items()], "signature long, set_key long, n long, c long")
    found = {tuple(r) for r in partenum._unexplained(members, parities, (85, 100)).collect()}
    alike = {(a, b) for a in sets for b in sets if a < b and 100 * (both := len(np.intersect1d(sets[a], sets[b]))) >= 85 * (294 - both)}
    assert (0, 200) in alike <= found and len(found) < 200  # of 20 100 pairs
    pairs = spark.createDataFrame([(a, b) for a in range(60) for b in range(a + 1, 60)] + [(0, 200)], "u long, v long")
    assert {(0, 200)} <= {tuple(r) for r in partenum._likely(pairs, parities, (85, 100)).collect()} <= found


def test_small_and_large_groups_lose_no_similar_pair(spark, monkeypatch):
    rng = np.random.default_rng(6)
    sets = {k: np.unique(partenum.mixed(rng.integers(0, 9, rng.integers(1, 40)).astype(np.uint64))) for k in range(90)}
    elements = spark.createDataFrame([(k, x.tobytes()) for k, x in sets.items()], "set_key long, elements binary")
    members = spark.createDataFrame([(s, k, len(x), k % 80) for k, x in sets.items() for s in (1, 2) if s == 1 or k % 3 == 0], "signature long, set_key long, n long, c long")
    alike = {(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and a % 80 != b % 80 and 10 * len(np.intersect1d(x, y)) >= 7 * len(np.union1d(x, y))}
    for rows in (2048, 20):
        monkeypatch.setattr(partenum, "BLOCK_ROWS", rows)
        found = {tuple(r) for r in partenum._unexplained(members, partenum._parities(elements, (7, 10)), (7, 10)).collect()}
        assert alike and alike <= found


def test_sets_that_share_many_signatures_meet_once(spark, monkeypatch):
    rng, tables, plain = np.random.default_rng(7), {}, partenum.written
    monkeypatch.setattr(partenum, "written", lambda df, name: tables.setdefault(name, plain(df, name)))
    sets = {k: np.sort(partenum.mixed(np.append(np.arange(95), rng.integers(1000, 10**9, 5)).astype(np.uint64))) for k in range(30)}
    parities = partenum._parities(spark.createDataFrame([(k, x.tobytes()) for k, x in sets.items()], "set_key long, elements binary"), (85, 100))
    # Signatures 0 to 39 are all sets' but one's, 40 is that of three sets with a least member of their own.
    rows = [(s, k, 100, k) for s in range(40) for k in sets if k != s + 1] + [(40, k, 100, k) for k in (11, 17, 29)]
    members = spark.createDataFrame(rows, "signature long, set_key long, n long, c long")
    found = {tuple(r) for r in partenum._unexplained(members, parities, (85, 100)).collect()}
    assert found == {(a, b) for a in sets for b in sets if a < b}
    assert tables["groups"].count() == 30 + 3  # not one row for each of the 1 174 memberships


def test_only_texts_whose_elements_are_wanted_move(spark):
    docs = spark.createDataFrame([(k, str(k)) for k in range(-2000, 2000)] + [(None, "none"), (None, "no"), (7, "again")], "doc_id long, text string")
    for wanted in ([3, -5, 7, None], [1], []):
        named = spark.createDataFrame([(k,) for k in wanted], "named long")
        found = partenum._marked(docs, named).collect()
        of = [r for r in found if r.doc_id in wanted]
        assert sorted(map(tuple, of), key=str) == sorted((tuple(r) for r in docs.collect() if r.doc_id in wanted), key=str)
        assert len(found) - len(of) < 5 and (wanted or not found)
    assert "BroadcastHashJoin" in partenum._marked(docs, named)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [1, 2, 4])
def test_shingle_sets_of_many_texts_together(size):
    texts = [b"", b"a", b"a b", b"A a a A a", b"", b"a b c d", b"b a b a b a b", b" x\ty ", b"a b c d e f g a b c d"]
    sets = partenum.Sets(texts, size)
    plain = [shingle_hashes(tokens(x.lower()), size) for x in texts]
    assert [x.tolist() for x in sets.parts()] == [x.tolist() for x in plain] and sets.sizes.tolist() == [len(x) for x in plain]
    assert sets.keys().tolist() == [partenum.Sets([x], size).keys()[0] for x in texts]
    together, apart = ([(int(c), int(r)) for codes, rows in s.signatures(partenum.Bands((7, 10))) for c, r in zip(codes, rows + k, strict=True)]
                       for s, k in ((sets, 0), (partenum.Sets(texts[5:6], size), 5)))
    assert sorted(x for x in together if x[1] == 5) == sorted(apart) and {r for _, r in together} == {k for k, x in enumerate(plain) if len(x)}


def test_texts_move_once_to_find_the_first_of_equal_ones(spark, monkeypatch):
    plans, plain = {}, suffix_dedup.written
    monkeypatch.setattr(suffix_dedup, "written", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and plain(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = "".join(map(str, range(60)))
        docs = spark.createDataFrame([(1, text), (2, text), (2, text), (1, text), (3, "x" + text), (4, None), (None, text)], "doc_id long, text string")
        found = suffix_dedup.remove_repeats(docs).select("doc_id", "n_removed").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    n = len(text)
    assert sorted(map(tuple, found), key=str) == sorted([(1, 0), (1, 0), (2, n), (2, n), (3, n), (4, 0), (None, n)], key=str)
    assert plans["firsts"].count("Exchange hashpartitioning") == 2  # the texts and the least doc_ids, each once


def test_surroundings_of_all_places_go_once_the_distinct_ones_are_written(spark, monkeypatch):
    tables, plain = {}, suffix_dedup.written
    monkeypatch.setattr(suffix_dedup, "written", lambda df, name: tables.setdefault(name, plain(df, name)))
    text = "".join(map(str, range(100)))
    docs = spark.createDataFrame([(1, text), (2, "a" + text[:120]), (3, text[60:] + "b"), (4, "short"), (5, None)], "doc_id long, text string")
    found = suffix_dedup.remove_repeats(docs).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, found)) == [(1, 0), (2, 120), (3, len(text) - 60), (4, 0), (5, 0)]
    there = {k: os.path.exists(x.written_to.removeprefix("file://")) for k, x in tables.items()}
    assert {k for k, x in there.items() if x} == {"texts", "others", "heavy", "found"}


def test_anchors_are_not_looked_for_twice(spark):
    rng = np.random.default_rng(8)
    texts = {k: bytes(rng.integers(97, 99 + k, 400).astype(np.uint8)) for k in range(5)}
    rows = spark.createDataFrame([(k, k, x.decode()) for k, x in texts.items()], "row long, doc long, text string")
    packed = suffix_dedup._anchor_rows(rows).groupBy("row").agg(F.collect_list("place").alias("places"))
    parts = suffix_dedup._surrounding_rows(rows.join(packed, "row")).collect()
    expected = [(k, f, l - f + 1, x[f:l + suffix_dedup.LENGTH]) for k, x in texts.items() for f, l in zip(*(y.tolist() for y in suffix_dedup.anchors(x)[2:]), strict=True)]
    assert sorted((r.row, r.first, r.starts, bytes(r.bytes)) for r in parts) == sorted(expected)
    by_bytes = {}
    for r in parts:
        place = next(p for p, f in zip(*(y.tolist() for y in suffix_dedup.anchors(texts[r.row])[::2]), strict=True) if f == r.first)
        by_bytes.setdefault(texts[r.row][place:place + suffix_dedup.ANCHOR], set()).add(r.anchor)
    assert all(len(x) == 1 for x in by_bytes.values()) and len({y for x in by_bytes.values() for y in x}) == len(by_bytes)


def test_a_group_of_large_sets_is_compared_in_bounded_memory():
    """Sets of one family, none but two similar enough: first looks tell them apart, and pairs are never held all at once."""
    rng, size = np.random.default_rng(9), 500
    base = rng.integers(0, 1 << 63, size).astype(np.uint64)
    sets = []
    for _ in range(1200):
        x, change = base.copy(), rng.choice(size, rng.integers(150, 400), replace=False)
        x[change] = rng.integers(0, 1 << 63, len(change))
        sets.append(x)
    sets[7] = np.append(sets[3][:-40], rng.integers(0, 1 << 63, 40).astype(np.uint64))
    bits, made = 4096, []
    for x in sets:
        odd = np.bincount((partenum.mixed(x ^ np.uint64(0x5BD1E995)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
        made.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    n = len(sets)
    group = pa.table({"i": [0] * n, "j": [0] * n, "own": [0] * n, "set_key": range(n), "n": [size] * n, "c": range(n), "parity": pa.array(made, pa.binary())})
    tracemalloc.start()
    try:
        found = partenum._near_by_parity((4, 5))(group)
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
    finally:
        tracemalloc.stop()
    assert list(zip(found.column("u").to_pylist(), found.column("v").to_pylist(), strict=True)) == [(3, 7)]


def test_a_written_table_leaves_no_shuffle_files(spark):
    """Shuffles of many steps must not add up on disk until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    rows = spark.range(1000).repartition(3, "id").mapInArrow(lambda batches: batches, "id long")
    with shuffles_freed(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    held = tracker.shuffleStatuses().size()
    assert written(rows, "rows").count() == 1000
    assert tracker.shuffleStatuses().size() <= held + 1  # the count's own


def test_a_batch_of_texts_has_the_anchors_of_each_text():
    rng = np.random.default_rng(11)
    for _ in range(50):
        texts = [bytes(rng.integers(97, 97 + rng.integers(1, 5), rng.integers(0, 200)).astype(np.uint8)) for _ in range(rng.integers(0, 6))]
        of, *found = suffix_dedup.anchors_of(texts)
        for k, x in enumerate(texts):
            places, _, first, last = one = suffix_dedup.anchors(x)
            assert all(a[of == k].tolist() == b.tolist() for a, b in zip(found, one, strict=True))
            starts = [s for a, b in zip(first.tolist(), last.tolist(), strict=True) for s in range(a, b + 1)]
            assert starts == list(range(len(x) - suffix_dedup.LENGTH + 1))  # each string has one anchor, which lies in it
            assert all(b <= p <= a + suffix_dedup.WINDOW - 1 for p, a, b in zip(places.tolist(), first.tolist(), last.tolist(), strict=True))
