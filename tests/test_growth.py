"""What keeps steps in proportion to the input: even partitions before costly steps, bounded pieces in tasks, tables read once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wiretally.functions import shape
from wiretally.operators import neighbours, quality
from wiretally.plans import detector as D, jobs


def test_training_rows_are_dealt_out_before_anything_is_made_of_them(spark):
    one = spark.range(0, 3000, 1, 1)
    made = D._training_rows(one, lambda rows: rows.select("id", F.spark_partition_id().alias("part")))
    try:
        assert made.select("part").distinct().count() > 1
        assert made.select("id").distinct().count() == 3000
    finally:
        made.unpersist()


def test_sets_are_dealt_out_before_they_are_scored(spark):
    row = spark.range(0, 400, 1, 1).select("id", *[F.lit("x").alias(c) for c in jobs.REQUEST])
    sets = jobs._sets({"a": row, "b": None, "c": row})
    assert sets.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {r.evaluation_set: r["count"] for r in sets.groupBy("evaluation_set").count().collect()} == {"a": 400, "c": 400}


def test_copies_of_queries_leave_in_bounded_pieces(spark):
    """Rows without clusters: every query goes to every block, yet no batch holds all copies."""
    rng = np.random.default_rng(7)
    seen = {}

    class Frame:
        schema = None

        def mapInArrow(self, run, schema):
            seen["run"] = run

        def select(self, *names):
            return self

        def limit(self, n):
            return self

        def withColumn(self, name, value):
            return self

    n = 64 * neighbours.RINGS
    cells = neighbours.Cells(np.repeat(np.arange(64), neighbours.RINGS), np.tile(np.arange(neighbours.RINGS), 64), np.zeros(n), np.full(n, np.pi), np.full(n, 1))
    pivots = pa.table({"v": [[1.0, 0.0]] * 64})
    kind = neighbours.Kind(["v"], lambda rows, p: rng.uniform(-1, 1, (rows.num_rows, 64)), None, None)
    neighbours._visits(Frame(), kind, pivots, cells, False)
    batch = pa.RecordBatch.from_pydict({"query_id": pa.array(range(20), pa.int64()), "v": [[1.0, 0.0]] * 20,
                                        "home": pa.array([-1] * 20, pa.int64()), "similarity": [-2.0] * 20})
    pieces = list(seen["run"](iter([batch])))
    assert sum(p.num_rows for p in pieces) == 20 * n
    assert max(p.num_rows for p in pieces) <= neighbours.VISITS
    pairs = {(q, b) for p in pieces for q, b in zip(p.column("query_id").to_pylist(), p.column("block").to_pylist(), strict=True)}
    assert len(pairs) == 20 * n


def test_entropy_counts_bounded_pieces(spark, monkeypatch):
    held = []
    counted = shape._entropies
    monkeypatch.setattr(shape, "CHARACTERS", 10)
    monkeypatch.setattr(shape, "_entropies", lambda texts, lengths: held.append(int(lengths.sum())) or counted(texts, lengths))
    texts = ["", "aab", None, "abcdefghij", "x" * 25 + "y" * 25, "é\U0001F600é", "", "ab"]

    def plain(s):
        s = s or ""
        return abs(-sum(s.count(c) / len(s) * np.log2(s.count(c) / len(s)) for c in set(s)))

    found = shape.entropy.func(pa.array(texts)).to_pylist()
    assert found == pytest.approx([plain(s) for s in texts])
    assert max(held) <= 10
    assert shape.entropy.func(pa.array([], pa.string())).to_pylist() == []


def test_purity_reads_its_rows_once(spark):
    """The rows to be matched are the end of a long plan: it runs once, and only source and time go on."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame(
        [("10.0.0.1", f"2024-01-01T00:00:{s:02d}.000Z", "benign", "body") for s in range(40)] + [("10.0.0.2", None, "benign", "body"), (None, "2024-01-01T00:00:05.000Z", "attack", "")],
        "src_ip string, timestamp string, label string, request_body string")
    campaigns = spark.createDataFrame(
        [(o, f"c{o}", "vampi", label, None, None, "10.0.0.1", a, b) for o, label, a, b in [
            ("1", "attack", "2024-01-01T00:00:10.000Z", "2024-01-01T00:00:19.000Z"), ("2", "benign", "2024-01-01T00:00:00.000Z", "2024-01-01T00:00:39.000Z")]],
        "ord string, campaign_id string, app string, label string, attack_family string, attack_tool string, src_ip string, start_ts string, end_ts string")
    once = rows.mapInArrow(counted, rows.schema)
    assert [tuple(r) for r in quality.benign_purity(once, campaigns).collect()] == [("benign_purity", False, 10.0)]
    assert read.value == 42


def test_corpus_reads_its_campaigns_once(small):
    """However many captures there are: campaigns may be the end of a long plan."""
    read = small.spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    bare = small.flows.drop("label", "attack_family", "attack_tool")
    captures = [bare.where(F.col("row_id") % 2 == k) for k in (0, 1)]
    corpus, _ = jobs.build_corpus(captures, small.campaigns.mapInArrow(counted, small.campaigns.schema), True)
    assert corpus.count() > 0
    assert read.value == small.campaigns.count()


def test_texts_give_the_same_neighbours_as_their_vectors(spark, monkeypatch):
    """The operator moves texts where it is told how to read them; also in several blocks, with repeats, nulls and texts without terms."""
    from wiretally.plans.vectors import TfIdf
    for name, few in (("BLOCK_ROWS", 8), ("PRODUCTS", 50), ("HELD", 60), ("TOGETHER", 7)):
        monkeypatch.setattr(neighbours, name, few)
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcd e\u00e9"), rng.integers(0, 30))) for _ in range(120)] + ["", None, "ab", "zzzzzz"] * 2
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, s string")
    train, target = rows.where("row_id % 2 = 0"), rows.where("row_id % 2 = 1 OR s IS NULL")
    model = TfIdf("s", "v").fit(train)
    as_terms = lambda df: model.weights(model.transform(df), "v").where("s IS NOT NULL").select("row_id", "terms", "weights")
    by_vectors = neighbours.nearest_sparse(as_terms(target), as_terms(train), "row_id")
    by_texts = neighbours.nearest_sparse(target, train, "row_id", ["s"], model.reader(), "length(s) <= 20", "length(s) > 2")
    found, expected = ({r.query_id: r.similarity for r in df.collect()} for df in (by_texts, by_vectors))
    assert len(expected) == target.where("s IS NOT NULL").count()
    assert found == pytest.approx(expected)


def test_products_of_postings_are_held_in_bounded_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    held, dense = [], np.where(rng.random((90, 40)) < 0.4, rng.normal(size=(90, 40)), 0.0)
    dense[3] = 0

    def sparse(m):
        rows, terms = np.nonzero(m)
        return np.bincount(rows, minlength=len(m)), terms, m[rows, terms]

    counted = np.bincount
    monkeypatch.setattr(neighbours, "PRODUCTS", 100)
    few = neighbours._Postings(*sparse(dense[:20]))
    monkeypatch.setattr(neighbours.np, "bincount", lambda x, *a, **k: held.append(len(x)) or counted(x, *a, **k))
    found = few.dots(*sparse(dense[20:]))
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
    assert found == pytest.approx(unit(dense[20:]) @ unit(dense[:20]).T)
    assert max(held[2:]) <= 100  # after the counts of the rows themselves
