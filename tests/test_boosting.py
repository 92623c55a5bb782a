"""Leaf-wise boosting against a plain NumPy version that looks at one leaf at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wiretally.plans import boosting as B

FEATURES = ["a", "b", "c.d", "odd"]
SMALL = B.Growth(rounds=4, rate=0.3, leaves=7, bins=32, l2=1.0, least_rows=5)


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(5)
    n = 900
    a, b, c = r.integers(0, 12, n), r.integers(0, 3, n), r.normal(size=n).round(3)
    odd = [None if k % 7 == 0 else float("nan") if k % 11 == 0 else float(k % 4) for k in range(n)]
    y = ((a > 5) ^ (c > 0.3) ^ (r.random(n) < 0.1)).astype(int)
    made = spark.createDataFrame([(int(w), int(v), float(u), o, int(t), "x") for w, v, u, o, t in zip(a, b, c, odd, y)],
                                 "a int, b int, `c.d` double, odd double, y int, margin string")
    return made.repartition(5)


def _plain_tree(x, g, h, edges, growth):
    """(leaf of each row, value of each leaf) of one tree grown best-first, by looking at all cuts of all features each time."""
    def best(mine):
        found = (0.0, None, None)
        G, H = g[mine].sum(), h[mine].sum()
        for f, cuts in enumerate(edges):
            for cut in cuts:
                left = mine & (x[:, f] <= cut)
                right = mine & ~left
                if min(left.sum(), right.sum()) < growth.least_rows or min(h[left].sum(), h[right].sum()) < B.LEAST_HESSIAN:
                    continue
                gain = (g[left].sum() ** 2 / (h[left].sum() + growth.l2) + g[right].sum() ** 2 / (h[right].sum() + growth.l2) - G ** 2 / (H + growth.l2))
                if gain > found[0] + 1e-9:
                    found = (gain, f, cut)
        return found

    leaves = [(np.ones(len(x), bool), best(np.ones(len(x), bool)))]
    while len(leaves) < growth.leaves and max(b[0] for _, b in leaves) > 0:
        at = max(range(len(leaves)), key=lambda k: leaves[k][1][0])
        mine, (_, f, cut) = leaves.pop(at)
        for part in (mine & (x[:, f] <= cut), mine & (x[:, f] > cut)):
            leaves.append((part, best(part)))
    step = np.zeros(len(x))
    for mine, _ in leaves:
        step[mine] = -growth.rate * g[mine].sum() / (h[mine].sum() + growth.l2)
    return step, len(leaves)


@pytest.mark.parametrize("growth, most_leaves", [
    (SMALL, 7), (B.Growth(rounds=2, rate=0.1, leaves=12, bins=255, l2=5.0, least_rows=20), 4)])  # the penalty ends the second before its limit
def test_equals_plain_growth(rows, growth, most_leaves):
    model = B.fit_boosted(rows, FEATURES, "y", growth)
    out = model.margin(rows, "m").toPandas()
    x = np.nan_to_num(out[FEATURES].to_numpy(float), nan=-np.inf)
    y, edges = out["y"].to_numpy(float), B.bin_edges(rows, FEATURES, growth.bins)
    margin, sizes = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(growth.rounds):
        p = 1 / (1 + np.exp(-margin))
        step, leaves = _plain_tree(x, p - y, p * (1 - p), edges, growth)
        margin += step
        sizes.append(leaves)
    assert np.allclose(out["m"], margin, atol=1e-6)
    assert [int((t.left < 0).sum()) for t in model.trees[1:]] == sizes
    assert max(sizes) == most_leaves


def test_same_however_rows_are_dealt_out(rows):
    one, other = (B.fit_boosted(rows.repartition(n), FEATURES, "y", SMALL) for n in (1, 9))
    assert all(np.array_equal(a.value, b.value) and np.array_equal(a.cut, b.cut) for a, b in zip(one.trees, other.trees, strict=True))


def test_margins_settled_between_rounds(rows, monkeypatch):
    whole = B.fit_boosted(rows, FEATURES, "y", SMALL)
    monkeypatch.setattr(B, "SETTLED", 2)
    parts = B.fit_boosted(rows, FEATURES, "y", SMALL)
    assert all(np.allclose(a.value, b.value, atol=1e-9) for a, b in zip(whole.trees, parts.trees, strict=True))


def test_saved_and_loaded(rows, tmp_path):
    model = B.fit_boosted(rows, FEATURES, "y", SMALL)
    model.save(str(tmp_path / "m"))
    both = B.BoostedTrees.load(str(tmp_path / "m")).score(model.score(rows, "p"), "q")
    assert both.where("p <> q or p is null or p <= 0 or p >= 1").isEmpty()
    assert both.agg(F.avg(F.expr("int((p >= 0.5) = (y = 1))"))).first()[0] > 0.8


def test_edges(rows):
    edges = B.bin_edges(rows, FEATURES, 32)
    assert edges[0].tolist() == [k + 0.5 for k in range(11)]
    assert edges[1].tolist() == [0.5, 1.5]
    assert len(edges[2]) <= 31 and (np.diff(edges[2]) > 0).all()
    assert edges[3].tolist() == [np.finfo(float).min, 0.5, 1.5, 2.5]  # null and NaN below all others
    assert B._between(1.0, float("inf")) == 1.0


def test_one_label_few_rows_and_none(spark, rows):
    same = B.fit_boosted(rows.where("y = 1"), FEATURES, "y", SMALL)
    assert {len(t.left) for t in same.trees} == {1}
    few = B.fit_boosted(rows.limit(7), FEATURES, "y", SMALL)
    assert {len(t.left) for t in few.trees} == {1}
    with pytest.raises(ValueError):
        B.fit_boosted(rows.where("y = 5"), FEATURES, "y", SMALL)
    with pytest.raises(ValueError):
        B.fit_boosted(rows, [], "y", SMALL)
