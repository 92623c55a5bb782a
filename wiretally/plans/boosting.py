"""Leaf-wise gradient boosting for a 0/1 label, with second-order histograms summed by Spark and an L2 penalty on leaf values.

1. Each feature is cut into at most ``bins`` bins: between all its values where they are few, else at quantiles. The rows become
   one byte to a feature and are written once.
2. A tree grows best-first: the leaf whose split gains most is split next, until ``leaves`` leaves. A pass over the rows gives the
   histograms (gradient, Hessian, count per bin) of several nodes: tasks sum their rows, and what they found meets by
   (node, feature), where the best split is chosen. So the driver only sees one row per node and feature.
3. A pass takes the children of every leaf that might still be chosen, so that a tree costs about as many passes as it is deep,
   not one per split. Which leaves are split does not depend on that.
4. Gradients are summed as whole numbers (units of ``UNIT``): sums are the same however rows are dealt out or retried.
5. Every ``SETTLED`` rounds the margins are written; between, a task adds up the few trees since.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wiretally.functions.shape import sigmoid
from wiretally.session import released, scratch_path

#: Gradients and Hessians are rounded to this; nine thousand million rows fit the sum of one histogram cell.
UNIT = 2.0 ** -30
MOST_ROWS = 1 << 33
SETTLED = 20
ACCURACY = 20_000
LEAST_HESSIAN = 1e-3


@dataclass(frozen=True)
class Growth:
    """How trees grow. ``least_rows``: of a leaf."""
    rounds: int = 300
    rate: float = 0.1
    leaves: int = 31
    bins: int = 255
    l2: float = 1.0
    least_rows: int = 20

    def __post_init__(self):
        if not 2 <= self.bins <= 256 or self.leaves < 2 or self.rounds < 0 or self.least_rows < 1:
            raise ValueError(f"not a way to grow trees: {self}")


@dataclass
class Tree:
    """Nodes as arrays; node 0 is the root. An inner node sends values <= ``cut`` to ``left``; a leaf has ``left`` -1."""
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def reached(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of a (rows, features) array."""
        node, rows = np.zeros(len(x), np.int32), np.arange(len(x))
        while True:
            inner = self.left[node] >= 0
            if not inner.any():
                return node
            goes_left = x[rows, self.feature[node]] <= self.cut[node]
            node = np.where(inner, np.where(goes_left, self.left[node], self.right[node]), node)


@dataclass
class Split:
    """The best split of a node, or none (``gain`` 0), with the sums of the node and of its left child."""
    gain: float
    feature: int = 0
    bin: int = 0
    left: tuple[float, float, int] = (0.0, 0.0, 0)
    whole: tuple[float, float, int] = (0.0, 0.0, 0)

    @property
    def right(self) -> tuple[float, float, int]:
        return tuple(w - l for w, l in zip(self.whole, self.left, strict=True))


# --- bins ------------------------------------------------------------------------------------

def _few_values(df: DataFrame, features: Sequence[str], bins: int) -> dict[int, list[float]]:
    """All values of the features that have at most ``bins`` of them. A task stops looking at a feature once it has seen more."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray | None] = [np.empty(0)] * len(features)
        for batch in rows:
            for k, known in enumerate(seen):
                if known is not None:
                    both = np.unique(np.append(known, _plain(batch.column(k))))
                    seen[k] = both if len(both) <= bins else None
        found = [(k, v) for k, values in enumerate(seen) for v in (values if values is not None else [np.nan])]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([v for _, v in found], pa.float64())], ["feature", "value"])

    found = df.select(_numbers(features)).mapInArrow(run, "feature int, value double").distinct()
    cut = F.count("*") <= bins
    few = found.groupBy("feature").agg(F.when(cut & ~F.bool_or(F.isnan("value")), F.sort_array(F.collect_set("value"))).alias("values"))
    return {r.feature: r["values"] for r in few.collect() if r["values"] is not None}


def _plain(column: pa.Array) -> np.ndarray:
    """Values as float64; null and NaN count as less than all others."""
    x = column.to_numpy(zero_copy_only=False).astype(np.float64)
    return np.where(np.isnan(x), -np.inf, x)


def _between(low: float, high: float) -> float:
    """A finite cut that ``low`` lies on or below and ``high`` above."""
    middle = low / 2 + high / 2
    if np.isfinite(middle) and low <= middle < high:
        return middle
    return low if np.isfinite(low) else np.finfo(float).min


def _numbers(columns: Sequence[str]) -> list[Column]:
    """Named by place, whatever the columns' own names."""
    return [F.col("`" + c.replace("`", "``") + "`").cast("double").alias(f"x{k}") for k, c in enumerate(columns)]


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = 255, accuracy: int = ACCURACY) -> list[np.ndarray]:
    """Rising cuts of each feature, at most ``bins`` - 1: halfway between neighbouring values where there are at most ``bins``,
    else quantiles of the rows (mergeable summaries). Bin b holds the values above cut b - 1 and up to cut b."""
    few = _few_values(df, features, bins)
    many = [c for k, c in enumerate(features) if k not in few]
    ranks = [k / bins for k in range(1, bins)]
    found = df.agg(*[F.percentile_approx(F.when(~F.isnan(c), c), ranks, accuracy) for c in _numbers(many)]).first() if many else ()
    edges = []
    for k, c in enumerate(features):
        if k in few:
            edges.append(np.array([_between(a, b) for a, b in zip(few[k], few[k][1:])]))
        else:
            edges.append(np.unique(np.array(found[many.index(c)], float)))
    return edges


def _binned(df: DataFrame, features: Sequence[str], label: str, edges: list[np.ndarray]) -> DataFrame:
    """(x, y, margin): a byte per feature, the label, and a margin of 0."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            x = np.empty((batch.num_rows, len(edges)), np.uint8)
            for k, cuts in enumerate(edges):
                x[:, k] = np.searchsorted(cuts, _plain(batch.column(k)), side="left")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(len(edges)), pa.array(np.zeros(len(x)))], ["x", "y", "margin"])

    return df.select(*_numbers([*features, label])).mapInArrow(run, "x binary, y double, margin double")


def _unpacked(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(batch.num_rows, width)


# --- one tree --------------------------------------------------------------------------------

def best_split(sums: np.ndarray, growth: Growth) -> Split:
    """The best cut of one feature, from its (bins, 3) sums of gradient, Hessian and count. Equal gains: the lowest cut."""
    left = np.cumsum(sums, axis=0)[:-1]
    whole = sums.sum(axis=0)
    right = whole - left

    def worth(s: np.ndarray) -> np.ndarray:
        return (s[..., 0] * UNIT) ** 2 / (s[..., 1] * UNIT + growth.l2)

    allowed = np.minimum(left[:, 2], right[:, 2]) >= growth.least_rows
    allowed &= np.minimum(left[:, 1], right[:, 1]) * UNIT >= LEAST_HESSIAN
    gain = np.where(allowed, worth(left) + worth(right) - worth(whole), 0.0)
    of = lambda s: (float(s[0]) * UNIT, float(s[1]) * UNIT, int(s[2]))
    at = int(np.argmax(gain)) if len(gain) else 0
    if not len(gain) or gain[at] <= 0:
        return Split(0.0, whole=of(whole))
    return Split(float(gain[at]), bin=at, left=of(left[at]), whole=of(whole))


def split_gains(state: DataFrame, trees: list[Tree], growing: Tree, nodes: list[int], width: int, growth: Growth) -> DataFrame:
    """(node, feature, gain, bin, left, whole): the best cut of each feature in each of some nodes of a growing tree, over rows
    (x, y, margin). ``trees`` are those the margins lack."""
    bins, order = growth.bins, np.full(len(growing.left), -1, np.int64)
    order[nodes] = np.arange(len(nodes))

    def sums(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(nodes) * width * bins), np.int64)
        for batch in rows:
            x = _unpacked(batch, width)
            of = order[growing.reached(x)]
            here = of >= 0
            x, of = x[here], of[here]
            margin = batch.column("margin").to_numpy()[here]
            for tree in trees:
                margin = margin + tree.value[tree.reached(x)]
            p = 1 / (1 + np.exp(-margin))
            steps = [np.rint((p - batch.column("y").to_numpy()[here]) / UNIT), np.rint(p * (1 - p) / UNIT), None]
            cell = ((of[:, None] * width + np.arange(width)) * bins + x).ravel()
            for k, step in enumerate(steps):  # whole numbers far below 2 ** 53: these sums are exact
                total[k] += np.bincount(cell, None if step is None else np.repeat(step, width), total.shape[1]).astype(np.int64)
        cells = total.reshape(3, len(nodes) * width, bins)
        held = np.flatnonzero(cells[2].any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(nodes, np.int32)[held // width]), pa.array((held % width).astype(np.int32)),
                                          pa.array([cells[:, k].tobytes() for k in held], pa.binary())], ["node", "feature", "sums"])

    def chosen(table: pa.Table) -> pa.Table:
        added = np.sum([np.frombuffer(x, np.int64) for x in table.column("sums").to_pylist()], axis=0).reshape(3, bins)
        best = best_split(added.T, growth)
        return pa.table({"node": table.column("node")[:1], "feature": table.column("feature")[:1], "gain": [best.gain], "bin": pa.array([best.bin], pa.int32()),
                         "left": [[float(v) for v in best.left]], "whole": [[float(v) for v in best.whole]]})

    return state.mapInArrow(sums, "node int, feature int, sums binary").groupBy("node", "feature").applyInArrow(
        chosen, "node int, feature int, gain double, bin int, left array<double>, whole array<double>")


@dataclass
class _Growing:
    """A tree on the driver: splits that are known, and children that were made for them."""
    growth: Growth
    splits: list[Split | None] = field(default_factory=lambda: [None])
    children: dict[int, tuple[int, int]] = field(default_factory=dict)

    def as_tree(self, inner: set[int] | None = None) -> Tree:
        """All nodes, or only those below inner nodes of a set (numbered anew), with values."""
        order = list(range(len(self.splits))) if inner is None else [0]
        if inner is None:
            inner = self.children.keys()
        else:
            for v in order:
                order.extend(self.children[v] if v in inner else ())
        at = {v: i for i, v in enumerate(order)}
        whole = {0: self.splits[0].whole if self.splits[0] else (0.0, 0.0, 0)}
        for v in order:
            if v in inner:
                whole |= dict(zip(self.children[v], (self.splits[v].left, self.splits[v].right), strict=True))
        side = lambda v, k: at[self.children[v][k]] if v in inner else -1
        split = lambda v: self.splits[v] if v in inner else Split(0.0)
        return Tree(np.array([split(v).feature for v in order], np.int32), np.array([split(v).bin for v in order], float), np.array([side(v, 0) for v in order], np.int32),
                    np.array([side(v, 1) for v in order], np.int32), np.array([-self.growth.rate * whole[v][0] / (whole[v][1] + self.growth.l2) for v in order]))

    def chosen(self) -> tuple[set[int], list[int]]:
        """The nodes that best-first growth splits as far as gains are known, and the nodes to be looked at before it can go on."""
        inner: set[int] = set()
        open_: list[tuple[float, int]] = []

        def offer(v: int) -> None:
            if self.splits[v].gain > 0:
                heapq.heappush(open_, (-self.splits[v].gain, v))

        offer(0)
        while open_ and len(inner) + 1 < self.growth.leaves:
            _, v = heapq.heappop(open_)
            inner.add(v)
            if v not in self.children:
                self.children[v] = (len(self.splits), len(self.splits) + 1)
                self.splits += [None, None]
            if len(inner) + 1 == self.growth.leaves:
                break
            unknown = [c for c in self.children[v] if self.splits[c] is None]
            if unknown:  # with them, those of the leaves that may come next
                for _, u in heapq.nsmallest(self.growth.leaves - len(inner) - 1, open_):
                    if u not in self.children:
                        self.children[u] = (len(self.splits), len(self.splits) + 1)
                        self.splits += [None, None]
                        unknown += self.children[u]
                return inner, unknown
            for c in self.children[v]:
                offer(c)
        return inner, []

    def counted(self, v: int) -> tuple[float, float, int]:
        parent, k = next((p, pair.index(v)) for p, pair in self.children.items() if v in pair)
        return self.splits[parent].left if k == 0 else self.splits[parent].right


def _grown(state: DataFrame, trees: list[Tree], width: int, growth: Growth) -> Tree:
    tree, wanted = _Growing(growth), [0]
    while True:
        if wanted:
            best: dict[int, Split] = {}
            # Among equal gains the first feature; the rows collected are one per node and feature.
            for r in split_gains(state, trees, tree.as_tree(), wanted, width, growth).orderBy("node", "feature").collect():
                if r.node not in best or r.gain > best[r.node].gain:
                    best[r.node] = Split(r.gain, r.feature, r.bin, tuple(r.left), tuple(r.whole))
            for v in wanted:
                tree.splits[v] = best[v]
        inner, unknown = tree.chosen()
        if not unknown:
            return tree.as_tree(inner)
        small = {c for c in unknown if tree.counted(c)[2] < 2 * growth.least_rows}  # no cut leaves enough rows on both sides
        for v in small:
            tree.splits[v] = Split(0.0, whole=tree.counted(v))
        wanted = [c for c in unknown if c not in small]


# --- the model -------------------------------------------------------------------------------

@dataclass
class BoostedTrees:
    """Trees over named features; the first is a single leaf, the log odds of the label."""
    features: list[str]
    trees: list[Tree]

    def margin(self, df: DataFrame, output: str = "margin") -> DataFrame:
        """Add the sum of the trees. Null and NaN count as less than all other values."""
        trees = self.trees

        @F.pandas_udf("double")
        def added(rows: pd.DataFrame) -> pd.Series:
            x = rows.to_numpy(np.float64)
            x = np.where(np.isnan(x), -np.inf, x)
            total = np.zeros(len(x))
            for tree in trees:
                total += tree.value[tree.reached(x)]
            return pd.Series(total)

        return df.withColumn(output, added(F.struct(*_numbers(self.features))))

    def score(self, df: DataFrame, output: str = "probability") -> DataFrame:
        """Add the probability of label 1."""
        return self.margin(df, output).withColumn(output, sigmoid(F.col(output)))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        rows = [(t, v, int(x.feature[v]), float(x.cut[v]), int(x.left[v]), int(x.right[v]), float(x.value[v]))
                for t, x in enumerate(self.trees) for v in range(len(x.left))]
        spark.createDataFrame(rows, "tree int, node int, feature int, cut double, left int, right int, value double").coalesce(1).write.mode(
            "overwrite").parquet(os.path.join(path, "nodes"))
        spark.createDataFrame(list(enumerate(self.features)), "feature int, name string").coalesce(1).write.mode("overwrite").parquet(
            os.path.join(path, "features"))

    @classmethod
    def load(cls, path: str) -> BoostedTrees:
        spark = SparkSession.getActiveSession()
        nodes = spark.read.parquet(os.path.join(path, "nodes")).orderBy("tree", "node").toPandas()  # a model: rounds x leaves rows
        names = [r.name for r in spark.read.parquet(os.path.join(path, "features")).orderBy("feature").collect()]
        return cls(names, [Tree(g.feature.to_numpy(np.int32), g.cut.to_numpy(float), g.left.to_numpy(np.int32), g.right.to_numpy(np.int32), g.value.to_numpy(float))
                           for _, g in nodes.groupby("tree", sort=True)])


def _leaf(value: float) -> Tree:
    return Tree(np.zeros(1, np.int32), np.zeros(1), np.full(1, -1, np.int32), np.full(1, -1, np.int32), np.array([value]))


def _log_odds(df: DataFrame, label: str) -> float:
    y = _numbers([label])[0]
    seen = df.where(y.isNotNull()).agg(F.count("*").alias("n"), F.avg(y).alias("p")).first()
    if not 0 < seen.n < MOST_ROWS:
        raise ValueError(f"{seen.n} labelled rows; boosting takes 1 to {MOST_ROWS}")
    p = min(max(seen.p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def first_splits(df: DataFrame, features: Sequence[str], label: str = "y", growth: Growth = Growth()) -> DataFrame:
    """(feature, cut, gain, rows_left): the best cut of each feature at the root of the first tree, where one gains something."""
    features, base = list(features), _leaf(_log_odds(df, label))
    rows = df.where(_numbers([label])[0].isNotNull())
    edges = bin_edges(rows, features, growth.bins)
    cuts = df.sparkSession.createDataFrame([(k, b, features[k], float(cut)) for k, e in enumerate(edges) for b, cut in enumerate(e)],
                                           "place int, bin int, feature string, cut double")
    best = split_gains(_binned(rows, features, label, edges), [base], _Growing(growth).as_tree(), [0], len(features), growth)
    return best.where("gain > 0").withColumnRenamed("feature", "place").join(cuts, ["place", "bin"]).select(
        "feature", "cut", "gain", F.col("left")[2].cast("long").alias("rows_left"))


def fit_boosted(df: DataFrame, features: Sequence[str], label: str = "y", growth: Growth = Growth()) -> BoostedTrees:
    """Fit on rows with numeric ``features`` and a label of 0 or 1 (rows with a null label take no part).

    Null and NaN features count as less than all others. With one label only, or too few rows to split, the model is constant. A
    table without labelled rows is refused. Other columns don't matter, whatever their names."""
    spark, features = df.sparkSession, list(features)
    if not features:
        raise ValueError("no features")
    base, rows = _leaf(_log_odds(df, label)), df.where(_numbers([label])[0].isNotNull())
    edges = bin_edges(rows, features, growth.bins)
    state, path, trees, since = _binned(rows, features, label, edges), None, [], [base]

    def settled(now: DataFrame, recent: list[Tree], old: str | None) -> tuple[DataFrame, str]:
        """The rows with margins of all trees so far, written; what they were read from goes."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _unpacked(batch, len(features))
                margin = batch.column("margin").to_numpy() + sum(t.value[t.reached(x)] for t in recent)
                yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(margin)], ["x", "y", "margin"])

        made = scratch_path(spark, "margins")
        now.mapInArrow(run, now.schema).write.parquet(made)
        if old is not None:
            released(spark, old)
        return spark.read.schema(now.schema).parquet(made), made

    try:
        for turn in range(growth.rounds):
            if turn % SETTLED == 0:
                state, path = settled(state, since, path)
                trees, since = trees + since, []
            since.append(_grown(state, since, len(features), growth))
    finally:
        if path is not None:
            released(spark, path)
    trees += since

    def unbinned(tree: Tree) -> Tree:
        inner = tree.left >= 0
        cut = np.array([edges[f][int(b)] if i else 0.0 for f, b, i in zip(tree.feature, tree.cut, inner, strict=True)])
        return Tree(tree.feature, cut, tree.left, tree.right, tree.value)

    return BoostedTrees(features, [unbinned(t) for t in trees])
