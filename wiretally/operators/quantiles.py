"""Exact order statistics without a global sort.

The value range is cut into equal cells, the cells are counted, and only the cell that holds the
wanted rank is looked into again. Cells are a monotone function of the value, so the result is
exact; ties are merged, so a value shared by most rows is one row.

Over a whole table the rounds go on until a cell holds at most ``DIRECT`` distinct values, and
only those reach the driver. Per group, the cells are not of equal width, which outliers on several scales would leave
nearly full: a mergeable quantile summary of each group proposes them, they are counted exactly, and that is repeated over all groups
at once until what is left around a wanted rank is ``LAST`` values at most."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wiretally.session import settle, tabled

CELLS = 4096
DIRECT = 50_000
#: Per group: bounds that a summary proposes, its accuracy, and how many different values are ranked at once.
GRID = 512
ACCURACY = 20_000
LAST = 10_000
Rank = Callable[[Column], Column]


def _cell(v: Column, lo: Column, hi: Column) -> Column:
    """Cell of ``v`` between ``lo`` and ``hi``; one cell when the range is a point."""
    v, lo, hi = v.cast("double"), lo.cast("double"), hi.cast("double")
    at = F.floor((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * CELLS)
    return F.coalesce(F.least(at, F.lit(CELLS - 1)), F.lit(0)).cast("int")


def _pick(counts: DataFrame, rank: int):
    """Value at a rank of a (value, count) table of at most ``DIRECT`` rows."""
    table = counts.toArrow().sort_by("_v")
    at = np.searchsorted(np.cumsum(table.column("_w").to_numpy()), rank, side="right")
    return table.column("_v")[int(at)].as_py()


def _at_rank(counts: DataFrame, rank: int, lo, hi, distinct: int):
    """Value at a rank of a (value, count) table whose values lie in [lo, hi]."""
    while distinct > DIRECT:
        cell = _cell(F.col("_v"), F.lit(lo), F.lit(hi))
        cells = (counts.groupBy(cell.alias("c"))
                 .agg(F.sum("_w").alias("w"), F.count("*").alias("d"), F.min("_v").alias("a"), F.max("_v").alias("b"))
                 .orderBy("c").collect())
        for row in cells:
            if rank < row.w:
                break
            rank -= row.w
        counts = counts.where(F.col("_v").between(F.lit(row.a), F.lit(row.b)))
        lo, hi, distinct = row.a, row.b, row.d
    return _pick(counts, rank)


def order_values(df: DataFrame, value: str | Column, ranks: Callable[[int], dict[str, int]]) -> dict:
    """Values at 0-based ranks over the whole table, as plain numbers. ``ranks`` maps the number
    of non-null values to the wanted ranks, which are clipped to the table; an empty table gives
    None for each. The count itself is returned as ``n``."""
    v = F.col(value) if isinstance(value, str) else value
    counts = (df.select(v.alias("_v")).where(F.col("_v").isNotNull()).groupBy("_v")
              .agg(F.count("*").alias("_w")).persist())
    try:
        size = counts.agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("n"), F.min("_v").alias("lo"),
                          F.max("_v").alias("hi"), F.count("*").alias("d"), _non_finite(counts, "_v").alias("odd")).first()
        _refuse_non_finite(str(value), size.odd)
        out = {"n": size.n}
        for name, rank in ranks(size.n).items():
            out[name] = None if size.n == 0 else _at_rank(
                counts, max(0, min(int(rank), size.n - 1)), size.lo, size.hi, size.d)
        return out
    finally:
        counts.unpersist()


def _refuse_non_finite(column: str, found: int | None) -> None:
    if found:
        raise ValueError(f"order statistics of {column} need finite values; {found} are NaN or infinite")


def _non_finite(df: DataFrame, column: str) -> Column:
    """How many values of a floating-point column have no place on the number line; 0 for other types."""
    if dict(df.dtypes)[column] not in ("double", "float"):
        return F.lit(0)
    c = F.col(column)
    return F.count_if(F.isnan(c) | (F.abs(c) == float("inf")))


def _bracketed(cells: DataFrame, wanted: DataFrame, by: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One round: a mergeable quantile summary per cell proposes ``GRID`` + 1 bounds, the three steps around each wanted rank are
    counted exactly, and the values between them are the new cells. ``cells`` has the columns ``keys`` and ``_v``; ``wanted`` has
    ``by``, ``_pick``, ``_rank``, the rank within the cell. Returns both, narrowed."""
    grid = F.percentile_approx("_v", [k / GRID for k in range(GRID + 1)], ACCURACY)
    summary = tabled(cells.groupBy(*keys).agg(grid.alias("_g"), F.count("*").alias("_size")), "summary")
    at = F.floor(F.col("_rank") / F.col("_size") * GRID).cast("int")
    spans = wanted.join(summary, list(keys)).select(
        *by, "_pick", "_rank", F.get("_g", F.greatest(at - 1, F.lit(0))).alias("_lo"), F.get("_g", F.least(at + 2, F.lit(GRID))).alias("_hi"))
    spans = tabled(spans, "spans")
    placed = cells.join(spans, list(keys))
    counts = placed.groupBy(*by, "_pick").agg(
        F.count_if(F.col("_v") < F.col("_lo")).alias("_below"), F.count_if(F.col("_v").between(F.col("_lo"), F.col("_hi"))).alias("_inside"))
    narrowed = tabled(spans.join(counts, [*by, "_pick"]).withColumn("_rank", F.col("_rank") - F.col("_below")), "ranks")
    lost = narrowed.where("_rank < 0 OR _rank >= _inside").count()
    if lost:
        raise ArithmeticError(f"{lost} summaries missed their rank")  # their error is bounded by 1 / ACCURACY, far less than a step
    inside = placed.where(F.col("_v").between(F.col("_lo"), F.col("_hi"))).select(*by, "_pick", "_v")
    return tabled(inside, "cells"), narrowed.select(*by, "_pick", "_rank")


def order_statistics(df: DataFrame, value: str | Column, ranks: dict[str, Rank],
                     by: Sequence[str]) -> DataFrame:
    """Per group: the count ``n`` and the non-null ``value`` at each 0-based rank. Ranks are functions of the count (they may also use the
    group columns) and are clipped to the group. Groups with at most ``LAST`` different values are ranked at once; those with
    more are narrowed, all together, until what is left around each rank is that small. NaN and infinity raise ValueError."""
    by = list(by)
    v = F.col(value) if isinstance(value, str) else value
    rows = tabled(df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull()), "values")
    merged = tabled(rows.groupBy(*by, "_v").agg(F.count("*").alias("_w")), "merged")
    sizes = tabled(merged.groupBy(*by).agg(F.sum("_w").alias("n"), F.count("*").alias("_d"), _non_finite(rows, "_v").alias("_odd")), "sizes")
    seen = sizes.agg(F.max("_d").alias("d"), F.sum("_odd").alias("odd")).first()
    _refuse_non_finite(str(value), seen.odd)
    n = F.col("n")
    picks = F.explode(F.array(*[
        F.struct(F.lit(k).alias("pick"), F.greatest(F.least(r(n).cast("bigint"), n - 1), F.lit(0).cast("bigint")).alias("rank"))
        for k, r in ranks.items()]))
    wanted = tabled(sizes.select(*by, "_d", picks.alias("_p")).select(*by, "_d", F.col("_p.pick").alias("_pick"), F.col("_p.rank").alias("_rank")), "picks")
    small = merged.join(wanted.where(F.col("_d") <= LAST), by).select(*by, "_pick", "_rank", "_v", "_w")
    if (seen.d or 0) > LAST:
        large = wanted.where(F.col("_d") > LAST).select(*by, "_pick", "_rank")
        cells, keys = rows.join(sizes.where(F.col("_d") > LAST).select(*by), by), by
        while True:
            cells, large = _bracketed(cells, large, by, keys)
            keys = [*by, "_pick"]
            left = tabled(cells.groupBy(*keys, "_v").agg(F.count("*").alias("_w")), "merged")
            if (left.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= LAST:
                break
        small = small.unionByName(left.join(large, keys).select(*by, "_pick", "_rank", "_v", "_w"))
    upto = F.sum("_w").over(W.partitionBy(*by, "_pick").orderBy("_v"))
    final = small.withColumn("_upto", upto).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_w")))
    found = final.groupBy(*by).agg(*[F.max(F.when(F.col("_pick") == k, F.col("_v"))).alias(k) for k in ranks])
    return settle(sizes.select(*by, "n").join(found, by))


def _higher_rank(n: int, q: float) -> int:
    at = (n - 1) * q
    return int(at) + (at > int(at))


def quantile_higher(df: DataFrame, value: str | Column, q: float, empty: float | None = None) -> float | None:
    """The order statistic at ``ceil(q (n - 1))``."""
    found = order_values(df, value, lambda n: {"v": _higher_rank(n, q)})["v"]
    return empty if found is None else found


def quantile_linear(df: DataFrame, value: str | Column, q: float) -> float | None:
    """Linear interpolation between the two order statistics around ``q (n - 1)``."""
    found = order_values(df, value, lambda n: {"low": int((n - 1) * q), "high": _higher_rank(n, q)})
    if found["low"] is None:
        return None
    at = (found["n"] - 1) * q
    return found["low"] + (found["high"] - found["low"]) * (at - int(at))


def group_quantile_linear(df: DataFrame, value: str | Column, q: float, by: Sequence[str],
                          name: str = "quantile") -> DataFrame:
    """The same per group, with the group's count ``n``."""
    at = (F.col("n") - 1) * F.lit(q)
    found = order_statistics(df, value, {
        "_low": lambda n: F.floor((n - 1) * F.lit(q)), "_high": lambda n: F.ceil((n - 1) * F.lit(q))}, by)
    value_at = F.col("_low") + (F.col("_high") - F.col("_low")) * (at - F.floor(at))
    return found.withColumn(name, value_at).drop("_low", "_high")


def budget_thresholds(scores: DataFrame, score: str | Column,
                      budgets: Sequence[float] = (0.01, 0.05)) -> dict[float, float]:
    """Alert threshold per false-positive budget, from the scores of calibration benign rows:
    the ``1 - budget`` quantile of kind "higher", 0.5 when there are none."""
    found = order_values(scores, score, lambda n: {str(a): _higher_rank(n, 1 - a) for a in budgets})
    return {a: 0.5 if found[str(a)] is None else found[str(a)] for a in budgets}


def group_budget_thresholds(scores: DataFrame, score: str | Column, by: Sequence[str],
                            budgets: Sequence[float] = (0.01, 0.05)) -> DataFrame:
    """The same for many calibration sets at once: one row per group and budget."""
    names = {f"b{i}": a for i, a in enumerate(budgets)}
    found = order_statistics(scores, score, {
        k: (lambda n, a=a: F.ceil((n - 1) * F.lit(1 - a))) for k, a in names.items()}, by)
    rows = F.explode(F.array(*[
        F.struct(F.lit(a).alias("budget"), F.col(k).alias("threshold")) for k, a in names.items()]))
    return found.select(*by, rows.alias("_t")).select(*by, "_t.budget", "_t.threshold")


def smallest(df: DataFrame, value: str, n: int | Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose ``value`` is among the ``n`` smallest (per group), found by a cut-off instead
    of a sort. Rows equal to the cut-off all stay, so pass a value without ties."""
    if not by:
        cut = order_values(df, value, lambda _: {"cut": n - 1})["cut"]
        return df.where(F.col(value) <= F.lit(cut))
    last = n - 1 if isinstance(n, Column) else F.lit(n - 1)
    cut = order_statistics(df, value, {"_cut": lambda _: last}, by).drop("n")
    return df.join(cut, list(by)).where(F.col(value) <= F.col("_cut")).drop("_cut")
