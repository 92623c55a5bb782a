"""Top alerts, seeded samples and slices. Places in a seeded shuffle come from a hash of the row
key, so they do not depend on partitioning; they differ from a sequential generator's."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wiretally.functions import hashing as H
from wiretally.operators.dedup import first_per_key
from wiretally.operators.quantiles import order_values, smallest


def top_alerts(df: DataFrame, score: str, threshold: float | Column, n: int = 100,
               tie: str = "row_id") -> DataFrame:
    """The ``n`` highest scores at or above the threshold: a report, so it fits one task."""
    return df.where(F.col(score) >= threshold).orderBy(F.col(score).desc(), tie).limit(n)


def place(key: str | Column, seed: int) -> Column:
    return H.shuffle_rank_key((F.col(key) if isinstance(key, str) else key).cast("string"), seed)


def seeded_sample(df: DataFrame, n: int, key: str | Column, by: Sequence[str] = (),
                  seed: int = H.SEED) -> DataFrame:
    """``n`` rows (per group) drawn by hash; everything where there are no more than ``n``."""
    return smallest(df.withColumn("_place", place(key, seed)), "_place", n, by).drop("_place")


def slice_cuts(places: DataFrame, place: str, first: Callable[[int], int], second: Callable[[int], int]
               ) -> tuple[int, int]:
    """Cut-offs of two consecutive runs of a shuffle, each given as a size in terms of the count."""
    found = order_values(places, place, lambda n: {"a": first(n) - 1, "b": first(n) + second(n) - 1})
    return (-1, -1) if found["n"] == 0 else (found["a"], found["b"])


def seeded_slices(df: DataFrame, key: str | Column, first: tuple[str, int], second: tuple[str, int],
                  seed: int = H.SEED) -> DataFrame:
    """Column ``slice``: two consecutive runs of a seeded shuffle, given as (name, rows); rows
    beyond both get null."""
    placed = df.withColumn("_place", place(key, seed))
    a, b = slice_cuts(placed, "_place", lambda _: first[1], lambda _: second[1])
    which = F.when(F.col("_place") <= a, first[0]).when(F.col("_place") <= b, second[0])
    return placed.withColumn("slice", which).drop("_place")


def fraction(df: DataFrame, share: float, key: str | Column, flag: str = "sampled",
             seed: int = H.SEED) -> DataFrame:
    """Flag for a hashed share of the rows; the rows without it are the complement."""
    k = (F.col(key) if isinstance(key, str) else key).cast("string")
    return df.withColumn(flag, H.unit(k, seed) < share)


def prefix(df: DataFrame, n: int, order: str = "row_id", by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in row order (per file or other group)."""
    return smallest(df, order, n, by)


def quota_sample(df: DataFrame, group: str, total: int, key: str, seed: int = H.SEED) -> DataFrame:
    """``total`` rows over the groups in proportion to their size. Shares are rounded half to
    even and the largest group absorbs the difference."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    # one row per group name: a controlled vocabulary, so the closing window is small
    everything, largest = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy(F.desc("_n"), group)
    share = F.bround(F.col("_n") / F.sum("_n").over(everything) * total).cast("int")
    quotas = sizes.withColumn("_q", share).withColumn("_first", F.row_number().over(largest) == 1)
    gap = F.lit(total) - F.sum("_q").over(everything)
    quotas = quotas.withColumn("_quota", F.col("_q") + F.when(F.col("_first"), gap).otherwise(0))
    drawn = first_per_key(df.withColumn("_place", place(key, seed)), [group], "_place", total)
    rank = F.row_number().over(W.partitionBy(group).orderBy("_place"))
    return (drawn.withColumn("_rn", rank).join(quotas.select(group, "_quota"), group)
            .where(F.col("_rn") <= F.col("_quota")).drop("_rn", "_place", "_quota"))


def first_distinct(df: DataFrame, value: str, group: str, n: int | None = 120, order: str = "row_id") -> DataFrame:
    """The first ``n`` different non-empty values per group in row order, or all of them. A value's digest is shuffled as
    its key."""
    distinct = (df.where(F.col(value) != "").groupBy(group, F.sha2(value, 256).alias("_key"))
                .agg(F.first(value).alias(value), F.min(order).alias(order)).drop("_key"))
    return distinct if n is None else first_per_key(distinct, [group], order, n)


def collapse_small(df: DataFrame, group: str, least: int, bucket: str = "(small)") -> DataFrame:
    """Fold groups of fewer than ``least`` rows into one bucket."""
    small = df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") < least).select(
        group, F.lit(True).alias("_small"))
    return df.join(small, group, "left").withColumn(
        group, F.when(F.col("_small"), bucket).otherwise(F.col(group))).drop("_small")
