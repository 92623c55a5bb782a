"""Small building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def attach(df: DataFrame, summary: DataFrame, by: Sequence[str]) -> DataFrame:
    """Put the columns of a per-group summary on every row: an equi join per group, a scalar
    subquery when there are no groups (so one row never turns into a product join)."""
    if by:
        return df.join(summary, list(by), "inner")
    one = summary.select(F.struct(*summary.columns).alias("s")).scalar()
    staged = df.withColumn("_one", one)
    return staged.select(*df.columns, *[F.col("_one")[c].alias(c) for c in summary.columns])


def same(c: str, other: str) -> Column:
    return F.col(c).eqNullSafe(F.col(other))
