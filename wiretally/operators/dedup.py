"""Keep-first deduplication and key lookups that depend on row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wiretally.functions import text as X
from wiretally.schema import SIGNATURE_FIELDS


def first_per_key(df: DataFrame, key: Sequence[str | Column], order: str = "row_id",
                  n: int = 1) -> DataFrame:
    """The first ``n`` rows per key in ``order``. Written as a rank filter, which Spark also
    applies before the shuffle, so a key shared by a third of all rows sends ``n`` rows per task."""
    names = [f"_k{i}" for i in range(len(key))]
    keyed = df.withColumns({
        k: (F.col(c) if isinstance(c, str) else c) for k, c in zip(names, key)})
    rank = F.row_number().over(W.partitionBy(*names).orderBy(order))
    return keyed.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn", *names)


def keep_first(df: DataFrame, columns: Sequence[str] = SIGNATURE_FIELDS,
               order: str = "row_id") -> DataFrame:
    """One row per request signature, the first in ``order``. The shuffle key is a digest."""
    return first_per_key(df, [X.signature_key(columns)], order)


def last_value_by_signature(df: DataFrame, value: str, columns: Sequence[str] = SIGNATURE_FIELDS,
                            order: str = "row_id") -> DataFrame:
    """``signature_key -> value`` of the last row with that signature."""
    return df.groupBy(X.signature_key(columns).alias("signature_key")).agg(
        F.max_by(value, order).alias(value))


def first_occurrence(df: DataFrame, wanted: DataFrame, keys: Sequence[str],
                     order: str = "row_id", position: str = "row_index") -> DataFrame:
    """For each wanted key its first row in ``df``, in the order of ``wanted``. ``found`` is
    false where a key has no row; callers require that there are none."""
    # The keys may be whole texts, so their digest is shuffled; a null key matches nothing.
    known = F.when(~F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)),
                   F.sha2(F.to_json(F.struct(*keys)), 256)).alias("_key")
    relevant = df.select(known, order).join(wanted.select(known).distinct(), "_key", "left_semi")
    first = relevant.groupBy("_key").agg(F.min(order).alias(order))
    return (wanted.withColumn("_key", known).join(first, "_key", "left").drop("_key")
            .withColumn("found", F.col(order).isNotNull()).orderBy(position))
