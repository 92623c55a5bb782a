"""Key-set questions: seen before, shared, disjoint, covered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wiretally.functions import text as X
from wiretally.operators.dedup import last_value_by_signature
from wiretally.schema import SIGNATURE_FIELDS


def exclude_seen(df: DataFrame, train: DataFrame, columns: Sequence[str] = SIGNATURE_FIELDS) -> DataFrame:
    """Rows whose request signature does not occur in ``train``. Train keys are made distinct
    before the join, so repeated requests there cost nothing."""
    seen = train.select(X.signature_key(columns).alias("_key")).distinct()
    return df.withColumn("_key", X.signature_key(columns)).join(seen, "_key", "left_anti").drop("_key")


def exclude_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is not among ``keys``. What is shuffled is a digest of the key, which may be a whole text."""
    digest = F.sha2(F.col(key).cast("string"), 256).alias("_key")
    return df.withColumn("_key", digest).join(keys.select(digest).distinct(), "_key", "left_anti").drop("_key")


def recover_family(df: DataFrame, labelled: DataFrame, family: str = "attack_family",
                   source: str = "testbed") -> DataFrame:
    """Family of a request from the labelled table by signature; the last duplicate counts and
    rows of other sources get null."""
    families = last_value_by_signature(labelled, family)
    joined = df.drop(family).withColumn("signature_key", X.signature_key()).join(
        families, "signature_key", "left").drop("signature_key")
    return joined.withColumn(family, F.when(F.col("source_id") == source, F.col(family)))


def drop_shared_payloads(df: DataFrame, key: Column, tool: str, first: str, second: str) -> DataFrame:
    """Without the payloads that two tools both sent."""
    keyed = df.withColumn("_key", F.sha2(key.cast("string"), 256))
    shared = (keyed.where(F.col(tool).isin(first, second)).groupBy("_key")
              .agg(F.bool_or(F.col(tool) == first).alias("a"), F.bool_or(F.col(tool) == second).alias("b"))
              .where("a and b").select("_key"))
    return keyed.join(shared, "_key", "left_anti").drop("_key")


def assign(df: DataFrame, assignment: DataFrame, key: str) -> DataFrame:
    """Put an assignment (one row per key) on the rows; unknown keys get null."""
    return df.join(assignment, key, "left")


def mark_members(df: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """Boolean ``flag``: does the key of this row occur in ``members``?"""
    known = members.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(known, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def overlaps(df: DataFrame, key: str, side: str) -> DataFrame:
    """Keys found on more than one side, all pairs of sides in a single pass."""
    return (df.groupBy(key).agg(F.min(side).alias("_lo"), F.max(side).alias("_hi"))
            .where("_lo < _hi").select(key))


def require_disjoint(df: DataFrame, key: str, side: str) -> None:
    shared = overlaps(df, key, side).count()
    if shared:
        raise AssertionError(f"{shared} values of {key} occur in more than one {side}")


def missing_keys(wanted: DataFrame, have: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.select(*keys).distinct().join(have.select(*keys).distinct(), list(keys), "left_anti")


def class_labels(*columns: DataFrame) -> DataFrame:
    """Sorted union of the class names in one-column frames."""
    out = columns[0].toDF("label")
    for other in columns[1:]:
        out = out.union(other.toDF("label"))
    return out.distinct().orderBy("label")


def label_rows(df: DataFrame, labels: DataFrame, index: str = "row_index") -> DataFrame:
    return df.join(labels, index, "inner")


def concat_classes(benign: DataFrame, attack: DataFrame) -> DataFrame:
    """Both classes with ``y`` set, columns matched by name."""
    return benign.withColumn("y", F.lit(0)).unionByName(
        attack.withColumn("y", F.lit(1)), allowMissingColumns=True)
