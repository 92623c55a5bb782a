"""Where results go: Parquet, CSV for review, JSON metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wiretally.schema import UNIFIED_SCHEMA, conform

METRICS = "path string, value double, str string"


def write_unified(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Fixed schema, zstd. Use ``mode="append"`` to add chunks."""
    conform(df, UNIFIED_SCHEMA).write.mode(mode).option("compression", "zstd").parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder per split. Rows are spread first, so a large split is written by many tasks."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(split).parquet(path)


def write_review(top: DataFrame, path: str, score: str, marked: str = "marked") -> None:
    """The reviewed alerts as one CSV file, best first (a report of at most the review size)."""
    (top.orderBy(F.col(score).desc()).select("http_method", "url_path_raw", "url_query", score, marked)
     .coalesce(1).write.mode("overwrite").option("header", True).csv(path))


def write_sites(per_site: DataFrame, path: str) -> None:
    per_site.orderBy(F.desc("alerts"), "site").write.mode("overwrite").option("header", True).csv(path)


def flatten(nested, prefix: tuple[str, ...] = ()):
    """(path, value, str) of every leaf of a nested result."""
    if isinstance(nested, dict):
        for key, value in nested.items():
            yield from flatten(value, prefix + (str(key),))
    elif isinstance(nested, (list, tuple)):
        for i, value in enumerate(nested):
            yield from flatten(value, prefix + (str(i),))
    elif isinstance(nested, (int, float)) and nested is not None:
        yield "/".join(prefix), float(nested), None
    else:
        yield "/".join(prefix), None, None if nested is None else str(nested)


def metrics_frame(spark: SparkSession, nested: dict) -> DataFrame:
    """A job's numbers as a long table."""
    return spark.createDataFrame(list(flatten(nested)), METRICS)


def write_metrics(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """Ingest statistics: a single row."""
    stats.coalesce(1).write.mode("overwrite").json(path)
