"""Text lines with their place in the file, and one-pass capture of several groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from wiretally.functions.text import split_target

_CUT, _ESCAPE = "\x01", "\x02"


def number_rows(df: DataFrame) -> DataFrame:
    """Add ``file``, ``line_no`` (from 1, within the file) and ``row_id`` (from 0, over all files in
    name order) to a frame fresh from a file source. Rows are counted per file block; a row's
    number is its place in the block plus what lies before the block, so nothing is sorted."""
    placed = df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_at"))
    # one row per file block: a few hundred thousand even for 100 TB
    blocks = placed.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    in_file = W.partitionBy("file").orderBy("_block")
    overall = W.partitionBy(F.lit(0)).orderBy("file", "_block")
    blocks = blocks.select("file", "_block", "_first", (F.sum("_n").over(in_file) - F.col("_n")).alias("_before"),
                           (F.sum("_n").over(overall) - F.col("_n")).alias("_ahead"))
    place = F.col("_at") - F.col("_first")
    return placed.join(blocks, ["file", "_block"]).withColumns(
        {"line_no": place + F.col("_before") + 1, "row_id": place + F.col("_ahead")}).drop(
        "_block", "_at", "_first", "_before", "_ahead")


def read_lines(spark: SparkSession, path: str | Sequence[str], latin1: bool = False, numbered: bool = True) -> DataFrame:
    lines = spark.read.text(path)
    if numbered:
        lines = number_rows(lines)
    return lines.withColumn("value", from_latin1("value")) if latin1 else lines


def from_latin1(c: str) -> Column:
    """Bytes read as UTF-8 text taken for what they are: ISO 8859-1."""
    return F.decode(F.col(c).cast("binary"), "ISO-8859-1")


def captured(df: DataFrame, pattern: str, names: Sequence[str], value: str = "value") -> DataFrame:
    """Groups of a whole-line pattern as columns; ``parsed`` tells whether it matched. The line is
    matched once and cut, not once per group. A line may hold the byte it is cut at: that byte is
    written as an escape before the match and restored in the groups."""
    joined = _CUT.join(f"${i + 1}" for i in range(len(names)))
    parts = F.split(F.regexp_replace(_escaped(F.col(value)), pattern, joined), _CUT, -1)
    staged = df.withColumn("_g", parts).withColumn("parsed", F.size("_g") == len(names))
    return staged.withColumns({n: F.when(F.col("parsed"), _restored(F.get("_g", F.lit(i)))) for i, n in enumerate(names)}).drop("_g")


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(_ESCAPE), F.lit(_ESCAPE + "b")), F.lit(_CUT), F.lit(_ESCAPE + "a"))


def _restored(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(_ESCAPE + "a"), F.lit(_CUT)), F.lit(_ESCAPE + "b"), F.lit(_ESCAPE))


def with_target(df: DataFrame, target: Column) -> DataFrame:
    path, query = split_target(F.col("_target"))
    return df.withColumn("_target", target).withColumns({"url_path_raw": path, "url_query": query}).drop("_target")


def ingest_stats(lines: DataFrame) -> DataFrame:
    """Source lines, parsed rows, parse errors and their rate."""
    total, parsed = F.count("*"), F.count_if("parsed")
    return lines.agg(total.alias("source_lines"), parsed.alias("parsed_rows"), (total - parsed).alias("parse_errors"),
                     F.coalesce(F.round(F.try_divide(total - parsed, total), 6), F.lit(0.0)).alias("parse_error_rate"))
