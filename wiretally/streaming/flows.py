"""Streaming forms of labelling, window counts and deduplication."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wiretally.functions import text as X
from wiretally.operators import labelling
from wiretally.schema import CAPTURE_SCHEMA, SIGNATURE_FIELDS
from wiretally.session import scratch_path, spread_out


def capture_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Capture lines as they are appended to a folder."""
    return spark.readStream.schema(CAPTURE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def label_batches(stream: DataFrame, campaigns: Callable[[], DataFrame], out: str, checkpoint: str,
                  score: Callable[[DataFrame], DataFrame] | None = None, columns: Sequence[str] = ()) -> StreamingQuery:
    """Label (and score) what has arrived and stop. ``campaigns`` is called for each micro-batch, so campaigns that were added meanwhile count
    from the next one on; ``score`` is a stored model's scoring function, loaded once. A batch is written to a folder named by its number,
    in place of what an earlier try left there: after a crash or a restart from ``checkpoint`` no row is missing or twice.
    Read the result with :func:`committed`."""
    def save(batch: DataFrame, number: int) -> None:
        labelled = labelling.label_flows(batch, campaigns())
        rows = labelled if score is None else score(spread_out(labelled))  # scoring costs far more per row than the shuffle
        (rows.select(*columns) if columns else rows).write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()


def committed(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all batches under a folder of :func:`label_batches`."""
    return spark.read.parquet(path).drop("batch")


def session_window_counts(stream: DataFrame, keys: Sequence[str] = ("session_id",), ts: str = "ts",
                          delay: str = "10 minutes", seconds: int = 10) -> DataFrame:
    """Rows per session and tumbling window. State is dropped once the watermark passes a window."""
    return (stream.withWatermark(ts, delay).groupBy(F.window(ts, f"{seconds} seconds").alias("w"), *keys)
            .agg(F.count("*").alias("n")).select(*keys, F.unix_seconds("w.start").alias("window_start"), "n"))


def unique_requests(stream: DataFrame, columns: Sequence[str] = SIGNATURE_FIELDS, ts: str = "ts",
                    horizon: str = "1 hour") -> DataFrame:
    """Requests not seen within the horizon. Unlike batch deduplication, a repeat after it passes."""
    return (stream.withColumn("signature_key", X.signature_key(columns)).withWatermark(ts, horizon)
            .dropDuplicatesWithinWatermark(["signature_key"]))


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what has arrived and stop. In ``update`` mode each batch is a folder of its own and
    :func:`latest` reads the newest row per key."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        return writer.outputMode("append").format("parquet").start(path)

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:08d}")

    return writer.outputMode("update").foreachBatch(save).start()


def run_to_end(df: DataFrame, name: str, mode: str = "append") -> str:
    """Run a query over everything available; the folder with its output."""
    spark = df.sparkSession
    out = scratch_path(spark, name)
    to_table(df, out, scratch_path(spark, f"{name}-state"), mode).awaitTermination()
    return out


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest row per key of an update-mode output."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "_batch", "batch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "_batch").alias(c) for c in values])
