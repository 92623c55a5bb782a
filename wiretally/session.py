"""Session defaults and the shared working folder for data that must outlive an executor."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("wiretally")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only where that is unset in a local session. A cluster without
    it is refused: its executors don't share the driver's disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir")
    if folder is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    if folder is None:
        folder = getattr(shared_folder, "_fallback", None)
        if folder is None:
            folder = shared_folder._fallback = tempfile.mkdtemp(prefix="wiretally-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def released(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def tabled(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder. Unlike a checkpoint it has a measured size, so Spark broadcasts it in a
    join if it is small and not otherwise."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_out(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly, over all cores at least, for what feeds model fits and scoring: it is costly per row, but may be
    small in bytes, so it would end up in few partitions."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def settle(df: DataFrame, spread: bool = False) -> DataFrame:
    """Reliable checkpoint: the rows are written once and later plans start from the files. ``spread`` deals them out evenly first."""
    shared_folder(df.sparkSession)
    return (spread_out(df) if spread else df).checkpoint(eager=True)
