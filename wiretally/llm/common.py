"""What several operators share: words, written intermediate tables, Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.session import released, scratch_path

U64 = np.uint64
_A, _B, _C = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)  # fixed values: splitmix64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is executed meanwhile leaves no shuffle files behind. Otherwise they stay until the driver happens to collect its
    garbage, so those of a job of many steps add up."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a compressed Parquet table in the shared folder. Later plans start from it; a lost
    executor costs nothing that is written."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def dropped(df: DataFrame) -> None:
    """Delete a table that ``written`` gave, once nothing reads it any more."""
    released(df.sparkSession, df.written_to)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, vectorised."""
    with np.errstate(over="ignore"):
        x = x + _A
        x = (x ^ (x >> U64(30))) * _B
        x = (x ^ (x >> U64(27))) * _C
        return x ^ (x >> U64(31))


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def tokens(text: bytes) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+``: bytes.split() cuts at these six characters and no others."""
    return text.split()


class WordHashes(dict):
    """64-bit hash of a word, remembered for the words seen last; forgets all once it holds ``limit``."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), U64, len(words))


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word windows; a shorter text counts as one window."""
    if not words:
        return np.empty(0, U64)
    return np.unique(window_hashes(word_hashes(words), min(size, len(words))))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash for each window of ``size`` consecutive values, in order."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        out = np.full(n, U64(size))
        for k in range(size):
            out = mixed(out ^ hashes[k:k + n])
    return out


def batches(rows: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``most`` rows."""
    for b in rows:
        for at in range(0, b.num_rows, most):
            yield b.slice(at, most)


def documents_only(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns by position of their first exact match, so that extra columns never clash."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])
