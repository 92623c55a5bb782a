"""Seeded hashing: the only source of randomness in splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SEED = 42


def _digest(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)


def bucket(key: Column, buckets: int, seed: int = SEED) -> Column:
    """SHA-256 of ``seed:key`` read as one 256-bit integer, modulo ``buckets``. The digest is
    folded in eight 32-bit words, each times its place value modulo ``buckets``."""
    digest = _digest(key, seed)
    total = F.lit(0).cast("bigint")
    for word in range(8):
        place = pow(2, 32 * (7 - word), buckets)
        value = F.conv(F.substring(digest, 8 * word + 1, 8), 16, 10).cast("bigint")
        total = total + value * F.lit(place).cast("bigint")
    return total % F.lit(buckets)


def unit(key: Column, seed: int = SEED) -> Column:
    """Bucket of ten thousand as a share in [0, 1)."""
    return bucket(key, 10_000, seed) / F.lit(10_000.0)


def shuffle_rank_key(key: Column, seed: int = SEED) -> Column:
    """52-bit hash that stands for a row's place in a seeded shuffle (exact as a double)."""
    return F.conv(F.substring(_digest(key, seed), 1, 13), 16, 10).cast("bigint")
