"""Seeded randomness as a function of the row's key.

Every random choice (fold, split, proposal, row order) is an MD5 of the key and the seed, so it does
not depend on partitioning or task retries and any SQL engine can recompute it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 52


def hash52(*keys, seed: int = 0) -> Column:
    """Non-negative 52-bit integer from integer, string or date keys."""
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def uniform(*keys, seed: int = 0) -> Column:
    """Number in [0, 1), exact in a double."""
    return hash52(*keys, seed=seed) / F.lit(float(2**HASH_BITS))
