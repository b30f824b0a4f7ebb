"""Hashes of a key that do not depend on partitioning, so a split survives retries and re-runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(keys: str | Sequence[str], seed: int = 42) -> Column:
    """32 hex digits of the seeded key; evenly spread over all keys.

    Each part carries its length, and NULL is a part of its own, so different compound keys have different texts.
    """
    names = [keys] if isinstance(keys, str) else list(keys)
    parts = []
    for name in names:
        text = F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.lit("|"), F.length(text).cast("string"), F.lit(":"), text), F.lit("|-")))
    return F.md5(F.concat(F.lit(str(seed)), *parts))


def percent_bucket(keys: str | Sequence[str], seed: int = 42) -> Column:
    """A number from 0 to 99 per key."""
    head = F.conv(F.substring(key_hash(keys, seed), 1, 8), 16, 10).cast("bigint")
    return (head % 100).cast("int")
