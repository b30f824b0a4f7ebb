"""Reproducible splits by a hash of the key: the same key always lands on the same side."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from holdfast.functions import key_hash, percent_bucket

TEST_PERCENT = 20
SEED = 42
# Hash prefixes of this many hex digits make at most 65,536 groups, and the next ones cut each of these as finely.
PREFIX = 4


def hash_split(
    df: DataFrame,
    keys: str | Sequence[str],
    parts: Mapping[str, int] | None = None,
    seed: int = SEED,
    name: str = "split",
) -> DataFrame:
    """Label each row with its part. ``parts`` maps part names to percents, the first part taking the lowest buckets."""
    shares = dict(parts or {"test": TEST_PERCENT, "train": 100 - TEST_PERCENT})
    if sum(shares.values()) != 100:
        raise ValueError("the percents must add up to 100")
    bucket = percent_bucket(keys, seed)
    upper, label = 0, None
    for part, percent in shares.items():
        upper += percent
        label = F.when(bucket < upper, part) if label is None else label.when(bucket < upper, part)
    return df.withColumn(name, label)


def exact_split(
    df: DataFrame,
    keys: str | Sequence[str],
    test_fraction: float = 0.2,
    seed: int = SEED,
    name: str = "split",
) -> DataFrame:
    """A test side of exactly ``ceil(test_fraction * rows)`` rows when the key is unique.

    The keys with the smallest hashes form the test side. A key held by several rows stays on one side, so the test
    side then ends with the key that reaches the wanted size. The rows themselves are only compared with one hash.
    """
    row_hash = key_hash(keys, seed)
    last = _last_test_hash(df.select(row_hash.alias("hash")), test_fraction)
    is_test = F.lit(False) if last is None else row_hash <= F.lit(last)
    return df.withColumn(name, F.when(is_test, "test").otherwise("train"))


def _last_test_hash(hashes: DataFrame, fraction: float) -> str | None:
    """The hash that closes the test side, from two passes over the hashes.

    The first one counts rows per hash prefix. The second one counts rows per whole hash under the prefix in which the
    wanted row lies. Hashes are even, so that is a 65,536th of the keys, however many rows a key has; they are cut
    by their next digits, and only the hashes under one cut are put in order.
    """
    heads = _groups(hashes, PREFIX).collect()
    wanted = math.ceil(round(fraction * sum(row["rows"] for row in heads), 9))
    if wanted == 0:
        return None
    start, wanted = _reaching(heads, wanted)
    whole = _groups(hashes.where(F.col("hash").startswith(start)), 32).persist(StorageLevel.DISK_ONLY)
    cuts = whole.groupBy(F.substring("head", 1, 2 * PREFIX).alias("head")).agg(F.sum("rows").alias("rows"))
    cut, wanted = _reaching(cuts.collect(), wanted)
    last, _ = _reaching(whole.where(F.col("head").startswith(cut)).collect(), wanted)
    whole.unpersist()
    return last


def _groups(hashes: DataFrame, length: int) -> DataFrame:
    head: Column = F.substring("hash", 1, length)
    return hashes.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("rows"))


def _reaching(groups: Sequence[Row], wanted: int) -> tuple[str, int]:
    """The first group, by prefix, at which the running total reaches ``wanted``, and what is still wanted in it."""
    for group in sorted(groups, key=lambda row: row["head"]):
        if wanted <= group["rows"]:
            return group["head"], wanted
        wanted -= group["rows"]
    raise ValueError("there are fewer rows than wanted")
