import zlib
from collections import Counter

import pytest
from llm_cases import ODD

from holdfast.llm import sharding


def reference(seed, shards):
    bucket, jump = -1, 0
    while jump < shards:
        bucket = jump
        seed = seed * sharding.MULTIPLIER % sharding.MODULUS
        jump = (bucket + 1) * sharding.MODULUS // seed
    return bucket


def test_hash_is_the_jump_recurrence(spark):
    from pyspark.sql import functions as F

    columns = [sharding.jump_hash(F.col("id"), n).alias(f"s{n}") for n in (1, 2, 8, 9, 100)]
    for row in spark.range(400).select(sharding.key_seed(F.col("id")).alias("seed"), *columns).collect():
        for n in (1, 2, 8, 9, 100):
            assert row[f"s{n}"] == reference(row.seed, n)


@pytest.mark.parametrize("chunk", [1, 4])
def test_many_shards_and_long_walks(spark, monkeypatch, chunk):
    from pyspark.sql import functions as F

    monkeypatch.setattr(sharding, "CHUNK", chunk)
    # No chunk but the first: all others go through the exact tail.
    if chunk == 1:
        monkeypatch.setattr(sharding, "SPREAD", -9)
    for n in (60, 10_000) if chunk > 1 else (60,):
        both = sharding.jump_hashes(F.col("id"), n, n + 1).alias("b")
        for row in spark.range(300).select(sharding.key_seed(F.col("id")).alias("seed"), both).select("seed", "b.*").collect():
            assert (row.s0, row.s1) == (reference(row.seed, n), reference(row.seed, n + 1))


def test_names_of_its_own_and_refused_ones(spark):
    from pyspark.sql import functions as F

    odd = spark.range(20).select(F.col("id").alias("row"), F.lit("x").alias("block"), F.lit(1).alias("n"))
    rows = sharding.shard(odd, "row", 2, {"block": F.col("block"), "n": F.col("n")}).collect()
    assert {(r.block, r.n) for r in rows} == {("x", 1)} and len({(r.shard, r.slot) for r in rows}) == 20
    with pytest.raises(ValueError, match="slot"):
        sharding.shard(odd.withColumnRenamed("n", "slot"), "slot", 2)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = sharding.shard(spark.range(4000).withColumnRenamed("id", "k").repartition(5), "k", 8).collect()
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    moved = sum(r.grown_shard == 8 for r in rows)
    assert 0.08 < moved / 4000 < 0.15
    assert max(Counter(r.shard for r in rows).values()) < 1.25 * 500
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_equal_keys_share_a_shard_and_not_a_slot(frame):
    rows = sharding.shard(frame(ODD), "doc_id", 3).collect()
    assert len({(r.shard, r.slot) for r in rows}) == len(ODD)
    by_key = {}
    for r in rows:
        by_key.setdefault(r.doc_id, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_key.values())


def test_query(spark, tmp_path):
    spark.createDataFrame(ODD, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sharding.op3(spark, str(tmp_path)).collect()
    want = sorted(((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in ODD), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=str) == want
    assert {r.law for r in rows} == {"key"}


def test_no_rows_and_no_shards(spark):
    assert sharding.shard(spark.createDataFrame([], "k bigint"), "k", 4).collect() == []
    with pytest.raises(ValueError):
        sharding.shard(spark.range(1).withColumnRenamed("id", "k"), "k", 0)
