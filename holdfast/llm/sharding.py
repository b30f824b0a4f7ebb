"""Sharding by jump consistent hashing, and gapless slots within the shards.

The shard of a row depends on its key and the number of shards alone: no table of shards is kept, and one more
shard takes rows only into itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.registry import documents, query
from holdfast.llm.scratch import free_name, stored

#: Shards of the registered query.
SHARDS = 8

#: Jumps that are made before a key is asked whether it is done.
CHUNK = 4

#: Standard deviations of the number of jumps up to which chunks are made.
SPREAD = 3

#: The multiplier and modulus of the draws: a full-period generator whose products fit in 64 bits.
MULTIPLIER, MODULUS = 48271, 2147483647


def key_seed(key: Column) -> Column:
    """A first draw in 1 .. MODULUS - 1 from the key's text; null is one key of its own."""
    digest = F.md5(F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(MODULUS - 1) + F.lit(1)


def jump_hashes(key: Column, *counts: int) -> Column:
    """A struct with the shard 0 .. n - 1 of a key as ``s0``, ``s1`` and so on, for each number n of shards in ``counts``.

    From bucket b a key jumps to floor((b + 1) / u) for a uniform draw u, until that is past the last shard: it is
    then in b. The draws of a key do not depend on the number of shards, so one walk tells them all, and a key that
    moves when a shard is appended moves into that shard. A walk takes about ln(n) jumps. They are made in chunks, and a
    key that is done takes no further chunk; the few keys that are not done after all of them go on step by step, and as each
    jump goes up by at least one, n steps suffice for any key.
    """
    if min(counts) < 1:
        raise ValueError("at least one shard is needed")
    limit = max(counts)
    lasts = {f"s{i}": n for i, n in enumerate(counts)}

    def step(state: Column, _: Column) -> Column:
        on = state["j"] < limit
        draw = (state["s"] * F.lit(MULTIPLIER)) % F.lit(MODULUS)
        return F.struct(
            *(F.when(state["j"] < n, state["j"]).otherwise(state[name]).alias(name) for name, n in lasts.items()),
            F.when(on, F.call_function("div", (state["j"] + 1) * F.lit(MODULUS), draw)).otherwise(state["j"]).alias("j"),
            draw.alias("s"),
        )

    def walk(state: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)

    def onward(state: Column, chunks: int) -> Column:
        more = walk(state, limit) if not chunks else _let(walk(state, CHUNK), lambda s: onward(s, chunks - 1))
        return F.when(state["j"] >= limit, state).otherwise(more)

    usual = math.log(limit) + SPREAD * math.sqrt(math.log(limit)) + 1
    chunks = max(0, math.ceil(usual / CHUNK) - 1)
    start = F.struct(*(F.lit(-1).cast("long").alias(name) for name in lasts), F.lit(0).cast("long").alias("j"), key_seed(key).alias("s"))
    done = _let(walk(start, min(CHUNK, limit)), lambda s: onward(s, chunks))
    return _let(done, lambda s: F.struct(*(s[name].cast("int").alias(name) for name in lasts)))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard 0 .. shards - 1 of a key."""
    return jump_hashes(key, shards)["s0"]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shard(df: DataFrame, key: str, shards: int, columns: dict[str, Column] | None = None) -> DataFrame:
    """Per row the key, ``columns``, ``shard``, ``grown_shard`` with one more shard, and a gapless ``slot`` in its shard.

    Rows are numbered in the order in which they are read: within a block of input by the shard's rows before them
    in the block, offset by the shard's rows in earlier blocks. Blocks are as large as a task's input whatever the
    keys, so a key, or null, that a third of the rows share is numbered by many tasks. The rows are written once
    to the shared folder, which fixes their blocks. ``columns`` named shard, grown_shard, slot or jumps are refused.
    """
    taken = {"shard", "grown_shard", "slot", "jumps"}.intersection(name.lower() for name in [key, *(columns or {})])
    if taken:
        raise ValueError(f"columns named like results: {sorted(taken)}")
    columns = {key: F.col(key)} if columns is None else {key: F.col(key)} | columns
    kept = df.select(*(c.alias(name) for name, c in columns.items()), jump_hashes(F.col(key), shards, shards + 1).alias("jumps"))
    row, block, n, before = (free_name(kept, name) for name in ("row", "block", "n", "before"))
    numbered = kept.select(*columns, F.col("jumps.s0").alias("shard"), F.col("jumps.s1").alias("grown_shard"), F.monotonically_increasing_id().alias(row))
    rows = stored(numbered.withColumn(block, F.shiftright(row, 33)), "shards")
    blocks = rows.groupBy("shard", block).agg(F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("shard", block, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    within = Window.partitionBy("shard", block).orderBy(row)
    return (
        rows.withColumn("slot", F.row_number().over(within) - 1)
        .join(offsets, ["shard", block])
        .select(*columns, "shard", "grown_shard", (F.col(before) + F.col("slot")).alias("slot"))
    )


@query("op3_sharding")
def op3(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    sharded = shard(
        documents(spark, sf_dir),
        "doc_id",
        SHARDS,
        {"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text.cast("binary"))},
    )
    return sharded.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
