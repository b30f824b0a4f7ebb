"""How filters interact: what each would remove at every step of every order in which they could run.

Whether a document falls at a step depends on one thing only, the mask of the filters that it fails. So each mask is
mapped to one wide integer that holds the outcomes of all steps of all orders in fields of 64 bits, the integers of
a part's documents are summed, and the sum is unpacked. No field can run over into the next: each grows by one
at most per document.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.quality import words_of
from holdfast.llm.registry import query
from holdfast.llm.scratch import Scratch, stored

#: What a wide integer counts of every step, one field of eight bytes each.
FIELDS = ("kept", "removed", "redundant", "unique_fails")
FIELD = np.dtype("<u8")

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def orders_of(filters: int) -> list[tuple[int, ...]]:
    """All orders of filters 0 .. filters - 1, the given order first."""
    return list(itertools.permutations(range(filters)))


def wide_integer(mask: int, filters: int) -> int:
    """The outcomes of a document that fails the filters of ``mask`` (bit i: filter i), field by field.

    Fields stand in the order of orders, steps and ``FIELDS``, the first one in the lowest bits.
    """
    fields = np.zeros((len(orders_of(filters)), filters, len(FIELDS)), FIELD)
    for order, steps in zip(orders_of(filters), fields, strict=True):
        gone = False
        for number, step in zip(order, steps, strict=True):
            fails = bool(mask >> number & 1)
            step[:] = (not (gone or fails), fails and not gone, fails and gone, mask == 1 << number)
            gone = gone or fails
    return int.from_bytes(fields.tobytes(), "little")


def unpack(total: int, filters: int) -> np.ndarray:
    """The fields of a sum of wide integers, as (orders, steps, FIELDS)."""
    shape = (len(orders_of(filters)), filters, len(FIELDS))
    data = total.to_bytes(int(np.prod(shape)) * FIELD.itemsize, "little")
    return np.frombuffer(data, FIELD).reshape(shape).astype(np.int64)


def mask_counts(df: DataFrame, key: str, part: Column, text: str, failures: Sequence[Column], labels: DataFrame, repeats: bool = True) -> DataFrame:
    """Documents per ``part``, ``mask``, ``good`` and ``toxic``: a few hundred rows per part at most.

    Bit i of the mask says that condition i of ``failures`` holds (null: it does not); with ``repeats`` one more bit
    says that a row with a smaller key holds the same text, in whatever part. Null texts count as empty. A null
    key is smaller than none and greater than none; rows of equal key and text are no copies of one another.
    ``labels`` has one row per key at most, with booleans ``good`` and ``toxic``; a key without one is neither.

    Texts are compared by SHA-256. Rows that agree in key, part and text are counted before the first shuffle, and the
    first key of a text is an aggregate that meets its rows again by text and key, so neither a key nor a text that
    a third of all rows share comes together in one task.
    """
    scratch = Scratch(df.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(failures)), F.lit(0))
    rows = df.select(F.col(key).alias("key"), part.alias("part"), F.unhex(F.sha2(whole, 256)).alias("digest"), mask.alias("mask"))
    rows = scratch.store(rows.groupBy("key", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")), "masks")
    if repeats:
        first = rows.where("key IS NOT NULL").groupBy("digest").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
        copy = F.col("key").isNotNull() & F.col("first").isNull()
        rows = rows.join(first, ["digest", "key"], "left").withColumn("mask", F.col("mask") + F.when(copy, 1 << len(failures)).otherwise(0))
    rows = rows.groupBy("key", "part", "mask").agg(F.sum("n").alias("n"))
    flags = [F.coalesce(F.col(f), F.lit(False)).alias(f) for f in ("good", "toxic")]
    counts = rows.join(labels, "key", "left").groupBy("part", "mask", *flags).agg(F.sum("n").alias("n"))
    counts = stored(counts, "mask-counts")
    scratch.clear()
    return counts


def interactions(counts: DataFrame, names: str) -> DataFrame:
    """Per part, order and step what the step's filter does, zeros included, from the counts of ``mask_counts``.

    ``names`` has one letter per filter. Equal integers are counted already, so a part's sum has one product per
    mask and label, and a task holds the sums of one part at a time. ``part`` must not be null. ``shapley`` is what a
    step's filter removes over all orders, at any step. A table without rows has no parts and gives no rows.
    """
    filters = len(names)
    orders = orders_of(filters)
    spelled = ["".join(names[i] for i in order) for order in orders for _ in order]
    numbers = np.array(orders)
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide: dict[int, int] = {}
        part, totals = None, [0, 0, 0]
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.part != part:
                    if part is not None:
                        yield unpacked(part, totals)
                    part, totals = row.part, [0, 0, 0]
                if row.mask not in wide:
                    wide[row.mask] = wide_integer(int(row.mask), filters)
                for k, counted in enumerate((True, row.good, row.toxic)):
                    if counted:
                        totals[k] += int(row.n) * wide[row.mask]
        if part is not None:
            yield unpacked(part, totals)

    def unpacked(part: str, totals: Sequence[int]) -> pd.DataFrame:
        every, good, toxic = (unpack(total, filters) for total in totals)
        removed = FIELDS.index("removed")
        shapley = np.zeros(filters, np.int64)
        np.add.at(shapley, numbers.ravel(), every[:, :, removed].ravel())
        columns = {name: every[:, :, k].ravel() for k, name in enumerate(FIELDS)}
        lost = {"good_lost": good[:, :, removed].ravel(), "toxic_lost": toxic[:, :, removed].ravel()}
        steps = np.tile(np.arange(1, filters + 1, dtype=np.int32), len(orders))
        return pd.DataFrame({"part": part, "filter_order": spelled, "step": steps, **columns, **lost, "shapley": shapley[numbers.ravel()]})

    return counts.repartition("part").sortWithinPartitions("part").mapInPandas(sums, schema)


def text_failures(text: Column) -> list[Column]:
    """The failure conditions A to D of the registered query; B splits a text only where A has not."""
    text = F.coalesce(text, F.lit(""))
    words = words_of(text)
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return [n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike(r"[#$%&*|]")]


_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
      'A': len(ws) < 50,
      'B': 100 * len(list_distinct(ws)) < 65 * len(ws),
      'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
      'D': regexp_matches(text, '[#$%&*|]'),
      'E': coalesce(first < doc_id, false)} AS f
  FROM d LEFT JOIN l USING (doc_id)
), counted AS (
  SELECT part, good, toxic, concat(CASE WHEN f['A'] THEN 'A' ELSE '' END, CASE WHEN f['B'] THEN 'B' ELSE '' END,
      CASE WHEN f['C'] THEN 'C' ELSE '' END, CASE WHEN f['D'] THEN 'D' ELSE '' END, CASE WHEN f['E'] THEN 'E' ELSE '' END) AS fails,
    count(*) AS n
  FROM m GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS letter, left(filter_order, step - 1) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), outcomes AS (
  SELECT c.*, s.*, contains(fails, letter) AS failed,
    length(translate(fails, before, '')) < length(fails) AS gone
  FROM counted c, steps s
), summed AS (
  SELECT part, filter_order, step::INTEGER AS step, letter,
    coalesce(sum(n) FILTER (NOT gone AND NOT failed), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (failed AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (failed AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = letter), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (failed AND NOT gone AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (failed AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
  FROM outcomes GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM summed
"""


def label_flags(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per key: whether any of its rows says quality 1, and toxic 1; keys that are null are left out."""
    flags = (F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic")))
    return labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(*flags)


@query("op13_filter_audit", _SQL)
def op13(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    labels = label_flags(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    part = F.coalesce(F.col("source"), F.lit(""))
    return interactions(mask_counts(docs, "doc_id", part, "text", text_failures(F.col("text")), labels), "ABCDE")
