"""Exact Jaccard join of documents on word n-grams, and the components that its links form.

A document is its set of n-gram hashes in one order for the whole corpus: common n-grams last, else by hash. Of two
documents that link, both prefixes, a size-derived part of the sets, share at least a size-derived number of n-grams.
The document by n-gram incidence is therefore cut to the prefixes and dealt in blocks of n-grams; the sparse product
of a block with itself counts overlaps, the counts of a pair add up over the blocks, and pairs below the bound, or
of too unlike sizes, are discarded. The rest is compared on whole sets.

Groups of near copies would make a square of their size in pairs. A first product therefore pairs each document in a
row of the incidence only with the one that has the fewest n-grams of its own; the links found there form components. The second, full product
leaves out pairs inside a component, and n-grams too late in either set to be the first that a linked pair shares.
Equal sets are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.graph import connected
from holdfast.llm.registry import documents, query
from holdfast.llm.scratch import Scratch, most_frequent, stored
from holdfast.llm.words import SOLID, Texts, find_words, hash_windows, hash_words, release, slices

#: N-grams that are put last in the order, at most; which they are changes the work and never the result.
COMMON = 1 << 16

#: Parts over which rows of a common n-gram are dealt.
PARTS = 16

#: Beyond so many candidates their keys are joined by a shuffle instead of a broadcast.
BROADCAST_KEYS = 500_000


@dataclass(frozen=True)
class Measure:
    """Documents link when 100 * intersection >= percent * union of their sets of ``words``-word n-grams."""

    words: int = 4
    percent: int = 85

    def required(self, size: int) -> int:
        """The least intersection of a set of this size with any set that it links to."""
        return -(-self.percent * size // 100)

    @staticmethod
    def shared(size: int) -> int:
        """How many n-grams the prefixes of linked sets share at least; the smaller set's number holds."""
        return 1 + size // 16

    def prefix(self, size: int) -> int:
        return min(size, size - self.required(size) + self.shared(size))

    def overlap(self, a: int | Column, b: int | Column) -> int | Column:
        """The least intersection of two linked sets of these sizes."""
        whole = self.percent * (a + b) + 99 + self.percent
        return F.call_function("div", whole, F.lit(100 + self.percent)) if isinstance(whole, Column) else whole // (100 + self.percent)

    def rest(self, size: Column) -> Column:
        """The size of a set less its prefix."""
        required = F.call_function("div", self.percent * size + 99, F.lit(100))
        return F.greatest(required - 1 - F.call_function("div", size, F.lit(16)), F.lit(0))

    def links(self, a: np.ndarray, b: np.ndarray) -> bool:
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        both = int((large[at] == small).sum())
        return 100 * both >= self.percent * (len(a) + len(b) - both)

    def sizes_fit(self, a: Column, b: Column) -> Column:
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)


def ngram_sets(texts: Texts, size: int) -> list[np.ndarray]:
    """Per text its distinct n-gram hashes in order; of fewer words the whole sequence; without words none."""
    words = find_words(texts.lower(), SOLID)
    hashes = hash_words(words)
    windows = hash_windows(hashes, size)
    sets = []
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(np.unique(windows[a : b - size + 1]))
        else:
            sets.append(hash_windows(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return sets


def set_key(members: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(members.tobytes())


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def common_ngrams(df: DataFrame, text: str, measure: Measure, most: int = COMMON) -> np.ndarray:
    """The n-grams that the most different sets share, as far as two of them lie near each other in the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, text):
            own = {set_key(s): s for s in ngram_sets(texts, measure.words)}
            values, counts = np.unique(np.concatenate(list(own.values())), return_counts=True)
            often = counts > 1
            yield pa.RecordBatch.from_arrays([_long(values[often]), pa.array(counts[often].astype(np.int64))], names=["ngram", "n"])

    found = df.select(text).mapInArrow(run, "ngram long, n long").groupBy("ngram").agg(F.sum("n").alias("n"))
    scratch = Scratch(df.sparkSession)
    top = most_frequent(scratch.store(found, "common"), "n", most).select("ngram").toArrow()
    scratch.clear()
    return np.sort(top.column("ngram").to_numpy().view(np.uint64))


def prefixes(df: DataFrame, text: str, measure: Measure, common: np.ndarray) -> DataFrame:
    """The frame without its text, with ``n`` (the set's size), ``set_key`` and ``prefix``, null for an empty set, and ``text_key``."""
    rest = [f for f in df.schema.fields if f.name != text]
    own = [T.StructField("n", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("prefix", T.BinaryType())]
    schema = T.StructType([*rest, T.StructField("text_key", T.LongType()), *own])
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(1 << 20, dtype=bool)
        known[(common & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch, texts in slices(batches, text):
            keys, parts, sizes = [], [], []
            for members in ngram_sets(texts, measure.words):
                sizes.append(len(members))
                if not len(members):
                    keys.append(None)
                    parts.append(None)
                    continue
                last = np.zeros(len(members), dtype=bool)
                likely = np.flatnonzero(known[(members & np.uint64((1 << 20) - 1)).astype(np.int64)])
                if len(likely):
                    at = np.minimum(np.searchsorted(common, members[likely]), len(common) - 1)
                    last[likely] = common[at] == members[likely]
                ordered = np.concatenate([members[~last], members[last]])
                keys.append(set_key(members))
                parts.append(ordered[: measure.prefix(len(members))].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in names),
                    batch.column("text_key"),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(parts, pa.binary()),
                ],
                names=schema.names,
            )

    return df.withColumn("text_key", F.xxhash64(text)).mapInArrow(run, schema)


def _incidence(nodes: DataFrame, common: np.ndarray) -> DataFrame:
    """A row per n-gram of a node's prefix, with its place there, and ``part``.

    Rows of common n-grams are dealt over parts 1 .. ``PARTS``, all others are in part 0. So no task holds the bucket of an
    n-gram that a third of the sets share.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            release()
            for first in range(0, whole.num_rows, 2000):
                batch = whole.slice(first, 2000)
                parts = [np.frombuffer(p, dtype=np.uint64) for p in batch.column("prefix").to_pylist()]
                times = np.array([len(p) for p in parts])
                columns = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), times) for c in ("node", "n")]
                place, ngrams, often = np.concatenate([np.arange(t) for t in times]), np.concatenate(parts), shared.value
                at = np.searchsorted(often, ngrams)
                known = often[np.minimum(at, len(often) - 1)] == ngrams if len(often) else np.zeros(len(ngrams), bool)
                part = np.where(known, np.repeat(np.arange(len(times)) % PARTS + 1, times), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([_long(ngrams), *map(pa.array, [*columns, place, part])], names=["ngram", "node", "n", "place", "part"])

    return nodes.select("node", "n", "prefix").mapInArrow(run, "ngram long, node long, n long, place long, part int")


def _per_ngram(rows: DataFrame, scratch: Scratch, **values: Column) -> DataFrame:
    """The rows with ``values``, aggregates over their n-gram's bucket.

    Counted in each task before rows are shuffled; the one row of a common n-gram is repeated for all parts and joined to the rows there.
    """
    found = rows.groupBy("ngram").agg(F.max("part").alias("dealt"), *(v.alias(name) for name, v in values.items()))
    parts = F.when(F.col("dealt") > 0, F.sequence(F.lit(1), F.lit(PARTS))).otherwise(F.array(F.lit(0)))
    found = scratch.store(found.select("ngram", *values, F.explode(parts).alias("part")), "buckets", reclaim=True)
    return rows.join(found, ["ngram", "part"])


def _bounded(pairs: DataFrame, measure: Measure) -> DataFrame:
    """Pairs whose counted overlap reaches what their sizes ask of their prefixes.

    Of two prefixes the one that ends first in the order holds all n-grams of its set up to there, and the other one holds
    those of its own: what they do not share then lies in the first one's rest.
    """
    na, nb = F.col("na"), F.col("nb")
    bound = F.greatest(1 + F.call_function("div", F.least(na, nb), F.lit(16)), measure.overlap(na, nb) - F.greatest(measure.rest(na), measure.rest(nb)))
    return pairs.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= bound)


def _prefix_bounded(pairs: DataFrame, nodes: DataFrame, measure: Measure) -> DataFrame:
    """The pairs whose whole prefixes share enough; as ``_bounded``, from the prefixes themselves."""
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("prefix").alias(f"prefix_{side}")), side)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            sizes = zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), strict=True)
            for x, y, (na, nb) in zip(batch.column("prefix_a"), batch.column("prefix_b"), sizes, strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                hit.append(both >= measure.overlap(na, nb) - max(na - len(one), nb - len(two)))
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return pairs.select("a", "b", "na", "nb", "prefix_a", "prefix_b").mapInArrow(compare, "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, df: DataFrame, text: str, measure: Measure, scratch: Scratch) -> DataFrame:
    """The pairs ``a``, ``b`` that link by their whole sets.

    The sets come from the texts of the nodes in question: these are found by a hash of the text, and told from
    others that share it by the key of the set.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "text_key", "set_key"), "node")
    asked = scratch.store(asked, "asked")
    keys = asked.select("text_key").distinct()
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    texts = df.select(F.col(text).alias("text"), F.xxhash64(text).alias("text_key")).join(keys, "text_key", "left_semi").select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in slices(batches, "text"):
            own = {set_key(s): s.tobytes() for s in ngram_sets(found, measure.words) if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.binary())], names=["set_key", "members"])

    members = asked.select("node", "set_key").join(texts.mapInArrow(sets, "set_key binary, members binary").dropDuplicates(["set_key"]), "set_key")
    members = scratch.store(members.select("node", "members"), "sets")
    both = pairs.select("a", "b")
    for side in ("a", "b"):
        both = both.join(members.select(F.col("node").alias(side), F.col("members").alias(f"set_{side}")), side)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("set_a"), batch.column("set_b"), strict=True)
            hit = [measure.links(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in sides]
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))
        release()

    return scratch.store(both.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long"), "verified")


def components(df: DataFrame, text: str, keep: list[str], measure: Measure = Measure()) -> DataFrame:
    """Per row of the frame the columns ``keep``, ``n_ngrams``, and ``component``, one number per component.

    Null and empty texts, and those without a word, have no n-grams and are alone; repeated texts are one component.
    The frame is read four times and should be a stored table.
    """
    scratch, row = Scratch(df.sparkSession), "__row"
    kept = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    df = df.select(F.col(text).alias("text"), F.monotonically_increasing_id().alias(row), *kept)
    text = "text"
    common = common_ngrams(df, text, measure)
    docs = scratch.store(prefixes(df, text, measure, common), "prefixes")
    least = F.struct(F.col(row).alias("node"), "n", "text_key", "prefix")
    nodes = docs.where("set_key is not null").groupBy("set_key").agg(F.min(least).alias("x")).select("set_key", "x.*")
    nodes = scratch.store(nodes, "nodes")
    # N-grams of one set link nothing; common ones are in more than one. No other bucket is larger than theirs.
    bucket = Window.partitionBy("ngram", "part")
    shared = _incidence(nodes, common).withColumn("members", F.count(F.lit(1)).over(bucket)).where("members > 1 or part > 0").drop("members")
    shared = scratch.store(shared, "incidence")
    # Of near copies the one with the fewest n-grams of its own is the best center.
    own = shared.groupBy("node", "n").agg(F.count(F.lit(1)).alias("known"))
    own = own.select("node", (F.col("n") - measure.rest(F.col("n")) - F.col("known")).alias("own"))
    known = scratch.store(shared.join(own, "node").drop("place"), "own")
    stars = _per_ngram(known, scratch, center=F.min(F.struct("own", "node", "n")))
    stars = stars.select("node", "n", F.col("center.node").alias("center"), F.col("center.n").alias("nc"))
    stars = stars.where((F.col("node") != F.col("center")) & measure.sizes_fit(F.col("n"), F.col("nc")))
    stars = _bounded(stars.select(F.col("node").alias("a"), F.col("center").alias("b"), F.col("n").alias("na"), F.col("nc").alias("nb")), measure)
    best = stars.groupBy("a").agg(F.max(F.struct("overlap", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    first = _verified(scratch.store(best, "stars"), nodes, df, text, measure, scratch)
    groups = connected(first, scratch)
    # The first n-gram that a pair shares leaves room for the required overlap behind it in both sets.
    early = shared.where(F.col("place") <= F.col("n") - F.call_function("div", measure.percent * F.col("n") + 99, F.lit(100)))
    placed = early.select("ngram", "node", "n", "place", "part").join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    placed = scratch.store(placed.drop("component"), "placed")
    mixed = _per_ngram(placed, scratch, low=F.min("group"), high=F.max("group")).where("low <> high")
    mixed = scratch.store(mixed.select("ngram", "node", "n", "place", "group"), "mixed")
    one = mixed.select("ngram", *(F.col(c).alias(f"{c}_a") for c in ("node", "n", "place", "group")))
    two = mixed.select("ngram", *(F.col(c).alias(f"{c}_b") for c in ("node", "n", "place", "group")))
    overlap = measure.overlap(F.col("n_a"), F.col("n_b"))
    room = (F.col("place_a") <= F.col("n_a") - overlap) & (F.col("place_b") <= F.col("n_b") - overlap)
    apart = (F.col("node_a") < F.col("node_b")) & (F.col("group_a") != F.col("group_b"))
    pairs = one.join(two, "ngram").where(apart & measure.sizes_fit(F.col("n_a"), F.col("n_b")) & room)
    pairs = pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("n_a").alias("na"), F.col("n_b").alias("nb")).distinct()
    pairs = scratch.store(_prefix_bounded(pairs, nodes, measure), "pairs")
    second = _verified(pairs, nodes, df, text, measure, scratch)
    final = connected(first.union(second), scratch)
    of_set = nodes.select("set_key", "node").join(final, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    placed = docs.join(of_set, "set_key", "left").select(
        *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)),
        F.col("n").alias("n_ngrams"),
        F.coalesce("component", F.col(row)).alias("component"),
    )
    result = stored(placed, "components")
    scratch.clear()
    return result


@query("op6_ngram_jaccard")
def op6(spark, sf_dir):
    found = components(documents(spark, sf_dir), "text", ["doc_id"])
    # Stored, so that the join deals both sides itself and can split a component that holds many rows.
    least = stored(found.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    return found.join(least, "component").select("doc_id", F.col("n_ngrams").alias("n_shingles"), "component_id")
