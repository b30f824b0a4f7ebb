"""A log-bilinear language model trained by noise-contrastive estimation.

Every word belongs to a class: the most frequent words and the end of a text are classes of their own, the others fall
into classes by their last letters. The model predicts the class from the two classes before it, and the word within its
class from the two words before it:

    log P(word | context) = log P(class | context) + log P(word | class, context)

P(class | context) is log-bilinear, a softmax over the product of a predicted vector and the class vectors. So is
P(word | class, context) for every word above a count floor, see ``lm_words``; the words of a class below the floor
share what is left to them by the additively smoothed unigram. Probabilities sum to one over the vocabulary and one unseen
word per class.

Word counts and class trigrams cover all training texts and are aggregated by Spark. Training starts from the
unigram. In each round every block of contexts takes gradient steps on the expected NCE objective over its trigram
counts in numpy, and the parameters, whose size is fixed, are averaged. The vectors of words learn from the texts themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm import lm_words
from holdfast.llm.registry import documents, query
from holdfast.llm.scratch import Scratch, most_frequent, stored
from holdfast.llm.words import SOLID, Words, distinct, equal_runs, find_words, hash_words, slices

#: Words with a class of their own beside the end, classes of other words, and the context before a text.
OWN, TAILS = 190, 64
END, CLASSES, BEFORE = OWN, OWN + 1 + TAILS, OWN + 1 + TAILS
SYMBOLS = BEFORE + 1

#: Frequent words whose counts every task holds, at most so many, as 16 bytes each; those of other words are joined.
FREQUENT = 1 << 18

#: Bytes of counts that a task holds to add up those of its batches.
HELD_BYTES = 32 << 20

DIMENSIONS, NOISE, ROUNDS, STEPS, BLOCKS, RATE = 32, 25, 6, 24, 12, 0.02

#: Contexts whose gradients are worked out together.
PIECE = 512

SMOOTHING = 0.1


def held_out(key: str, folds: int = 10) -> Column:
    """Documents that training never reads; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == 0


def added_up(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """A task's batches of counts ``n``, those of equal keys added up, while about ``HELD_BYTES`` are held."""

    def add_up(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        order, begins = equal_runs(table.column(key).to_numpy())
        summed = pa.array(np.add.reduceat(table.column("n").to_numpy()[order], begins))
        rows = table.take(pa.array(order[begins]))
        return rows.set_column(rows.schema.get_field_index("n"), "n", summed).combine_chunks().to_batches()[0]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.nbytes for b in held) > HELD_BYTES:
            held = [add_up(held)]
            if held[0].nbytes > HELD_BYTES // 2:
                yield held.pop()
    if held:
        yield add_up(held)


@cache
def _tails() -> tuple[np.ndarray, np.ndarray]:
    """The class of every ending of two bytes, and of every word of one."""

    def classes(data: np.ndarray, size: int) -> np.ndarray:
        start = np.arange(0, len(data), size)
        endings = Words(data, start, start + size, np.array([0, len(start)]))
        return (hash_words(endings) % np.uint64(TAILS)).astype(np.int64)

    every = np.arange(256, dtype=np.uint8)
    return classes(np.stack([np.repeat(every, 256), np.tile(every, 256)], axis=1).ravel(), 2), classes(every, 1)


def _tail_class(words: Words) -> np.ndarray:
    pairs, singles = _tails()
    last, before = words.data.take(words.end - 1), words.data.take(words.end - 2, mode="clip")
    return np.where(words.end - words.start > 1, pairs.take(before * np.int64(256) + last), singles.take(last))


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """``word``, its 64-bit ``hash``, ``tail`` (class by its last letters) and count ``c``; the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, text):
            words = find_words(texts.lower(), SOLID)
            hashes = hash_words(words)
            order, begins = equal_runs(hashes)
            example, counts = order[begins], np.diff(begins, append=len(order))
            hashes = hashes[example]
            tails = _tail_class(words)[example] if len(words) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([words.spelled(example), pa.array([""])]),
                    pa.array(np.append(hashes.view(np.int64), 0)),
                    pa.array(np.append(tails, 0)),
                    pa.array(np.append(counts, len(texts)).astype(np.int64)),
                ],
                names=["word", "hash", "tail", "n"],
            )

    def run_merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added_up(run(batches), "hash")

    found = df.select(text).mapInArrow(run_merged, "word string, hash long, tail long, n long")
    return stored(found.groupBy("word", "hash", "tail").agg(F.sum("n").alias("c")), "words")


@dataclass(frozen=True)
class Vocabulary:
    """Totals of the training tokens, the frequent words by hash, and the smoothed mass of every class.

    ``vector`` is a frequent word's number in ``tree``, the words above the floor, or -1. Hashes whose first bits read b
    are the numbers ``buckets[b]`` up to ``buckets[b + 1]``, few each.
    """

    tokens: int
    distinct: int
    hashes: np.ndarray
    counts: np.ndarray
    own: np.ndarray
    end_count: int
    mass: np.ndarray
    vector: np.ndarray
    tree: lm_words.Tree
    buckets: np.ndarray

    def log_share(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + SMOOTHING) / (self.tokens + SMOOTHING * (self.distinct + 1)))

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each frequent word, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        first = (hashes >> np.uint64(64 - (len(self.buckets) - 1).bit_length() + 1)).astype(np.int64)
        # Most words are the first of their bucket; a hash that equals one of the next bucket would lie there itself.
        at = self.buckets.take(first)
        same = self.hashes.take(at, mode="clip") == hashes
        found = np.where(same, at, -1)
        todo = np.flatnonzero(~same)
        at, end = at[todo] + 1, self.buckets[first[todo] + 1]
        while len(todo):
            left = at < end
            todo, at, end = todo[left], at[left], end[left]
            same = self.hashes[at] == hashes[todo]
            found[todo[same]] = at[same]
            todo, at, end = todo[~same], at[~same] + 1, end[~same]
        return found


def bucket_starts(hashes: np.ndarray) -> np.ndarray:
    """Where the buckets of sorted hashes begin: by as many first bits as give about one hash a bucket, and the end."""
    bits = max(1, len(hashes).bit_length())
    return np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int64)


def vocabulary(counts: DataFrame) -> Vocabulary | None:
    """The vocabulary of a table of word counts, or None if it is empty."""
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(F.col("word") == "", F.col("c"))).alias("e")).first()
    if not total["n"]:
        return None
    top = most_frequent(counts.where("word <> ''"), "c", FREQUENT).select("hash", "c", "tail").toArrow()
    top = top.sort_by([("c", "descending"), ("hash", "ascending")])
    hashes, c, tails = (top.column(name).to_numpy() for name in ("hash", "c", "tail"))
    sums = counts.where("word <> ''").groupBy("tail").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    mass = np.zeros(CLASSES)
    mass[: min(OWN, len(c))] = c[:OWN] + SMOOTHING
    mass[END] = total["e"] + SMOOTHING
    mass[END + 1 :] = SMOOTHING
    for row in sums:
        mass[END + 1 + row["tail"]] += row["c"] + SMOOTHING * row["v"]
    np.subtract.at(mass, END + 1 + tails[:OWN], c[:OWN] + SMOOTHING)
    mass = np.maximum(mass, SMOOTHING * 1e-3) / (total["n"] + SMOOTHING * (total["v"] + 1))
    own = np.full(len(c), -1)
    own[:OWN] = np.arange(min(OWN, len(c)))
    above = np.flatnonzero((c >= lm_words.floor_of(total["n"])) & (own < 0))
    vector = np.full(len(c), -1)
    vector[above] = np.arange(len(above))
    share = (c[above] + SMOOTHING) / (total["n"] + SMOOTHING * (total["v"] + 1))
    tree = lm_words.build_tree(CLASSES, END + 1 + tails[above], share, mass)
    order = np.argsort(hashes.view(np.uint64))
    ordered = hashes.view(np.uint64)[order]
    return Vocabulary(total["n"], total["v"], ordered, c[order], own[order], total["e"], mass, vector[order], tree, bucket_starts(ordered))


@dataclass(frozen=True)
class Tokens:
    """The tokens of a slice, texts one after the other, each with its end: class, context, and text."""

    classes: np.ndarray
    contexts: np.ndarray
    offsets: np.ndarray


def tokens(words: Words, numbers: np.ndarray, vocabulary: Vocabulary) -> Tokens:
    classes = END + 1 + _tail_class(words) if len(words) else np.zeros(0, np.int64)
    if len(vocabulary.own):
        own = np.where(numbers >= 0, vocabulary.own[numbers], -1)
        classes = np.where(own >= 0, own, classes)
    texts = np.arange(len(words.offsets))
    offsets = words.offsets + texts
    of_text = np.repeat(texts[:-1], np.diff(words.offsets))
    sequence = np.full(offsets[-1], END, dtype=np.int64)
    sequence[np.arange(len(words)) + of_text] = classes
    # Two symbols before each text, so that contexts do not cross texts.
    one = np.concatenate([[BEFORE], sequence])[:-1]
    one[offsets[:-1]] = BEFORE
    two = np.concatenate([[BEFORE], one])[:-1]
    two[offsets[:-1]] = BEFORE
    return Tokens(sequence, two * SYMBOLS + one, offsets)


def word_events(words: Words, numbers: np.ndarray, found: Tokens, vocabulary: Vocabulary) -> lm_words.Events:
    """What the tokens say about words within their classes."""
    word = np.full(len(found.classes), -1)
    of_text = np.repeat(np.arange(len(words.offsets) - 1), words.counts())
    if len(vocabulary.vector):
        word[np.arange(len(words)) + of_text] = np.where(numbers >= 0, vocabulary.vector[numbers], -1)
    return lm_words.events(vocabulary.tree, word, found.classes, found.offsets, BEFORE)


def train_words(df: DataFrame, text: str, known: Vocabulary) -> lm_words.Vectors:
    """The vectors of words, trained on all texts."""
    vectors = lm_words.Vectors.start(known.tree, CLASSES)
    for number in range(lm_words.PASSES if len(known.tree) else 0):
        shared = df.sparkSession.sparkContext.broadcast((known, vectors))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            known, vectors = shared.value
            learner = lm_words.Learner(known.tree, vectors, 1000 * TaskContext.get().partitionId() + number)
            for _, texts in slices(batches, text):
                words = find_words(texts.lower(), SOLID)
                numbers = known.look_up(hash_words(words))
                learner.learn(word_events(words, numbers, tokens(words, numbers, known), known))
            yield from learner.changes()

        vectors = lm_words.averaged(vectors, df.select(text).mapInArrow(run, lm_words.CHANGES))
        shared.unpersist()
    return vectors


def trigrams(df: DataFrame, text: str, known: Vocabulary) -> DataFrame:
    """``context``, ``target`` and their count ``n`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, text):
            words = find_words(texts.lower(), SOLID)
            found = tokens(words, known.look_up(hash_words(words)), known)
            codes, n = np.unique(found.contexts * CLASSES + found.classes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], names=["code", "n"])

    def run_merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added_up(run(batches), "code")

    summed = df.select(text).mapInArrow(run_merged, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return summed.select((F.col("code") / CLASSES).cast("int").alias("context"), (F.col("code") % CLASSES).cast("int").alias("target"), "n")


@dataclass
class Parameters:
    """Vectors of context symbols and of classes, a matrix per place in the context, and a bias per class."""

    inputs: np.ndarray
    outputs: np.ndarray
    far: np.ndarray
    near: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(mass: np.ndarray, size: int = DIMENSIONS) -> Parameters:
        random = np.random.default_rng(7)
        return Parameters(
            random.normal(0, 0.3, (SYMBOLS, size)), random.normal(0, 0.05, (CLASSES, size)),
            np.eye(size) * 0.5, np.eye(size), np.log(mass / mass.sum()),
        )

    def arrays(self) -> list[np.ndarray]:
        return [self.inputs, self.outputs, self.far, self.near, self.bias]

    def scores(self, contexts: np.ndarray) -> np.ndarray:
        """Unnormalised scores, a row per context."""
        predicted = self.inputs[contexts // SYMBOLS] @ self.far + self.inputs[contexts % SYMBOLS] @ self.near
        return predicted @ self.outputs.T + self.bias

    def log_probabilities(self) -> np.ndarray:
        """log10 P(class | context) for every context and class, normalised."""
        small = Parameters(*(a.astype(np.float32) for a in self.arrays()))
        table = np.empty((SYMBOLS * SYMBOLS, CLASSES), dtype=np.float32)
        for first in range(0, len(table), 4096):
            scores = small.scores(np.arange(first, min(first + 4096, len(table))))
            scores -= scores.max(axis=1, keepdims=True)
            scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
            table[first : first + 4096] = scores / np.float32(np.log(10))
        return table


def _add_rows(table: np.ndarray, rows: np.ndarray, parts: np.ndarray) -> None:
    """Add parts to rows of the table, several to one row."""
    order, begins = equal_runs(rows)
    table[rows[order[begins]]] += np.add.reduceat(parts.take(order, axis=0), begins, axis=0)


def nce_gradient(p: Parameters, contexts: np.ndarray, counts: np.ndarray, noise: np.ndarray) -> list[np.ndarray]:
    """The gradient of the expected NCE loss per token.

    ``counts`` has a row per context and a column per class. Each token stands against ``NOISE`` draws from ``noise``; their
    expectation replaces the draws.
    """
    total = counts.sum()
    far, near = contexts // SYMBOLS, contexts % SYMBOLS
    in_far, in_near = p.inputs.take(far, axis=0), p.inputs.take(near, axis=0)
    predicted = in_far @ p.far + in_near @ p.near
    back = np.empty_like(predicted)
    outputs, bias = np.zeros_like(p.outputs), np.zeros_like(p.bias)
    shift = p.bias - np.log(NOISE * noise)
    # A few hundred contexts at a time stay in the processor's cache.
    for a in range(0, len(contexts), PIECE):
        given, real = counts[a : a + PIECE], predicted[a : a + PIECE] @ p.outputs.T
        real += shift
        np.clip(real, -30, 30, out=real)
        np.exp(np.negative(real, out=real), out=real)
        real += 1.0
        # Noise that passes for a token, less the tokens that pass for noise.
        slope = (NOISE * given.sum(axis=1, keepdims=True)) * noise
        slope += given
        slope /= real
        slope -= given
        slope /= total
        back[a : a + PIECE] = slope @ p.outputs
        outputs += slope.T @ predicted[a : a + PIECE]
        bias += slope.sum(axis=0)
    inputs = np.zeros_like(p.inputs)
    _add_rows(inputs, far, back @ p.far.T)
    _add_rows(inputs, near, back @ p.near.T)
    return [inputs, outputs, in_far.T @ back, in_near.T @ back, bias]


def nce_steps(p: Parameters, contexts: np.ndarray, counts: np.ndarray, noise: np.ndarray, steps: int, rate: float) -> Parameters:
    """Adam steps on one block of contexts."""
    arrays = [a.copy() for a in p.arrays()]
    first, second = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]
    for t in range(1, steps + 1):
        for k, g in enumerate(nce_gradient(Parameters(*arrays), contexts, counts, noise)):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            arrays[k] -= rate * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    return Parameters(*arrays)


def train(counted: DataFrame, mass: np.ndarray, rounds: int = ROUNDS, blocks: int = BLOCKS) -> Parameters:
    """Parameters trained on all trigram counts, in blocks of contexts whose parameters are averaged by their tokens."""
    noise = (mass / mass.sum()).astype(np.float32)
    # At most SYMBOLS**2 contexts exist, so a block is bounded whatever the corpus.
    scratch = Scratch(counted.sparkSession)
    blocked = scratch.store(counted.repartition(blocks, "context"), "trigrams")
    now = Parameters.start(mass)
    shapes = [a.shape for a in now.arrays()]
    for number in range(rounds):
        given, rate = [a.astype(np.float32) for a in now.arrays()], RATE * 0.75**number

        def run(batches: Iterator[pa.RecordBatch], given=given, rate=rate) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            table = pa.Table.from_batches(held)
            contexts, row = np.unique(table.column("context").to_numpy(), return_inverse=True)
            counts = np.zeros((len(contexts), CLASSES), dtype=np.float32)
            counts[row, table.column("target").to_numpy()] = table.column("n").to_numpy()
            after = nce_steps(Parameters(*given), contexts, counts, noise, STEPS, rate)
            packed = np.concatenate([a.ravel() for a in after.arrays()]).astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([float(counts.sum())]), pa.array([packed], pa.binary())], names=["weight", "packed"])

        grouped = blocked.mapInArrow(run, "weight double, packed binary").toArrow()
        weights = np.array(grouped.column("weight").to_pylist())
        order = np.argsort(weights, kind="stable")
        vectors = [np.frombuffer(grouped.column("packed")[int(i)].as_buffer(), np.float32).astype(np.float64) for i in order]
        mean = sum(w * v for w, v in zip(weights[order] / weights.sum(), vectors, strict=True))
        ends = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        now = Parameters(*(part.reshape(s) for part, s in zip(np.split(mean, ends), shapes, strict=True)))
    scratch.clear()
    return now


def score(df: DataFrame, key: str, text: str, known: Vocabulary, counts: DataFrame, model: Parameters, vectors: lm_words.Vectors) -> DataFrame:
    """Per row of the frame its key, ``n_tokens``, ``n_known``, ``base_score`` and ``score``, log10 probabilities of the whole text.

    Null and empty texts are the end alone. The counts of words beyond the frequent ones are joined; equal words of
    a row are one row of that join.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((known, model, vectors))
    frame = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model, vectors = shared.value
        table = model.log_probabilities()
        gain = np.log10(known.mass)
        share, end = known.log_share(known.counts), float(known.log_share(np.array([known.end_count]))[0])
        for batch, texts in slices(batches, "text"):
            words = find_words(texts.lower(), SOLID)
            hashes = hash_words(words)
            numbers = known.look_up(hashes)
            found = tokens(words, numbers, known)
            delta = table[found.contexts, found.classes] - gain[found.classes]
            delta = delta + lm_words.log_gains(known.tree, vectors, word_events(words, numbers, found, known), len(delta))
            of_word = np.repeat(np.arange(len(texts)), words.counts())
            frequent = numbers >= 0
            delta = np.add.reduceat(delta.astype(np.float64), found.offsets[:-1])
            base = np.bincount(of_word[frequent], share[numbers[frequent]], minlength=len(texts)) + end
            known_here = np.bincount(of_word[frequent], minlength=len(texts)) + int(known.end_count > 0)
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            rare = np.flatnonzero(~frequent)
            example, same = distinct(hashes[rare])
            _, first, n = np.unique(of_word[rare] * max(len(example), 1) + same, return_index=True, return_counts=True)
            rare = rare[first]
            pad = np.zeros(len(rare))

            def column(of_text: np.ndarray, of_rare: np.ndarray, kind: pa.DataType) -> pa.Array:
                return pa.array(np.concatenate([of_text, of_rare]), kind)

            keys = pa.concat_arrays([batch.column("key"), pa.nulls(len(rare), batch.column("key").type)])
            spelled = pa.concat_arrays([pa.nulls(len(texts), pa.string()), words.spelled(rare)])
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    column(rows, rows[of_word[rare]], pa.int64()),
                    spelled,
                    column(np.zeros(len(texts)), n, pa.int64()),
                    column(words.counts() + 1, pad, pa.int64()),
                    column(known_here, pad, pa.int64()),
                    column(base, pad, pa.float64()),
                    column(delta, pad, pa.float64()),
                ],
                names=["key", "row", "word", "n", "n_tokens", "n_known", "base", "delta"],
            )

    parts = T.StructType.fromDDL("row long, word string, n long, n_tokens long, n_known long, base double, delta double")
    scored = stored(frame.mapInArrow(run, T.StructType([frame.schema["key"], *parts.fields])), "scored")
    smooth = known.tokens + SMOOTHING * (known.distinct + 1)
    rare = scored.where("word is not null").select("row", "word", "n").join(counts.select("word", "c"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    rare = rare.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"), F.sum(F.col("n") * F.log10((c + SMOOTHING) / smooth)).alias("rare_base")
    )
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0))
    return (
        scored.where("word is null")
        .join(rare, "row", "left")
        .select(
            F.col("key").alias(key),
            "n_tokens",
            (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            base.alias("base_score"),
            (base + F.col("delta")).alias("score"),
        )
    )


def language_model_scores(df: DataFrame, key: str, text: str, training: Column) -> DataFrame:
    """Train on the rows where ``training`` and score every row, as ``score`` does, with ``train_tokens``.

    Without training rows every score is 0, the logarithm that the formula gives for an empty vocabulary.
    """
    counts = word_counts(df.where(training), text)
    known = vocabulary(counts)
    if known is None:
        n = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long") + 1
        zero = F.lit(0.0)
        return df.select(key, n.alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), zero.alias("base_score"), zero.alias("score")).withColumn(
            "train_tokens", F.lit(0).cast("long")
        )
    model = train(trigrams(df.where(training), text, known), known.mass)
    vectors = train_words(df.where(training), text, known)
    return score(df, key, text, known, counts, model, vectors).withColumn("train_tokens", F.lit(known.tokens).cast("long"))


@query("op4_lm_scoring")
def op4(spark, sf_dir):
    scored = language_model_scores(documents(spark, sf_dir), "doc_id", "text", ~held_out("doc_id"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
