"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is logistic in its words; a document's is the noisy-or of its sentences', one minus the
product of their complements. The weights are trained on document labels alone, and afterwards point at the
offending sentences.

Every sentence has some probability, so neutral ones would add up over a long document. Sentences at or below a neutral
level count nothing: the least level at which those of labelled clean documents of any length stay under the threshold over
``REACH`` sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.registry import documents, query
from holdfast.llm.scratch import Scratch
from holdfast.llm.words import ALNUM, Texts, Words, find_words, hash_words, slices

#: Labelled rows that training reads, about so many at most, and the length in bytes of the longest among them.
POSITIVE_ROWS, NEGATIVE_ROWS, TRAINING_BYTES = 2500, 5000, 200_000

#: A feature stands in so many of these rows at least, and so many features are trained at most, the most telling ones.
LEAST, FEATURES = 5, 100_000

#: Words count as they are and by their first bytes, which inflected forms share.
STEMS = (4, 5, 7)

THRESHOLD = 0.3

#: So many clean sentences stay below the threshold together. No sentence beyond the probability ``SUSPECT`` counts as neutral.
REACH, SUSPECT = 5_000_000, 0.05

#: What the sentences up to the neutral level may add to a score, all together.
TRACE = 0.01

#: Logits are counted in bins of so much, from ``-_DEEPEST`` on.
_BIN, _DEEPEST = 0.05, 50.0

_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?\n")] = True


@dataclass(frozen=True)
class Sentences:
    """Sentence i holds the words ``first[i]`` up to ``first[i + 1]``; text i the sentences ``offsets[i]`` up to ``offsets[i + 1]``."""

    words: Words
    first: np.ndarray
    offsets: np.ndarray


def sentences(texts: Texts) -> Sentences:
    """Sentences end with a full stop, an exclamation or question mark, a line or a text; those without a word are left out."""
    words = find_words(texts.lower(), ALNUM)
    number = np.searchsorted(np.flatnonzero(_ENDS[texts.data]), words.start)
    new = np.ones(len(words), dtype=bool)
    new[1:] = number[1:] != number[:-1]
    new[words.offsets[:-1][words.offsets[:-1] < len(words)]] = True
    first = np.flatnonzero(new)
    return Sentences(words, np.append(first, len(words)), np.searchsorted(first, words.offsets))


def word_features(words: Words) -> np.ndarray:
    """A row per kind of feature: the 32-bit hash of the word and of each of its stems."""
    kinds = [words, *(Words(words.data, words.start, np.minimum(words.end, words.start + k), words.offsets) for k in STEMS)]
    hashes = [hash_words(w) ^ np.uint64(0x51ED270B * k) for k, w in enumerate(kinds)]
    return np.stack([(h >> np.uint64(16)).astype(np.uint32) for h in hashes])


@dataclass(frozen=True)
class Model:
    """Weights of feature hashes, in order of hash; features that are not listed weigh nothing.

    Sentences with a logit up to ``neutral`` add no more than a trace to their document.
    """

    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    neutral: float = -np.inf

    def word_scores(self, words: Words) -> np.ndarray:
        scores = np.zeros(len(words), dtype=np.float64)
        if not len(self.hashes):
            return scores
        known = np.zeros(1 << 16, dtype=bool)
        known[self.hashes & np.uint32(0xFFFF)] = True
        for row in word_features(words):
            likely = np.flatnonzero(known[row & np.uint32(0xFFFF)])
            at = np.minimum(np.searchsorted(self.hashes, row[likely]), len(self.hashes) - 1)
            scores[likely] += np.where(self.hashes[at] == row[likely], self.weights[at], 0.0)
        return scores

    def sentence_logits(self, found: Sentences) -> np.ndarray:
        if len(found.first) == 1:
            return np.zeros(0)
        return self.bias + np.add.reduceat(self.word_scores(found.words), found.first[:-1])


def noisy_or(logits: np.ndarray, offsets: np.ndarray, neutral: float = -np.inf) -> np.ndarray:
    """The probability per document, from its sentences' logits above ``neutral`` and a trace of what all of them say.

    The trace keeps documents without a suspect sentence in order; it grows with every logit and adds ``TRACE`` at most, however
    many sentences there are. Documents without sentences get 0.
    """
    mass, every = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        weight = np.logaddexp(0.0, logits)
        every[some] = np.add.reduceat(weight, offsets[some])
        mass[some] = np.add.reduceat(np.where(logits > neutral, weight, 0.0), offsets[some])
    return (1.0 - TRACE) * -np.expm1(-mass) + TRACE * -np.expm1(-every)


def fit(
    hashes: np.ndarray, entry: np.ndarray, sentence: np.ndarray, offsets: np.ndarray, labels: np.ndarray, weights: np.ndarray,
    rounds: int = 150, rate: float = 0.1, sparsity: float = 2e-5,
) -> Model:
    """Train on documents whose sentences have numbers ``offsets[i]`` up to ``offsets[i + 1]``.

    ``entry`` and ``sentence`` list which of the features stands in which sentence. Proximal gradient steps on the noisy-or
    likelihood set weak weights to zero.
    """
    count = int(offsets[-1])
    spread = np.repeat(np.arange(len(labels)), np.diff(offsets))
    w, bias = np.zeros(len(hashes)), -6.0
    moment, square, step_bias = np.zeros(len(hashes)), np.zeros(len(hashes)), [0.0, 0.0]
    norm = weights.sum()
    for step in range(1, rounds + 1):
        logits = bias + np.bincount(sentence, w[entry], minlength=count)
        mass = np.bincount(spread, np.logaddexp(0.0, logits), minlength=len(labels))
        slope = np.where(labels > 0, -1.0 / np.expm1(np.clip(mass, 1e-6, 50.0)), 1.0) * weights / norm
        down = slope[spread] / (1.0 + np.exp(-logits))
        gradient, bias_gradient = np.bincount(entry, down[sentence], minlength=len(hashes)), float(down.sum())
        moment, square = 0.9 * moment + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        scale = rate / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
        w = w - scale * moment / (1 - 0.9**step)
        w = np.sign(w) * np.maximum(np.abs(w) - scale * sparsity, 0.0)
        step_bias = [0.9 * step_bias[0] + 0.1 * bias_gradient, 0.99 * step_bias[1] + 0.01 * bias_gradient**2]
        bias -= rate * step_bias[0] / (1 - 0.9**step) / (np.sqrt(step_bias[1] / (1 - 0.99**step)) + 1e-6)
    kept = np.flatnonzero(w)
    return Model(hashes[kept], w[kept], float(bias))


def neutral_level(bins: np.ndarray, counts: np.ndarray) -> float:
    """The neutral logit, from the numbers of clean sentences per bin of logits."""
    order = np.argsort(bins)
    top = (bins[order] + 1) * _BIN - _DEEPEST
    above = np.cumsum((counts[order] * np.logaddexp(0.0, top))[::-1])[::-1]
    # What the bins after each one add up to, a sentence.
    left = np.append(above[1:], 0.0) / max(int(counts.sum()), 1)
    suspect = np.log(SUSPECT / (1.0 - SUSPECT))
    enough = np.flatnonzero(left * REACH < -np.log1p(-THRESHOLD))
    return float(min(top[enough[0]], suspect)) if len(enough) else -np.inf


def clean_logits(df: DataFrame, text: str, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the logits of all sentences, and their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, text):
            logits = np.clip(model.sentence_logits(sentences(texts)), -_DEEPEST, _DEEPEST)
            bins, n = np.unique(np.floor((logits + _DEEPEST) / _BIN).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n.astype(np.int64))], names=["bin", "n"])

    found = df.select(text).mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    return found.column("bin").to_numpy(), found.column("n").to_numpy()


NO_MODEL = Model(np.zeros(0, np.uint32), np.zeros(0), -30.0)


def held_out(key: str) -> Column:
    """Documents that training never reads."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    df: DataFrame, labels: DataFrame, key: str, text: str, label: str, allowed: Column,
    positives: int = POSITIVE_ROWS, negatives: int = NEGATIVE_ROWS, most_bytes: int = TRAINING_BYTES,
) -> Model:
    """A model from labelled documents where ``allowed``.

    Labels other than 0 and 1 and null keys are left out, and a key with both is labelled 1. Of each label the keys
    of least hash are taken, about as many as the bound, and one row of each, whatever their order, so the texts of no others are moved; the likelihood weighs the
    negatives up to their share among all labels. Features of fewer than ``LEAST`` of these rows, or about as frequent under
    either label, are left out. Texts beyond ``most_bytes`` are left to the neutral level, which clean ones of any length
    set. Without a label of either kind every document scores near 0.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & allowed).groupBy(F.col(key).alias("key"))
    known = known.agg(F.max(label).cast("int").alias("label")).withColumn("hash", F.xxhash64("key"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return NO_MODEL
    part = F.when(F.col("label") == 1, F.lit(positives / totals[1])).otherwise(F.lit(negatives / totals[0]))
    sample = known.where(F.pmod("hash", F.lit(1 << 30)) < part * (1 << 30))
    texts = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    scratch = Scratch(df.sparkSession)
    # Some thousand keys, by the two bounds; of a repeated key each task passes on one row.
    least = F.struct(F.octet_length("text") > most_bytes, F.xxhash64("text"), "text")
    chosen = texts.join(F.broadcast(sample), "key").groupBy("key", "label").agg(F.min(least).alias("x"))
    every = scratch.store(chosen.select("key", "label", "x.text"), "labelled")
    stored = every.where(F.octet_length("text") <= most_bytes)
    rows = {r["label"]: r["count"] for r in stored.groupBy("label").count().collect()}
    if not rows.get(0) or not rows.get(1):
        return NO_MODEL
    weight = (totals[0] / rows[0]) / (totals[1] / rows[1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found_texts in slices(batches, "text"):
            found = sentences(found_texts)
            tags = np.array(batch.column("label").to_pylist())[np.repeat(np.arange(len(found_texts)), found.words.counts())]
            owner = np.repeat(np.arange(len(found_texts), dtype=np.uint64), found.words.counts())
            for row in word_features(found.words):
                pairs, first = np.unique((owner << np.uint64(32)) | row, return_index=True)
                values, inverse = np.unique(pairs & np.uint64(0xFFFFFFFF), return_inverse=True)
                positive = np.bincount(inverse, tags[first], minlength=len(values)).astype(np.int64)
                both = np.bincount(inverse, minlength=len(values))
                yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(positive), pa.array(both - positive)], names=["h", "p", "n"])

    counted = stored.mapInArrow(count, "h long, p long, n long").groupBy("h").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    odds = F.abs(F.log((F.col("p") + 0.5) / (rows[1] + 1)) - F.log((F.col("n") * weight + 0.5) / (rows[0] * weight + 1)))
    telling = counted.where((F.col("p") + F.col("n") >= LEAST) & (odds > 1)).orderBy(odds.desc(), "h").limit(FEATURES).select("h").toArrow()
    hashes = np.sort(telling.column("h").to_numpy().astype(np.uint32))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found_texts in slices(batches, "text"):
            found = sentences(found_texts)
            number = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
            entries, places = [], []
            for row in word_features(found.words):
                at = np.minimum(np.searchsorted(hashes, row), max(len(hashes) - 1, 0))
                hit = np.flatnonzero(hashes[at] == row) if len(hashes) else np.zeros(0, np.int64)
                entries.append(at[hit])
                places.append(number[hit])
            entry, place = np.concatenate(entries), np.concatenate(places)
            order = np.argsort(place, kind="stable")
            entry, place = entry[order], place[order]
            ends = np.searchsorted(place, found.offsets)
            packed = [(entry[a:b].astype("<i4").tobytes(), (place[a:b] - o).astype("<i4").tobytes()) for a, b, o in zip(ends, ends[1:], found.offsets, strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").cast(pa.string()),
                    batch.column("label"),
                    pa.array([e for e, _ in packed], pa.binary()),
                    pa.array([p for _, p in packed], pa.binary()),
                    pa.array(np.diff(found.offsets)),
                ],
                names=["key", "label", "entry", "sentence", "sentences"],
            )

    kept = "key string, label int, entry binary, sentence binary, sentences long"
    # In one order whatever the tasks.
    table = stored.mapInArrow(measure, kept).toArrow().sort_by([("label", "ascending"), ("key", "ascending"), ("sentences", "ascending")])
    tags = table.column("label").to_numpy().astype(np.float64)
    offsets = np.concatenate([[0], np.cumsum(table.column("sentences").to_numpy())])
    entry = np.frombuffer(b"".join(table.column("entry").to_pylist()), "<i4")
    own = [np.frombuffer(p, "<i4") + o for p, o in zip(table.column("sentence").to_pylist(), offsets[:-1], strict=True)]
    model = fit(hashes, entry, np.concatenate(own), offsets, tags, np.where(tags > 0, 1.0, weight))
    neutral = neutral_level(*clean_logits(every.where("label = 0"), "text", model))
    scratch.clear()
    return replace(model, neutral=neutral)


def score(df: DataFrame, text: str, model: Model, out: str = "toxicity", threshold: float = THRESHOLD) -> DataFrame:
    """The frame with a struct ``out``: ``score``, and ``spans`` of the offending sentences.

    ``spans`` lists sentences whose own probability reaches the threshold: start and end in code points, from the first
    word's start to the last one's end, and score. Null and empty texts score 0 and have none. Every row stays; a
    column already called ``out`` is replaced.
    """
    df = df.drop(out)
    kind = T.StructType.fromDDL("score double, spans array<struct<start: int, end: int, score: double>>")
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])
    arrow = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            found = sentences(texts)
            logits = model.sentence_logits(found)
            scores = noisy_or(logits, found.offsets, model.neutral)
            own = 1.0 / (1.0 + np.exp(-logits))
            spans: list[list[dict]] = [[] for _ in range(len(texts))]
            for s in np.flatnonzero(own >= threshold).tolist():
                i = int(np.searchsorted(found.offsets, s, side="right")) - 1
                a, b = int(found.words.start[found.first[s]]), int(found.words.end[found.first[s + 1] - 1])
                low = int(texts.offsets[i])
                before = len(texts.data[low:a].tobytes().decode())
                spans[i].append({"start": before, "end": before + len(texts.data[a:b].tobytes().decode()), "score": float(own[s])})
            column = pa.array([{"score": v, "spans": s} for v, s in zip(scores.tolist(), spans, strict=True)], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def predicted(score_column: str, threshold: float = THRESHOLD) -> Column:
    return (F.col(score_column) >= threshold).cast("int")


@query("op9_toxicity")
def op9(spark, sf_dir):
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, "doc_id", "text", "toxic", ~held_out("doc_id"))
    return score(docs, "text", model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "toxicity.score", predicted("toxicity.score").alias("predicted")
    )
