import math
import random
import re

import numpy as np
import pyarrow as pa
from llm_cases import ODD
from pyspark.sql import functions as F

from holdfast.llm import toxicity
from holdfast.llm.words import texts_of

BAD = ["loser", "scum", "moron"]


def corpus(count=900, seed=4):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(count):
        said = [" ".join(f"word{rng.randrange(300)}" for _ in range(rng.randrange(3, 12))) for _ in range(rng.randrange(1, 15))]
        toxic = rng.random() < 0.2
        if toxic:
            place = rng.randrange(len(said))
            said[place] += f" you {rng.choice(BAD)}{rng.choice(['', 's', 'ish'])}"
        docs.append((i, ". ".join(said) + "."))
        labels.append((i, int(toxic)))
    return docs, labels


def test_sentences_end_where_they_should():
    found = toxicity.sentences(texts_of(pa.array(["One two. Three!\nfour", "", "...", "five"])))
    words = [[found.words.word(w).decode() for w in range(a, b)] for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
    assert words == [["one", "two"], ["three"], ["four"], ["five"]]
    assert found.offsets.tolist() == [0, 3, 3, 3, 4]


def test_noisy_or():
    logits = np.array([0.0, 1.0, -2.0])
    p = 1 / (1 + np.exp(-logits))
    got = toxicity.noisy_or(logits, np.array([0, 2, 2, 3]))
    assert np.allclose(got, [1 - (1 - p[0]) * (1 - p[1]), 0.0, p[2]])


def test_held_out_documents_and_their_sentences(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    tags = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.train(df, tags, "doc_id", "text", "toxic", ~toxicity.held_out("doc_id"))
    rows = toxicity.score(df, "text", model).withColumn("held", toxicity.held_out("doc_id")).where("held").collect()
    truth = dict(labels)
    right = sum((r.toxicity.score >= toxicity.THRESHOLD) == bool(truth[r.doc_id]) for r in rows)
    assert len(rows) > 150 and right / len(rows) > 0.97
    for r in rows:
        text = r.text
        if truth[r.doc_id] and r.toxicity.score >= 0.9:
            assert any(b in text[s.start : s.end] for s in r.toxicity.spans for b in BAD)


def test_length_alone_is_not_toxic(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    tags = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.train(df, tags, "doc_id", "text", "toxic", ~toxicity.held_out("doc_id"))
    rng = random.Random(9)
    said = [" ".join(f"word{rng.randrange(300)}" for _ in range(rng.randrange(3, 12))) for _ in range(80_000)]
    clean = ". ".join(said)
    toxic = ". ".join([*said[:40_000], "word1 you loser word2", *said[40_000:]])
    assert len(clean) > 3_000_000
    rows = toxicity.score(spark.createDataFrame([(0, clean), (1, toxic)], "doc_id bigint, text string"), "text", model).collect()
    scores = {r.doc_id: r.toxicity.score for r in rows}
    assert scores[0] < toxicity.THRESHOLD <= scores[1]


def test_scores_equal_plain_python(spark):
    docs, labels = corpus(300, seed=8)
    df = spark.createDataFrame([*docs, *ODD], "doc_id bigint, text string").repartition(4)
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id bigint, toxic int"), "doc_id", "text", "toxic", ~toxicity.held_out("doc_id"))
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))

    def brute(text):
        every, above = 1.0, 1.0
        for sentence in re.split(r"[.!?\n]", text or ""):
            words = re.findall(rb"[0-9a-z\x80-\xff]+", sentence.encode().lower())
            if not words:
                continue
            logit = model.bias
            for k, stem in enumerate((None, *toxicity.STEMS)):
                hashes = toxicity.hash_words(words_of(*(w[:stem] for w in words))) ^ np.uint64(0x51ED270B * k)
                logit += sum(weight.get(int(h) >> 16 & 0xFFFFFFFF, 0.0) for h in hashes)
            every *= 1 - 1 / (1 + math.exp(-logit))
            above *= 1 - 1 / (1 + math.exp(-logit)) if logit > model.neutral else 1
        return (1 - toxicity.TRACE) * (1 - above) + toxicity.TRACE * (1 - every)

    def words_of(*words):
        return toxicity.find_words(texts_of(pa.array([b" ".join(words).decode("latin-1").encode("latin-1")], pa.binary()).cast(pa.string(), safe=False)), toxicity.ALNUM)

    found = toxicity.score(df, "text", model).collect()
    assert len(weight) > 10 and any(r.toxicity.score > 0.3 for r in found)
    assert all(abs(r.toxicity.score - brute(r.text)) < 1e-9 for r in found)


def test_neutral_documents_keep_their_order():
    logits = np.array([-9.0, -4.0, -9.0, -8.0, *[-3.5] * 10_000])
    scores = toxicity.noisy_or(logits, np.array([0, 2, 4, 10_004]), neutral=-3.0)
    assert 0 < scores[1] < scores[0] < scores[2] <= toxicity.TRACE


def test_a_repeated_key_is_one_training_row(spark, monkeypatch):
    docs, labels = corpus(200)
    hot = next(k for k, toxic in labels if not toxic)
    again = [(hot, f"word{i} word{i + 1}. {t}") for i, (_, t) in enumerate(docs[:90])]
    df = spark.createDataFrame([*docs, *again, (hot, "long " * 50_000)], "doc_id bigint, text string").repartition(5)
    seen = {}

    def fit(hashes, entry, sentence, offsets, tags, weights):
        seen.update(tags=tags, weights=weights)
        return toxicity.NO_MODEL

    monkeypatch.setattr(toxicity, "fit", fit)
    toxicity.train(df, spark.createDataFrame(labels, "doc_id bigint, toxic int"), "doc_id", "text", "toxic", F.lit(True))
    assert len(seen["tags"]) == 200 and np.allclose(seen["weights"], 1.0)


def test_odd_rows(spark, frame):
    docs, labels = corpus(300)
    df = frame([*ODD, *((100 + k, t) for k, t in docs)])
    tags = spark.createDataFrame(
        [*((100 + k, t) for k, t in labels), (None, 1), (100, None), (101, 7), (102, 1), (102, 0), (1, 0), (7, 1)], "doc_id bigint, toxic int"
    )
    model = toxicity.train(df, tags, "doc_id", "text", "toxic", F.lit(True))
    rows = toxicity.score(df, "text", model).collect()
    assert len(rows) == len(ODD) + 300
    assert all(0 <= r.toxicity.score <= 1 and r.words == "x" for r in rows)
    assert all(r.toxicity.score == 0 and r.toxicity.spans == [] for r in rows if not (r.text or "").strip())
    equal = {r.toxicity.score for r in rows if r.text == "tie tie tie tie"}
    assert len(equal) == 1


def test_nothing_to_learn_from(spark, frame):
    df = frame(ODD)
    for labels in ([], [(1, 0), (2, 0)], [(1, 1)]):
        tags = spark.createDataFrame(labels, "doc_id bigint, toxic int")
        model = toxicity.train(df, tags, "doc_id", "text", "toxic", F.lit(True))
        assert all(r.toxicity.score < 0.01 for r in toxicity.score(df, "text", model).collect())
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert toxicity.score(empty, "text", toxicity.NO_MODEL).collect() == []


def test_query(spark):
    rows = toxicity.op9(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
