import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import ODD

from holdfast.llm import lm, lm_words


def words_of(text):
    return (text or "").encode().lower().split() + [b""]


def base(docs, training):
    count = Counter()
    for key, text in docs:
        if training(key):
            count.update(words_of(text))
    total, distinct = sum(count.values()), len(count)
    rows = []
    for key, text in docs:
        words = words_of(text)
        value = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        rows.append((key, len(words), sum(count[w] > 0 for w in words), round(value, 6)))
    return rows, total


def is_training(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 10 != 0


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 3])
def test_base_score(spark, tmp_path, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    docs = [*ODD, *[(20 + i, f"the cat {i} sat on the mat {i % 3} " * 3) for i in range(40)]]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = lm.op4(spark, str(tmp_path)).collect()
    want, total = base(docs, is_training)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows), key=str) == sorted(want, key=str)
    assert {r.train_tokens for r in rows} == {total}
    assert all(r.held_out == (not is_training(r.doc_id)) for r in rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)


def test_probabilities_are_normalised():
    mass = np.random.default_rng(1).random(lm.CLASSES) + 1e-6
    table = lm.Parameters.start(mass).log_probabilities()
    assert table.shape == (lm.SYMBOLS**2, lm.CLASSES)
    assert np.allclose((10.0 ** table.astype(np.float64)).sum(axis=1), 1.0, atol=1e-4)


def test_class_masses_sum_to_one(spark):
    df = spark.createDataFrame([(f"w{i % 400} " * (i % 7 + 1),) for i in range(900)], "text string")
    known = lm.vocabulary(lm.word_counts(df, "text"))
    unseen = (lm.TAILS - 1) * lm.SMOOTHING / (known.tokens + lm.SMOOTHING * (known.distinct + 1))
    assert abs(known.mass.sum() - 1.0 - unseen) < 1e-9


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(4)
    noise = rng.random(lm.CLASSES) + 0.1
    noise /= noise.sum()
    p = lm.Parameters.start(noise, 3)
    contexts, counts = np.array([5, 700, 65000]), rng.random((3, lm.CLASSES))

    def loss(p):
        margin = p.scores(contexts) - np.log(lm.NOISE * noise)
        rows = counts.sum(axis=1, keepdims=True)
        return (counts * np.logaddexp(0, -margin) + lm.NOISE * rows * noise * np.logaddexp(0, margin)).sum() / counts.sum()

    for array, gradient in zip(p.arrays(), lm.nce_gradient(p, contexts, counts, noise), strict=True):
        place = np.unravel_index(np.argmax(np.abs(gradient)), gradient.shape)
        before = array[place]
        array[place] = before + 1e-5
        up = loss(p)
        array[place] = before - 1e-5
        slope = (up - loss(p)) / 2e-5
        array[place] = before
        assert abs(slope - gradient[place]) < 1e-6 + 1e-4 * abs(slope)


def test_context_helps_on_held_out_texts(spark):
    rng = random.Random(2)
    follows = {"red": "apple", "blue": "sky", "green": "grass"}

    def text():
        return " ".join(f"{c} {follows[c]}" for c in (rng.choice(list(follows)) for _ in range(30)))

    docs = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id bigint, text string")
    rows = lm.language_model_scores(docs, "doc_id", "text", ~lm.held_out("doc_id")).withColumn("held", lm.held_out("doc_id")).where("held").collect()
    assert len(rows) > 5
    assert sum(r.score for r in rows) > 0.75 * sum(r.base_score for r in rows)


def test_words_of_one_ending_are_told_apart(spark):
    rng = random.Random(5)
    pairs = [(f"left{i}", f"a{i}ing") for i in range(300)]

    def text():
        return " ".join(f"{a} {b}" for a, b in (rng.choice(pairs) for _ in range(100)))

    docs = [(i, text()) for i in range(400)]
    swapped = [(1000 + i, " ".join(w for k in range(0, 200, 2) for w in (t.split()[k], t.split()[(k + 41) % 200]))) for i, t in docs[:40]]
    df = spark.createDataFrame([*docs, *swapped], "doc_id bigint, text string").repartition(3)
    rows = lm.language_model_scores(df, "doc_id", "text", lm.F.col("doc_id") < 1000).collect()
    scores = {r.doc_id: (r.score, r.base_score) for r in rows}
    right, wrong = (sum(scores[k + i][0] - scores[k + i][1] for i in range(40)) for k in (0, 1000))
    assert right > wrong + 40 * 20


def test_words_within_a_class_are_normalised():
    rng = np.random.default_rng(3)
    of_word, share = rng.integers(0, 4, 60), rng.random(60)
    mass = np.array([share[of_word == c].sum() + 0.5 for c in range(5)])
    tree = lm.lm_words.build_tree(5, of_word, share, mass)
    vectors = lm.lm_words.Vectors.start(tree, 5)
    vectors.nodes()[:] = rng.normal(0, 1, vectors.nodes().shape)
    for c in range(4):
        own = np.flatnonzero(of_word == c)
        # Each word of the class, and another one, after the same two words.
        word = np.stack([np.full(len(own) + 1, 7), np.full(len(own) + 1, 9), np.append(own, -1)], axis=1).ravel()
        classes = np.where(word >= 0, of_word[word], c)
        found = lm.lm_words.events(tree, word, classes, np.arange(0, len(word) + 1, 3), 5)
        gains = lm.lm_words.log_gains(tree, vectors, found, len(word))[2::3]
        unigram = np.append(share[own], mass[c] - share[own].sum()) / mass[c]
        assert abs((unigram * 10.0**gains).sum() - 1.0) < 1e-5 and np.abs(gains).max() > 0.01


def test_vectors_grow_with_the_corpus():
    assert lm.lm_words.floor_of(10) == lm.lm_words.LEAST
    assert [lm.lm_words.floor_of(n) / n for n in (10**6, 10**8, 10**10)] == sorted((1e-4, 464 / 10**8, 2154 / 10**10), reverse=True)


def test_no_training_rows(spark, frame):
    rows = lm.language_model_scores(frame([(1, "a b"), (2, None)]), "doc_id", "text", lm.F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score, r.train_tokens) for r in rows) == [(1, 3, 0, 0.0, 0.0, 0), (2, 1, 0, 0.0, 0.0, 0)]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm.language_model_scores(empty, "doc_id", "text", ~lm.held_out("doc_id")).collect() == []


def test_gradient_of_words_is_that_of_their_loss():
    random = np.random.default_rng(5)
    tree = lm_words.build_tree(2, np.array([0, 0, 1, 1, 1]), np.full(5, 0.1), np.array([0.4, 0.6]))
    vectors = lm_words.Vectors.start(tree, 2)
    vectors = lm_words.Vectors(random.normal(0, 0.5, vectors.rows.shape), vectors.symbols)
    n = lm_words.PIECE + 7
    family = random.integers(0, 2, n)
    node = tree.first[family] + random.integers(0, 2, n)
    found = lm_words.Events(np.arange(n), random.integers(0, 8, n), random.integers(0, 8, n), family, node)
    drawn = tree.first[family][:, None] + random.integers(0, 2, (n, 4))

    def loss(rows):
        context = rows[found.far] + rows[vectors.symbols + found.near]
        margin = np.einsum("ekd,ed->ek", rows[2 * vectors.symbols + np.concatenate([node[:, None], drawn], axis=1)], context) - np.log(4)
        return np.log1p(np.exp(-margin[:, 0])).sum() + np.log1p(np.exp(margin[:, 1:])).sum()

    rows, parts = lm_words.nce_gradient(tree, vectors, found, np.arange(n), drawn)
    gradient = np.zeros_like(vectors.rows)
    np.add.at(gradient, rows, parts)
    for at in [(0, 0), (3, 2), (vectors.symbols + 4, 1), (2 * vectors.symbols, 5), (2 * vectors.symbols + 4, 3)]:
        moved = vectors.rows.copy()
        moved[at] += 1e-4
        back = vectors.rows.copy()
        back[at] -= 1e-4
        assert abs((loss(moved) - loss(back)) / 2e-4 - gradient[at]) < 1e-2
    learner = lm_words.Learner(tree, vectors, 1)
    values, number = learner.distinct(rows)
    assert sorted(values) == sorted(set(rows.tolist())) and (values[number] == rows).all()


@pytest.mark.parametrize("size", [0, 1, 2, 3, 1000])
def test_hashes_are_found_by_their_first_bits(size):
    random = np.random.default_rng(size)
    hashes = np.sort(random.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
    if size == 1000:
        hashes = np.sort(np.concatenate([hashes, np.arange(50, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(50, dtype=np.uint64)]))
    known = lm.Vocabulary(0, 0, hashes, None, None, 0, None, None, None, lm.bucket_starts(hashes))
    asked = np.concatenate([hashes, random.integers(0, 1 << 63, 500, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
    place = {h: i for i, h in enumerate(hashes.tolist())}
    assert known.look_up(asked).tolist() == [place.get(h, -1) for h in asked.tolist()]


def test_words_are_spelled_without_an_object_each(monkeypatch):
    import pyarrow as pa

    from holdfast.llm.words import SOLID, Words, find_words, texts_of

    words = find_words(texts_of(pa.array(["one é  two", None, "", "ÜÄ three 日本"], pa.string())), SOLID)
    each = [words.word(i).decode() for i in range(len(words))]
    monkeypatch.setattr(Words, "word", None)
    for chosen in (np.arange(len(words)), np.array([4, 0, 0, 2]), np.zeros(0, np.int64)):
        column = words.spelled(chosen)
        column.validate(full=True)
        assert column.to_pylist() == [each[i] for i in chosen]


def test_word_counts_equal_splitting_each_text(spark):
    texts = ["A b a", None, "", "É b\tc"]
    rows = lm.word_counts(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), "text").collect()
    assert {r["word"]: r["c"] for r in rows} == {"a": 2, "b": 2, "É": 1, "c": 1, "": 4}


def random_events(random, tree, vectors, n):
    family = random.integers(0, len(tree.first) - 1, n)
    width = np.diff(tree.first)[family]
    node = tree.first[family] + random.integers(0, width)
    drawn = tree.first[family][:, None] + random.integers(0, width[:, None], (n, 4))
    symbols = random.integers(0, vectors.symbols, (2, n))
    return lm_words.Events(np.arange(n), *symbols, family, node), drawn


@pytest.mark.parametrize("shared, wide", [(1, 10**9), (40, 10**9), (40, 3), (10**9, 64)])
def test_families_of_many_events_have_one_gradient_a_node(monkeypatch, shared, wide):
    random = np.random.default_rng(8)
    tree = lm_words.build_tree(3, random.integers(0, 3, 40), random.random(40), np.full(3, 30.0))
    vectors = lm_words.Vectors.start(tree, 3)
    vectors.rows[:] = random.normal(0, 0.5, vectors.rows.shape)
    n = lm_words.PIECE + 900
    found, drawn = random_events(random, tree, vectors, n)
    monkeypatch.setattr(lm_words, "SHARED", shared)
    monkeypatch.setattr(lm_words, "WIDE", wide)
    rows, parts = lm_words.nce_gradient(tree, vectors, found, np.arange(n), drawn)
    got = np.zeros(vectors.rows.shape)
    np.add.at(got, rows, parts)
    # Event by event, in plain Python.
    want = np.zeros(vectors.rows.shape)
    for e in range(n):
        far, near = found.far[e], vectors.symbols + found.near[e]
        context = vectors.rows[far] + vectors.rows[near]
        for k, node in enumerate([found.node[e], *drawn[e]]):
            own = 2 * vectors.symbols + node
            slope = 1 / (1 + math.exp(math.log(4) - vectors.rows[own] @ context)) - (k == 0)
            want[own] += slope * context
            want[[far, near]] += slope * vectors.rows[own]
    assert np.allclose(got, want, atol=1e-3)
    if (shared, wide) == (1, 10**9):
        assert len(rows) == 2 * n + len(tree.mass)


def test_learner_counts_every_meeting():
    random = np.random.default_rng(9)
    tree = lm_words.build_tree(3, random.integers(0, 3, 40), random.random(40), np.full(3, 30.0))
    vectors = lm_words.Vectors.start(tree, 3)
    found, _ = random_events(random, tree, vectors, lm_words.BATCH + 100)
    learner = lm_words.Learner(tree, vectors, 1)
    drawn, draw = [], learner.draw
    learner.draw = lambda family: drawn.append(draw(family)) or drawn[-1]
    learner.learn(found)
    rows = [found.far, vectors.symbols + found.near, *(2 * vectors.symbols + x.ravel() for x in (found.node, *drawn))]
    assert learner.met.tolist() == np.bincount(np.concatenate(rows), minlength=len(vectors.rows)).tolist()


def test_draws_are_places_along_the_masses():
    random = np.random.default_rng(10)
    share = random.random(3000) ** 30
    tree = lm_words.build_tree(2, random.integers(0, 2, 3000), share, np.array([share.sum(), 1e-9]))
    learner = lm_words.Learner(tree, lm_words.Vectors.start(tree, 2), 1)
    ends = learner.ends
    spread = np.concatenate([random.random(5000) * ends[-1], ends, np.nextafter(ends, -1)[1:], np.nextafter(ends, 9)])
    assert (learner.place(spread) == np.searchsorted(ends, spread, side="right") - 1).all()


@pytest.mark.parametrize("held", [lm.HELD_BYTES, 2000, 0])
def test_counts_of_a_task_are_added_up(monkeypatch, held):
    import pyarrow as pa

    random = np.random.default_rng(11)
    monkeypatch.setattr(lm, "HELD_BYTES", held)
    want, batches = Counter(), []
    for size in (0, 50, 1, 300, 50, 50):
        keys, n = random.integers(-(2**63), -(2**63) + 60, size), random.integers(1, 9, size)
        for k, c in zip(keys.tolist(), n.tolist(), strict=True):
            want[k] += c
        batches.append(pa.RecordBatch.from_arrays([pa.array([f"w{k}" for k in keys], pa.string()), pa.array(keys), pa.array(n)], names=["word", "hash", "n"]))
    got, rows = Counter(), 0
    for batch in lm.added_up(iter(batches), "hash"):
        rows += batch.num_rows
        for row in batch.to_pylist():
            assert row["word"] == f"w{row['hash']}"
            got[row["hash"]] += row["n"]
    assert got == want and (rows == len(want) if held > 10**6 else rows > len(want))


def test_classes_go_by_the_last_two_bytes():
    import pyarrow as pa

    from holdfast.llm.words import SOLID, Words, find_words, hash_words, texts_of

    texts = ["a", "ab é z", None, "running 日本 \x00 x\x00 q", "zz"]
    words = find_words(texts_of(pa.array(texts, pa.string())), SOLID)
    endings = Words(words.data, np.maximum(words.start, words.end - 2), words.end, words.offsets)
    assert lm._tail_class(words).tolist() == (hash_words(endings) % np.uint64(lm.TAILS)).tolist()
