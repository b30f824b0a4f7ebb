import random
import re

import numpy as np
import pytest
from llm_cases import ODD

from pyspark.sql import functions as F

from holdfast.llm import jaccard
from holdfast.llm.graph import connected
from holdfast.llm.jaccard import Measure
from holdfast.llm.scratch import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ngrams(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def groups(texts, measure):
    """Brute force: for each text the numbers of the texts in its component."""
    sets = [ngrams(t, measure.words) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= measure.percent * (len(a) + len(sets[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def check(spark, texts, measure):
    df = spark.createDataFrame(list(enumerate(texts)), "place bigint, text string").repartition(3)
    rows = sorted(jaccard.components(df, "text", ["place"], measure).collect(), key=lambda r: r.place)
    want, sizes = groups(texts, measure)
    assert [r.n_ngrams for r in rows] == sizes
    first = {}
    for r in rows:
        first.setdefault(r.component, r.place)
    assert [first[r.component] for r in rows] == want
    return len(set(want))


@pytest.mark.parametrize("measure", [Measure(), Measure(5, 80), Measure(2, 50)])
def test_equals_brute_force(spark, measure):
    rng = random.Random(measure.words)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(words[:30])
    texts = [t for _, t in ODD]
    for size in (6, 20, 60, 140):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(size)] = rng.choice(words)
            texts.append(" ".join(own))
            texts.append(" ".join([*own[: rng.randrange(size)], line]))
    texts += [texts[-1]] * 5 + ["a", "A", "a b", "b a"]
    assert 1 < check(spark, texts, measure) < len(texts)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(300):
        own = list(base)
        for k in range(rng.randrange(0, 5)):
            own[rng.randrange(120)] = f"own{i}x{k}"
        texts.append(" ".join(own))
    check(spark, texts, Measure())


def test_bounds_hold_for_every_pair():
    measure = Measure()
    rng = np.random.default_rng(2)
    for _ in range(400):
        pool = rng.choice(10**6, 90, replace=False).astype(np.uint64)
        a = np.sort(pool[: rng.integers(1, 80)])
        b = np.sort(rng.permutation(np.concatenate([a, pool[80:]]))[: max(1, len(a) + rng.integers(-6, 6))])
        if measure.links(a, b):
            one, two = a[: measure.prefix(len(a))], b[: measure.prefix(len(b))]
            both, overlap = len(np.intersect1d(one, two)), measure.overlap(len(a), len(b))
            assert both >= min(measure.shared(len(a)), measure.shared(len(b)))
            assert both >= overlap - max(len(a) - len(one), len(b) - len(two))
            first = np.intersect1d(a, b)[0]
            assert np.searchsorted(a, first) <= len(a) - overlap and np.searchsorted(b, first) <= len(b) - overlap


def test_components_of_links(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    scratch = Scratch(spark)
    found = {r.node: r.component for r in connected(spark.createDataFrame(links, "a bigint, b bigint"), scratch).collect()}
    want = {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert found == want
    scratch.clear()
    assert connected(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark)).collect() == []


def test_query(spark, tmp_path):
    spark.createDataFrame(ODD, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(map(tuple, jaccard.op6(spark, str(tmp_path)).collect()), key=str)
    root, sizes = groups([t for _, t in ODD], Measure())
    keys = [k for k, _ in ODD]
    least = {r: min((k for k, x in zip(keys, root, strict=True) if x == r and k is not None), default=None) for r in root}
    assert rows == sorted(zip(keys, sizes, (least[r] for r in root), strict=True), key=str)


def test_no_rows(spark):
    assert jaccard.components(spark.createDataFrame([], "place bigint, text string"), "text", ["place"]).collect() == []


def test_rows_of_a_common_ngram_are_dealt_over_parts(spark):
    import numpy as np

    from holdfast.llm.scratch import Scratch

    # One n-gram in a third of all sets, and one of each set's own.
    sets = [(i, 2, np.array([7, 1000 + i] if i % 3 == 0 else [1000 + i, 5000 + i // 2], np.uint64).tobytes()) for i in range(960)]
    nodes = spark.createDataFrame(sets, "node long, n long, prefix binary").coalesce(1)
    rows = jaccard._incidence(nodes, np.array([3, 7], np.uint64))
    counted = {(r.ngram == 7, r.part): r["count"] for r in rows.groupBy(F.expr("ngram = 7").alias("h"), "part", F.expr("if(ngram = 7, 7, 0)").alias("ngram")).count().collect()}
    assert sum(n for (hot, _), n in counted.items() if hot) == 320 and counted[False, 0] == 1600
    # Each part holds its share.
    assert max(n for (hot, _), n in counted.items() if hot) <= 20 and len(counted) == jaccard.PARTS + 1
    scratch = Scratch(spark)
    low = jaccard._per_ngram(rows, scratch, low=F.min("node"), members=F.count(F.lit(1))).where("ngram = 7").collect()
    scratch.clear()
    assert len(low) == 320 and {(r.low, r.members) for r in low} == {(0, 320)}
