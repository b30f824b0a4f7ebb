import random

import pytest
from test_jaccard import groups
from test_quality import brute

import corpus_pipeline
from holdfast.llm import bpe, secrets
from holdfast.llm.jaccard import Measure
from holdfast.llm.scratch import stored

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, count):
    return " ".join(f"word{rng.randrange(900)}" for _ in range(count))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    texts = [words(rng, rng.randrange(40, 160)) for _ in range(150)]
    texts += [f"{t} you absolute moron. {words(rng, 60)}" for t in (words(rng, 60) for _ in range(60))]
    texts += [texts[i] for i in range(20)] + [texts[i].replace("word1", "word2", 1) for i in range(30)]
    texts += [f"{words(rng, 60)} password=hunter2{i} {words(rng, 5)}" for i in range(20)]
    texts += [None, "", "short", "# $ % " * 80, words(rng, 70) * 3]
    docs = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None), (5, texts[5], "en", "src0", 1)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, COLUMNS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0, int("moron" in (t or ""))) for i, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_each_stage(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = docs.columns
    before = rows_of(docs)

    kept = stored(corpus_pipeline.quality_stage(spark, docs, tables), "test")
    assert kept.columns == names
    assert rows_of(kept) == [r for r in before if brute(r[1])[-1]]

    calm = stored(corpus_pipeline.toxicity_stage(spark, kept, tables), "test")
    assert calm.columns == names
    left = rows_of(calm)
    clean = [r for r in rows_of(kept) if "moron" not in r[1]]
    assert sum(r in left for r in clean) >= 0.98 * len(clean)
    assert sum("moron" in r[1] for r in left) <= 3

    single = stored(corpus_pipeline.duplicate_stage(spark, calm, tables), "test")
    assert single.columns == names
    root, _ = groups([r[1] for r in left], Measure(5, 80))
    survivors = {}
    for row, group in zip(left, root, strict=True):
        best = survivors.get(group)
        if best is None or (row[0] is None, row[0] or 0) < (best[0] is None, best[0] or 0):
            survivors[group] = row
    assert sorted(str(r[0]) for r in rows_of(single)) == sorted(str(r[0]) for r in survivors.values())

    hidden = stored(corpus_pipeline.secret_stage(spark, single, tables), "test")
    assert hidden.columns == names and hidden.dtypes == docs.dtypes
    for row, old in zip(sorted(rows_of(hidden), key=lambda r: str(r[0])), sorted(rows_of(single), key=lambda r: str(r[0])), strict=True):
        assert "hunter2" not in row[1]
        assert row == old if "hunter2" not in old[1] else "[SECRET]" in row[1] and row[4] == len(row[1])

    packed = corpus_pipeline.packing_stage(spark, hidden, tables).collect()
    library = bpe.load(bpe.vocabulary_path()).library
    assert sum(r.length for r in packed) == sum(len(library.encode(r[1], add_special_tokens=False).ids) + 1 for r in rows_of(hidden))


def test_run(spark, tables):
    packed = corpus_pipeline.run(spark, tables)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packed.count() > 100


def test_stages_on_no_rows(spark, tables):
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, tables), f"test-{name}")
        assert docs.count() == 0


def test_weak_matches_alone_change_nothing(spark):
    text = "see http://example.com/page for more"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    rows = corpus_pipeline.secret_stage(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(1, text), (2, None)]
    assert secrets.REACH > 0
