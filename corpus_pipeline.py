"""The corpus pipeline: quality rules, toxicity, near duplicates, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import secrets
from holdfast.llm.bpe import vocabulary_path
from holdfast.llm.jaccard import Measure, components
from holdfast.llm.packing import pack_documents
from holdfast.llm.quality import filter_quality
from holdfast.llm.registry import ship
from holdfast.llm.scratch import Scratch, free_name, stored, with_row_key
from holdfast.llm.toxicity import THRESHOLD, held_out, score, train

#: Near duplicates share at least this percentage of their sets of five-word n-grams.
NEAR = Measure(words=5, percent=80)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a quality rule rejects.

    Null and empty texts have no words and are rejected; equal rows are judged alike, and an empty table stays empty.
    Other columns are kept as they are.
    """
    return filter_quality(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a model of their labels scores at the threshold or above.

    Null and empty texts hold no sentence and stay; a document at the threshold itself goes. Rows with a null ``doc_id`` have no
    label and are scored like any other. Equal texts get equal scores. An empty table, or one without labels, loses nothing.
    """
    ship(spark)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "text", "toxic", ~held_out("doc_id"))
    out = free_name(docs, "toxicity")
    return score(docs, "text", model, out).where(F.col(f"{out}.score") < THRESHOLD).select(docs.columns)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of near duplicates the document with the least id, the first row among equal ids.

    Null ids come last. Documents without a word are no duplicates of one another.
    """
    ship(spark)
    scratch = Scratch(spark)
    keyed, key = with_row_key(docs, scratch)
    found = components(keyed, "text", [key, "doc_id"], NEAR)
    place = F.struct(F.isnull("doc_id"), "doc_id", key)
    first = stored(found.groupBy("component").agg(F.min(place).alias("first")), "first")
    surplus = stored(found.join(first, "component").where(F.col("first")[key] != F.col(key)).select(key), "surplus")
    return keyed.join(surplus, key, "left_anti").select(docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of every reported secret; ``n_chars``, if there is one, follows the text.

    Only documents in which some pattern matches go through the scan. Null and empty texts stay as they are, equal rows are
    treated alike, and spans that touch or overlap become one mark.
    """
    row, parts, spans = (free_name(docs, name) for name in ("__row", "__parts", "__spans"))
    hit = secrets.has_part(F.col("text"))
    marked = stored(secrets.find_parts(docs.where(hit).withColumn(row, F.monotonically_increasing_id()), "text", parts), "marked")
    listed = secrets.spans_by_row(marked, row, parts, spans)
    redacted = secrets.redact(F.col("text"), F.col(spans))
    clean = marked.join(listed, row, "left").withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(redacted))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return docs.where(~hit).union(clean.select(docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents.

    Null and empty texts are their end token alone. Each of several equal rows is packed; pieces of equal length take their
    places in any order. No document, no piece.
    """
    ship(spark)
    return pack_documents(docs, "doc_id", "text", vocabulary_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", duplicate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: The model of the toxicity stage has no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each reads what its predecessor wrote to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
