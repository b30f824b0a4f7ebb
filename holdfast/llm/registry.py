"""Names and SQL of the queries of this subpackage."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import holdfast

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ARCHIVE = "holdfast-tasks.zip"

#: Bytes of an Arrow batch, at most, but for a row that alone has more; and Spark's own choice, in its spelling.
BATCH_SETTING, BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20, "67108864"


def ship(spark: SparkSession) -> None:
    """Prepare the session for Arrow tasks: the package goes to its Python workers, once, and batches become small.

    A batch of texts is held by the JVM and by Python at the same time, for each task of an executor. A size that the
    session was given is left alone.
    """
    if spark.conf.get(BATCH_SETTING).rstrip("bB") == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    context = spark.sparkContext
    if any(file.endswith(ARCHIVE) for file in context.listFiles):
        return
    root = os.path.dirname(os.path.abspath(holdfast.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="holdfast-"), ARCHIVE)
    with zipfile.ZipFile(archive, "w") as package:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    package.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where there is one, its SQL."""

    def register(function: Query) -> Query:
        @functools.wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
