"""CSV directories as frames."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

if TYPE_CHECKING:
    import pyspark.pandas as ps


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, **options: str) -> DataFrame:
    """Read a file or directory of CSV with a header.

    Without a schema the types are inferred, which reads everything once more and makes a numeric column with a
    single blank a string column.
    """
    reader = spark.read.options(header=True, **options)
    if schema is None:
        return reader.csv(path, inferSchema=True)
    return reader.csv(path, schema=schema)


def read_csv_pandas(path: str, **options) -> ps.DataFrame:
    """The same through the pandas API on Spark; the rows stay distributed."""
    import pyspark.pandas as ps

    return ps.read_csv(path, **options)
