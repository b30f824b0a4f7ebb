"""Intermediate tables in the shared folder, deleted when a result no longer needs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from holdfast.session import discard, shared_path


#: Spark's setting for shuffle files that go with their query.
RECLAIM = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: A row group per row. By default a writer weighs its rows first when it holds a hundred, a page takes as many, and a reader takes
#: up to 4,096 of a row group at a time, whatever their size. The least and greatest value of every row group, whole ones, would stay
#: with the writer until it closes.
WIDE = {"parquet.block.row.count.limit": "1", "parquet.column.statistics.enabled": "false", "parquet.enable.dictionary": "false"}


class Scratch:
    """Tables of one computation. A lost executor costs a read of them, never what came before."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def store(self, df: DataFrame, purpose: str, *by: str, reclaim: bool = False, wide: bool = False) -> DataFrame:
        """Write a frame, in folders by the columns ``by``, and read it back.

        Rows of megabytes are ``wide``: writers and readers hold one at a time. With ``reclaim`` Spark deletes the shuffle files of the job when it is done, not when the driver next collects garbage.
        """
        path = shared_path(self.spark, purpose)
        self.paths.append(path)
        before = self.spark.conf.get(RECLAIM)
        self.spark.conf.set(RECLAIM, str(reclaim or before == "true").lower())
        try:
            df.write.options(**(WIDE if wide else {})).partitionBy(*by).parquet(path)
        finally:
            self.spark.conf.set(RECLAIM, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            discard(self.spark, path)
        self.paths = []


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """A frame that is written and read back, and stays for its readers."""
    return Scratch(df.sparkSession).store(df, purpose)


def most_frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of greatest count, as many levels of counts as hold at most ``most`` rows in all.

    A level is a sixteenth of a doubling, so the driver sees some hundred sums, and no task sorts or gathers the rows.
    """
    level = F.floor(F.log2(F.col(count).cast("double")) * 16)
    least, total = None, 0
    for row in sorted(df.groupBy(level.alias("level")).count().collect(), key=lambda row: -row["level"]):
        total += row["count"]
        if total > most:
            break
        least = row["level"]
    return df.where(level >= least) if least is not None else df.where("false")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if the frame has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(df: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """The frame with a column that names each row, also of equal ones, the same at every read.

    Rows of parquet files are named by file and place; any other frame is stored first.
    """
    key = free_name(df, "row_key")
    place: Column = F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    try:
        return df.select("*", place.alias(key)), key
    except AnalysisException:
        return scratch.store(df, "rows").select("*", place.alias(key)), key
