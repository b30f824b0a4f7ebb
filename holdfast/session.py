"""Session helpers: a local session for tests and benches, and the shared folder for intermediate data."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

PREFIX = "holdfast-"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, name: str = "holdfast") -> SparkSession:
    """A local session with the settings the tests and the bench use. Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str | None:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a cluster session without it gets None,
    since a machine-local folder would not outlive the executor that wrote it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        return None
    folder = tempfile.mkdtemp(prefix="holdfast-")
    context.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A new, unused path in the shared folder."""
    root = shared_root(spark)
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root}/{PREFIX}{purpose}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path that ``shared_path`` gave; any other is refused."""
    root = shared_root(spark)
    if root is None or ".." in path or not path.startswith(f"{root}/{PREFIX}"):
        raise ValueError(f"{path} is no intermediate of this library")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@dataclass(frozen=True)
class Stored:
    """A frame and, where it was written, its path."""

    frame: DataFrame
    path: str | None

    def release(self) -> None:
        """Delete the written copy; the frame cannot be read afterwards."""
        if self.path:
            discard(self.frame.sparkSession, self.path)


def materialise(df: DataFrame, purpose: str) -> Stored:
    """Store a frame that is read many times, as model fitting does, and read it from there.

    It goes to the shared folder as parquet: a lost executor costs a re-read and not a re-join, and each reader
    takes only its columns. A cluster without a shared folder is an error, as computing the frame anew for each reader
    would be dearer than any fit.
    """
    spark = df.sparkSession
    path = shared_path(spark, purpose)
    df.write.parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path), path)
