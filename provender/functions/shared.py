"""The folder that all executors share, and what is kept there between jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one set, else ``spark.checkpoint.dir``. Only where the master is a
    single process, as in tests, a temporary folder is taken if neither is."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


def kept(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read from there from now on."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def let_go(spark: SparkSession) -> None:
    """Have the driver look now for shuffles that nobody refers to any more, whose files Spark then removes.
    By itself it looks when its own memory is short, which says nothing of the disks."""
    spark.sparkContext._jvm.System.gc()


@contextmanager
def in_columns(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """The rows of ``df`` for several readers, compressed by columns in the shared folder until the block ends.

    Repeating values take next to no room there, and no memory is taken from the sorts that read them; cached rows go to
    disk, when memory is short, at several times the size. What ``df`` was made from is let go."""
    spark = df.sparkSession
    path = new_path(spark, name)
    try:
        df.write.option("compression", "zstd").parquet(path)
        let_go(spark)
        yield spark.read.parquet(path)
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
