"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_checkpoints(spark: SparkSession) -> None:
    """Make sure that ``checkpoint()`` has a folder.

    A cluster names a shared one in ``spark.checkpoint.dir``. Only where that is unset and the
    master is a single process, as in tests, a temporary folder is taken.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="checkpoints-")
    context.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared checkpoint folder and read from there."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint()


def let_go(spark: SparkSession) -> None:
    """Have the driver look now which shuffles and checkpoints nobody refers to any more.

    Spark removes their files after that (checkpoints if ``cleanCheckpoints`` is set); by itself
    the driver looks when its own memory is short, which says nothing of the disks."""
    spark.sparkContext._jvm.System.gc()


#: Rows that go to Python at once where texts do.
TEXTS_AT_ONCE = 1000


def long_texts(spark: SparkSession) -> None:
    """Let rows go to Python in batches of ``TEXTS_AT_ONCE`` at most, from now on in this session.

    Spark's own setting is for narrow rows; as many whole texts take hundreds of MB in the JVM, in
    transfer and in each worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > TEXTS_AT_ONCE:
        spark.conf.set(name, str(TEXTS_AT_ONCE))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
