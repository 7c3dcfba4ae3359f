"""Writing result tables as directories of CSV or Parquet files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provender import schema as S
from provender.errors import DataError
from provender.functions.expressions import list_text
from provender.operators.decode import no_label_to_null

# Output names.
CLEAN_PREFIX = "clean_"
MISC_FILE = "misc.csv"
SCORING_FILE = "scoring.csv"
DIFF_FILE = "normalized_name_diff.csv"
COUNTS_FILE = "value_counts"
CLASSIFIED_SUFFIX = "_classified"


def _stem(name: str) -> str:
    base = name.rstrip("/").rsplit("/", 1)[-1]
    return base.rsplit(".", 1)[0] if "." in base else base


def output_path(
    folder: str,
    output_file: str | None = None,
    input_file: str | None = None,
    extension: str = ".csv",
) -> str:
    """Where a table goes: ``clean_`` + input name unless a name is given, spaces as ``_``."""
    if not output_file and not input_file:
        raise DataError(f"cannot name the output in {folder}: give output_file or input_file")
    name = output_file or CLEAN_PREFIX + input_file.rstrip("/").rsplit("/", 1)[-1]
    if not name.lower().endswith(extension):
        name = _stem(name) + extension
    return f"{folder.rstrip('/')}/{name}".replace(" ", "_")


def write_table(df: DataFrame, path: str, *, write: bool = True, mode: str = "overwrite") -> str:
    """Write by the suffix of the path; list columns become list text in CSV."""
    if not write:
        return path
    if path.lower().endswith(".csv"):
        flat = df.select(
            *[
                list_text(F.col(S.quoted(f.name))).alias(f.name)
                if isinstance(f.dataType, T.ArrayType)
                else F.col(S.quoted(f.name))
                for f in df.schema.fields
            ]
        )
        flat.write.mode(mode).options(**CSV_OPTIONS).csv(path)
    else:
        df.write.mode(mode).parquet(path)
    return path


def write_counts(counts: DataFrame, folder: str, *, write: bool = True) -> str:
    """Value counts, one directory per column; ``/`` in a column name becomes ``_``."""
    path = f"{folder.rstrip('/')}/{COUNTS_FILE}"
    if write:
        (
            counts.withColumn("column", F.replace(F.col("column"), F.lit("/"), F.lit("_")))
            .select("column", "value", F.col("count").alias("Count"))
            .write.mode("overwrite")
            .partitionBy("column")
            .options(**CSV_OPTIONS)
            .csv(path)
        )
    return path


#: Text as it is: quotes doubled, white space at the ends kept, empty text as nothing.
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
# Folders that readers do not see while the outputs of a run are on their way.
STAGING, READY = "_staging-", "_ready-"


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())


def finish_commits(spark: SparkSession, folder: str) -> None:
    """Move what earlier runs had decided to put in ``folder`` but not all moved."""
    path, files = _file_system(spark, folder)
    if not files.exists(path(folder)):
        return
    for ready in files.listStatus(path(folder)):
        if not ready.getPath().getName().startswith(READY):
            continue
        for entry in files.listStatus(ready.getPath()):
            place = path(folder, entry.getPath().getName())
            files.delete(place, True)
            if not files.rename(entry.getPath(), place):
                raise DataError(f"could not move {entry.getPath()} to {place}")
        files.delete(ready.getPath(), True)


@contextmanager
def together(spark: SparkSession, folder: str) -> Iterator[str]:
    """A folder to write the outputs of a run to, which appear in ``folder`` together.

    Until all are written nothing in ``folder`` changes, whatever fails. One rename then decides for the
    new outputs, and each replaces the old one of its name; a run that is stopped in between is
    finished by the next. Other files in ``folder`` stay. It takes a file system whose renames are whole.
    """
    finish_commits(spark, folder)
    path, files = _file_system(spark, folder)
    name = uuid.uuid4()
    staging = f"{folder.rstrip('/')}/{STAGING}{name}"
    files.mkdirs(path(staging))
    try:
        yield staging
    except BaseException:
        files.delete(path(staging), True)
        raise
    if not files.rename(path(staging), path(folder, f"{READY}{name}")):
        raise DataError(f"could not rename {staging}")
    finish_commits(spark, folder)


def write_classified(df: DataFrame, input_path: str, folder: str, *, write: bool = True) -> str:
    """Predictions as ``<stem>_classified``, "no value" labels as null."""
    path = f"{folder.rstrip('/')}/{_stem(input_path)}{CLASSIFIED_SUFFIX}.csv"
    return write_table(no_label_to_null(df), path, write=write)
