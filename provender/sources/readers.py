"""Reading purchase tables. Every column is a string; rows keep their order in ``row_id``."""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provender import schema as S
from provender.errors import DataError
from provender.functions.partitions import spread
from provender.sources import quoted_csv

logger = logging.getLogger("provender")

SMOKE_TEST_ROWS = 1000
NORMALIZED_PRODUCT_TYPE = "Normalized Product Type"
FORMATS = {".csv": "csv", ".parquet": "parquet"}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(hadoop_path))


def format_of(path: str) -> str:
    """The reader for a path, by its suffix. A path without one is a Parquet directory."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = "." + name.rsplit(".", 1)[1].lower() if "." in name else ".parquet"
    if suffix not in FORMATS:
        raise DataError(f"unsupported file format {suffix!r} of {path}; use CSV or Parquet")
    return FORMATS[suffix]


def file_paths(directory: str, names: str | Iterable[str]) -> list[str]:
    """Paths of one file name or several in a directory."""
    names = [names] if isinstance(names, str) else list(names)
    return [f"{str(directory).rstrip('/')}/{name}" for name in names]


def missing_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Null wherever the text stands for a missing value (``NA``, ``null``, empty, ...)."""
    columns = list(df.columns if columns is None else columns)
    return df.withColumns(
        {
            c: F.when(~F.col(S.quoted(c)).isin(S.MISSING_TEXT), F.col(S.quoted(c)))
            for c in columns
        }
    )


def place_in_files() -> Column:
    """The place of a scanned row: file path, start of the block in the file, row in the block.

    Structs compare field by field, so places are in the order of the files whatever partitions
    Spark packs them into. The last field grows within a block, as one task reads it from its start.
    Only a scan itself knows it, so it has to be selected right above one.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_parquet(spark: SparkSession, path: str, ordinal: str | None = None) -> DataFrame:
    """Parquet files, with the rows' numbers from 0, files in order of their paths.

    Parquet knows a row's place in its file; what comes before a file is a sum over a table of files,
    a list that the driver holds in any case.
    """
    df = spark.read.parquet(path)
    if ordinal is None:
        return df
    files = df.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("_file", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    placed = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at"))
    return placed.join(F.broadcast(before), F.col("_path") == F.col("_file")).select(
        *[F.col(S.quoted(c)) for c in df.columns], (F.col("_before") + F.col("_at")).alias(ordinal)
    )


def prefer_normalized_product_type(df: DataFrame) -> DataFrame:
    """``Normalized Product Type``, where there is one, replaces ``Product Type``."""
    if NORMALIZED_PRODUCT_TYPE not in df.columns:
        return df
    value: Column = F.col(S.quoted(NORMALIZED_PRODUCT_TYPE))
    if S.PRODUCT_TYPE in df.columns:
        value = F.coalesce(value, F.col(S.quoted(S.PRODUCT_TYPE)))
    return df.withColumn(S.PRODUCT_TYPE, value)


def read_table(
    spark: SparkSession, path: str, *, numbered: bool = False, line_breaks: bool = True
) -> DataFrame:
    """A CSV or Parquet table, every column a string, missing text as null.

    ``numbered`` adds ``row_id``, the row's place in the files. ``line_breaks`` says that CSV fields
    may hold line breaks; then files are read in blocks with a pass that finds the records in them.
    Without them Spark's reader can split files at any line.
    """
    if not path_exists(spark, path):
        raise DataError(f"could not find input file {path}")
    ordinal = S.ROW_ID if numbered else None
    if format_of(path) == "parquet":
        df = read_parquet(spark, path, ordinal)
    elif line_breaks:
        df = quoted_csv.read(spark, path, ordinal)
    else:
        options = {**quoted_csv.OPTIONS, "multiLine": False}
        df = spark.read.options(header=True, inferSchema=False, **options).csv(path)
        if numbered:
            df = df.select("*", place_in_files().alias(S.ROW_ID))
    names = [c for c in df.columns if c != ordinal]
    strings = df.select(
        *[
            F.col(S.quoted(c))
            if isinstance(df.schema[c].dataType, T.StringType)
            else F.col(S.quoted(c)).cast("string").alias(c)
            for c in names
        ],
        *([S.ROW_ID] if numbered else []),
    )
    return spread(missing_to_null(strings, names))


def read_purchases(
    spark: SparkSession,
    raw_data: str,
    input_file: str,
    *,
    smoke_test: bool = False,
    line_breaks: bool = True,
) -> DataFrame:
    """The raw purchase table of a job, numbered, with the product type override applied."""
    path = file_paths(raw_data, input_file)[0]
    df = read_table(spark, path, numbered=True, line_breaks=line_breaks)
    df = prefer_normalized_product_type(df)
    return spread(first_rows(df, SMOKE_TEST_ROWS)) if smoke_test else df


def first_rows(df: DataFrame, n: int, order: Iterable[str] = (S.ROW_ID,)) -> DataFrame:
    """The first ``n`` rows in the given order (a top-k, not a sort)."""
    return df.orderBy(*[F.col(S.quoted(c)) for c in order]).limit(n)


def training_rows(
    df: DataFrame, text_column: str = S.PRODUCT_TYPE, labels: Iterable[str] = S.LABELS
) -> DataFrame:
    """Rows with a text and all three categories; nulls among the labels become ``None``."""
    labels = list(labels)
    kept = df.dropna(subset=[text_column, *S.CATEGORY_LABELS])
    extra = [c for c in (S.ROW_ID, "file_no") if c in df.columns]
    return kept.select(
        *extra,
        F.col(S.quoted(text_column)).cast("string").alias(text_column),
        *[
            F.coalesce(F.col(S.quoted(c)).cast("string"), F.lit(S.NO_LABEL)).alias(c)
            for c in labels
            if c != text_column
        ],
    )


def dropped_counts(df: DataFrame, text_column: str = S.PRODUCT_TYPE) -> DataFrame:
    """How many rows each null check of :func:`training_rows` drops, in one pass.

    A row counts at the first of the checked columns that is null.
    """
    checks = [text_column, *S.CATEGORY_LABELS]
    reason = F.lit(None).cast("string")
    for c in reversed(checks):
        reason = F.when(F.col(S.quoted(c)).isNull(), F.lit(c)).otherwise(reason)
    counts = df.select(
        *[F.coalesce((reason == c).cast("long"), F.lit(0)).alias(c) for c in checks]
    ).agg(*[F.coalesce(F.sum(S.quoted(c)), F.lit(0)).alias(c) for c in checks])
    return counts.unpivot([], checks, "column", "dropped")


def read_training(
    spark: SparkSession,
    paths: Iterable[str],
    text_column: str = S.PRODUCT_TYPE,
    labels: Iterable[str] = S.LABELS,
    *,
    smoke_test: bool = False,
    log_dropped: bool = False,
    line_breaks: bool = True,
) -> DataFrame:
    """Cleaned files, one after the other, ready for the training preparation."""
    labels = list(labels)
    parts = []
    for number, path in enumerate(paths):
        df = read_table(spark, path, numbered=True, line_breaks=line_breaks)
        df = df.withColumn("file_no", F.lit(number))
        if smoke_test:
            df = first_rows(df, SMOKE_TEST_ROWS)
        if log_dropped:
            for row in dropped_counts(df, text_column).collect():
                logger.info("%s: excluded %d rows, null in %s", path, row.dropped, row.column)
        parts.append(training_rows(df, text_column, labels))
    if not parts:
        raise DataError("no training files given")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
