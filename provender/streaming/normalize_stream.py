"""The batch normalization on a stream of purchase files.

Rows are independent, so the same plan runs on a stream without state; only sorted reports and
counts need the finished table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from provender import schema as S
from provender.operators.clean import clean_rows
from provender.operators.normalize import normalize
from provender.rules.ruleset import RuleSet
from provender.sources.readers import missing_to_null, prefer_normalized_product_type

PURCHASE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in [*S.ID_COLUMNS, *S.GROUP_COLUMNS]]
)


def read_purchase_stream(spark: SparkSession, folder: str, schema=PURCHASE_SCHEMA) -> DataFrame:
    """Purchase rows from the CSV files that arrive in a folder."""
    raw = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(folder)
    )
    return prefer_normalized_product_type(missing_to_null(raw))


def normalize_stream(rows: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Cleaned and normalized rows of a stream."""
    return normalize(clean_rows(rows), rules)
