"""Row cleaning before normalization: fixed schema, category repairs, filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender import schema as S
from provender.functions.expressions import WHITESPACE, is_any, lookup, strip
from provender.operators.normalize import NON_FOOD, combined_name
from provender.rules.fixed_values import HIERARCHY
from provender.rules.ruleset import category_groups

# Misspelled categories, a placeholder category, a placeholder row and a prefix.
CATEGORY_TYPOS = {"Roots & Tuber": "Roots & Tubers"}
UNPROCESSED = "Whole/Minimally Processed"
EXCLUDED_PRODUCT_TYPE = "Other Products + Fees ($4,640.56)"
NAME_PREFIX = "^PREQUALIFIED: "
MIN_TEXT_LENGTH = 3
# A character that ``strip`` does not remove, as a pattern.
PRINTED = "[^" + "".join(f"\\u{ord(c):04x}" for c in WHITESPACE) + "]"


def fill_group(df: DataFrame, hierarchy=HIERARCHY, *, overwrite: bool = False) -> DataFrame:
    """Food Product Group from the category; unknown categories give null.

    The hierarchy has a few dozen entries and is a literal in the plan.
    """
    if S.FPG in df.columns and not overwrite:
        return df
    group = lookup(F.col(S.quoted(S.FPC)), category_groups(hierarchy), "string")
    return df.withColumn(S.FPG, group)


def add_group_and_commodity(df: DataFrame, hierarchy=HIERARCHY) -> DataFrame:
    """The group recomputed for every row, and an empty ``Commodity`` where there is none."""
    df = fill_group(df, hierarchy, overwrite=True)
    if "Commodity" in df.columns:
        return df
    return df.withColumn("Commodity", F.lit(None).cast("string"))


def build_name(df: DataFrame, input_column: str = S.PRODUCT_NAME) -> DataFrame:
    """Rebuild a missing name column from the normalized columns that exist."""
    if input_column in df.columns:
        return df
    return df.withColumn(
        input_column, combined_name([c for c in S.NORMALIZED_COLUMNS if c in df.columns])
    )


def fixed_schema(df: DataFrame) -> DataFrame:
    """The id and group columns, absent ones as null, others dropped; ``row_id`` stays."""
    wanted = [*S.ID_COLUMNS, *S.GROUP_COLUMNS]
    extra = [S.ROW_ID] if S.ROW_ID in df.columns else []
    return df.select(
        *extra,
        *[
            F.col(S.quoted(c)).cast("string").alias(c)
            if c in df.columns
            else F.lit(None).cast("string").alias(c)
            for c in wanted
        ],
    )


def _stripped_length(text: Column, least: int) -> Column:
    """Whether ``text`` without white space at its ends has so many characters at least."""
    if least < 2:
        return text.rlike(PRINTED) if least == 1 else text.isNotNull()
    return text.rlike(f"(?s){PRINTED}.{{{least - 2},}}{PRINTED}")


def clean_rows(
    df: DataFrame,
    input_column: str = S.PRODUCT_NAME,
    min_length: int = MIN_TEXT_LENGTH,
    hierarchy=HIERARCHY,
) -> DataFrame:
    """Filter and repair raw purchase rows. Narrow: one pass, no shuffle."""
    df = fixed_schema(fill_group(build_name(df, input_column), hierarchy))
    product_type, name = F.col(S.quoted(S.PRODUCT_TYPE)), F.col(S.quoted(S.PRODUCT_NAME))
    category, primary = F.col(S.quoted(S.FPC)), F.col(S.quoted(S.PFPC))
    non_food = is_any(category, [NON_FOOD])
    # The filters look through white space at the ends, so that texts are stripped once, after them.
    long_enough = _stripped_length(product_type, min_length) & (F.length(name) >= min_length)
    around = F.split(product_type, re.escape(EXCLUDED_PRODUCT_TYPE), 2)
    placeholder = product_type.contains(EXCLUDED_PRODUCT_TYPE) & ~F.exists(around, lambda x: x.rlike(PRINTED))
    df = df.filter(F.coalesce(long_enough, F.lit(False)) | non_food).filter(
        ~F.coalesce(placeholder, F.lit(False))
    )
    repaired = primary
    for typo, right in CATEGORY_TYPOS.items():
        repaired = F.when(primary == typo, F.lit(right)).otherwise(repaired)
    return df.withColumns(
        {
            S.PRODUCT_TYPE: strip(product_type),
            S.PRODUCT_NAME: F.when(~non_food, F.regexp_replace(name, NAME_PREFIX, "")),
            S.PFPC: F.when(non_food, F.lit(NON_FOOD))
            .when(primary == UNPROCESSED, category)
            .otherwise(repaired),
        }
    )
