"""Tables written from a normalized frame: exports, differences, overflow, value counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provender import schema as S
from provender.functions.expressions import list_text, lookup, packed, unpacked

# The orders of the exported tables.
MISC_SORT = [S.FPG, S.FPC, S.BASIC_TYPE]
EXPORT_SORT = [S.FPG, S.FPC, S.BASIC_TYPE, "Sub-Type 1", "Sub-Type 2"]
SCORING_RENAMES = {"Origin Detail": "Producer/Processor"}
# Kinds of columns that a sort packs into one value, if there are so many of them.
PACKED, MIN_PACKED = ("string", "array<string>"), 3


def _columns(names):
    return [F.col(S.quoted(c)) for c in names]


def _sorted(df: DataFrame, names: list[str], shown: list[str]) -> DataFrame:
    """The columns ``shown`` in a global order by ``names``, nulls last, ties in input order where a ``row_id`` is there.

    A sort sends whole rows over the disks, so that text that it does not compare goes along as one value."""
    keys = [*names, *([S.ROW_ID] if S.ROW_ID in df.columns else [])]
    order = [c.asc_nulls_last() for c in _columns(keys)]
    kinds = {c: df.schema[c].dataType.simpleString() for c in shown if c not in keys}
    together = {c: kind for c, kind in kinds.items() if kind in PACKED}
    if len(together) < MIN_PACKED:
        return df.orderBy(*order).select(*_columns(shown))
    others = [c for c in kinds if c not in together]
    rows = df.select(*_columns([*keys, *others]), packed(together).alias("_packed")).orderBy(*order)
    return unpacked(rows, "_packed", together).select(*_columns(shown))


def normalized_export(df: DataFrame, *, ordered: bool = True) -> DataFrame:
    """The 22 export columns; ``Product Name`` is the cleaned original."""
    return _sorted(df, EXPORT_SORT, S.EXPORT_COLUMNS) if ordered else df.select(*_columns(S.EXPORT_COLUMNS))


def misc_overflow(df: DataFrame, *, ordered: bool = True, as_text: bool = False) -> DataFrame:
    """Rows with more sub-types than columns. Non-food rows, whose Misc is null, count too."""
    df = df.filter(F.col(S.MISC).isNull() | (F.size(S.MISC) > 0))
    df = _sorted(df, MISC_SORT, S.MISC_EXPORT_COLUMNS) if ordered else df
    misc = list_text(F.col(S.MISC)) if as_text else F.col(S.MISC)
    return df.withColumn(S.MISC, misc).select(*_columns(S.MISC_EXPORT_COLUMNS))


def name_differences(df: DataFrame, *, ordered: bool = True) -> DataFrame:
    """Rows whose normalized name differs from the given one, as ``self`` and ``other``."""
    name, normalized = F.col(S.quoted(S.PRODUCT_NAME)), F.col(S.quoted(S.NORMALIZED_NAME))
    df = df.filter(~name.eqNullSafe(normalized))
    df = df.withColumns({"self": name, "other": normalized})
    shown = [S.PRODUCT_TYPE, "self", "other"]
    return _sorted(df, ["self"], shown) if ordered else df.select(*_columns(shown))


def scoring_export(df: DataFrame) -> DataFrame:
    """The table of the scoring platform: the normalized name takes the name column."""
    df = df.withColumn(S.PRODUCT_NAME, F.col(S.quoted(S.NORMALIZED_NAME)))
    names = [*S.ID_COLUMNS, *S.EXPORT_COLUMNS]
    return df.select(
        *[F.col(S.quoted(c)).alias(SCORING_RENAMES.get(c, c)) for c in names]
    )


def count_values(df: DataFrame, columns: list[str], merge: dict[str, str]) -> DataFrame:
    """(column, value, count) over all given columns in one pass, nulls left out.

    ``merge`` renames columns before counting, so that several count as one. Counting is partial
    within each task before the shuffle, so a frequent value costs one row per task.
    """
    long = df.select(*_columns(columns)).unpivot([], _columns(columns), "column", "value")
    if merge:
        target = lookup(F.col("column"), merge, "string")
        long = long.withColumn("column", F.coalesce(target, F.col("column")))
    return (
        long.filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def value_counts(df: DataFrame) -> DataFrame:
    """Counts of every value of every export column, the sub-type columns taken together."""
    return count_values(df, S.EXPORT_COLUMNS, {c: S.SUB_TYPES for c in S.SUB_TYPE_COLUMNS})


def subtype_counts(df: DataFrame) -> DataFrame:
    """Counts of sub-types over the three sub-type columns."""
    merged = count_values(df, S.SUB_TYPE_COLUMNS, {c: S.SUB_TYPES for c in S.SUB_TYPE_COLUMNS})
    return merged.select("value", "count")


def sheet_order() -> list[str]:
    """Export columns in order, the merged sub-types right after the basic type."""
    order = [c for c in S.EXPORT_COLUMNS if c not in S.SUB_TYPE_COLUMNS]
    order.insert(order.index(S.BASIC_TYPE) + 1, S.SUB_TYPES)
    return order


def count_sheets(counts: DataFrame, *, ordered: bool = True) -> DataFrame:
    """Value counts in sheet order: by column, then count descending, then value."""
    counts = counts.withColumn(
        "column_pos",
        lookup(F.col("column"), {c: i for i, c in enumerate(sheet_order())}, "int"),
    )
    if ordered:
        counts = counts.orderBy("column_pos", F.col("count").desc(), "value")
    return counts.select("column_pos", "column", "value", "count")
