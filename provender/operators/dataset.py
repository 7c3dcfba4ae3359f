"""Training tables: deduplication, label vocabularies, class counts, masks, encoded labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender import schema as S
from provender.functions.expressions import MAX_BROADCAST_ROWS, broadcast_if_small, compile_wide_rows, lookup
from provender.functions.ranking import rank_within
from provender.rules.ruleset import MAX_TABLE_ROWS

ORDER = ["file_no", S.ROW_ID]


def _col(name: str) -> Column:
    return F.col(S.quoted(name))


def keep_first(
    df: DataFrame, text_column: str = S.PRODUCT_TYPE, order: list[str] | None = None
) -> DataFrame:
    """One row per text: the first in file and row order.

    An aggregation rather than a window: each task keeps its own first row per text before the
    shuffle, so a text that makes up a third of the table costs one row per task.
    """
    order = [c for c in (order or ORDER) if c in df.columns]
    rest = [c for c in df.columns if c != text_column]
    first = F.min_by(F.struct(*[_col(c) for c in rest]), F.struct(*[_col(c) for c in order]))
    kept = df.groupBy(_col(text_column)).agg(first.alias("_row"))
    return kept.select(
        *[
            _col(c) if c == text_column else F.col("_row")[c].alias(c)
            for c in df.columns
        ]
    )


def class_counts(df: DataFrame, labels: list[str] = S.LABELS) -> DataFrame:
    """(column, label, count) for every label column, and ``Sub-Types`` for its three together.

    One pass over the rows; the sub-type total is added up from the counts.
    """
    counts = (
        df.select(*[_col(c) for c in labels])
        .unpivot([], [_col(c) for c in labels], "column", "label")
        .groupBy("column", "label")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    targets = F.when(
        F.col("column").isin(S.SUB_TYPE_COLUMNS), F.array(F.col("column"), F.lit(S.SUB_TYPES))
    ).otherwise(F.array("column"))
    return (
        counts.select(F.explode(targets).alias("column"), "label", "count")
        .groupBy("column", "label")
        .agg(F.sum("count").alias("count"))
    )


def label_index(counts: DataFrame) -> DataFrame:
    """(column, label, index): the place of each label among the sorted labels of its head."""
    labels = counts.filter(~F.col("column").isin(S.SUB_TYPE_COLUMNS)).select("column", "label")
    ranked = rank_within(labels, ["column"], ["label"])
    return ranked.select("column", "label", (F.col("rank") - 1).cast("int").alias("index"))


def decoders(index: DataFrame) -> DataFrame:
    """(head_pos, column, index, label), heads in label order with ``Sub-Types`` last."""
    position = lookup(F.col("column"), {c: i for i, c in enumerate(S.HEADS)}, "int")
    return index.select(position.alias("head_pos"), "column", "index", "label")


def inference_masks(df: DataFrame) -> DataFrame:
    """(group, basic type): the basic types seen with each food product group."""
    return df.select(_col(S.FPG), _col(S.BASIC_TYPE)).distinct()


def mask_vectors(masks: DataFrame, index: DataFrame) -> DataFrame:
    """(group, mask): 1 at the index of each basic type seen with the group, else 0.

    Vectors are as long as the basic-type vocabulary, which ``broadcast_if_small`` measures.
    """
    types = index.filter(F.col("column") == S.BASIC_TYPE).select(
        F.col("label").alias("_label"), "index"
    )
    size = types.count()
    seen = (
        masks.join(broadcast_if_small(types), F.col("_label") == _col(S.BASIC_TYPE))
        .groupBy(_col(S.FPG))
        .agg(F.collect_set("index").alias("_seen"))
    )
    return seen.select(_col(S.FPG), multi_hot(F.col("_seen"), size).alias("mask"))


def encode_labels(
    df: DataFrame,
    index: DataFrame,
    labels: list[str] = S.LABELS,
    max_literal_rows: int = MAX_TABLE_ROWS,
) -> DataFrame:
    """Add ``<label>_index`` for each label; the sub-type columns share one vocabulary.

    A vocabulary of up to ``max_literal_rows`` becomes a literal of the plan, so encoding is one
    pass over the rows without a join. A larger one is joined head by head, as a broadcast where
    the head's size allows it and with a shuffle where not.
    """
    compile_wide_rows(df.sparkSession)
    index = index.persist()
    heads = {c: S.SUB_TYPES if c in S.SUB_TYPE_COLUMNS else c for c in labels}
    known = index.limit(max_literal_rows + 1).collect()
    if len(known) <= max_literal_rows:
        tables: dict[str, dict[str, int]] = {head: {} for head in heads.values()}
        for row in known:
            if row["column"] in tables:
                tables[row["column"]][row["label"]] = row["index"]
        return df.withColumns({f"{c}_index": _looked_up(_col(c), tables[heads[c]]) for c in labels})
    sizes = {row["column"]: row["count"] for row in index.groupBy("column").count().collect()}
    result = df
    for label in labels:
        part = index.filter(F.col("column") == heads[label]).select("label", "index")
        result = _joined_index(result, part, label, sizes.get(heads[label], 0))
    return result


def _looked_up(label: Column, table: dict[str, int]) -> Column:
    """The index of a label in a literal table. The "no value" label is told by one comparison."""
    index = lookup(label, table, "int")
    if S.NO_LABEL not in table:
        return index
    return F.when(label == S.NO_LABEL, F.lit(table[S.NO_LABEL])).otherwise(index)


def _joined_index(df: DataFrame, part: DataFrame, label: str, size: int) -> DataFrame:
    """``<label>_index`` by a join. The "no value" label, most of nearly every column, is looked up
    once; its rows have no join key but a salt, so a shuffle does not gather them in one task."""
    key, value = f"{label} key", f"{label}_index"
    part = part.select(F.col("label").alias(key), F.col("index").alias(value))
    if size <= MAX_BROADCAST_ROWS:
        return df.join(F.broadcast(part), _col(label) == _col(key), "left").drop(key)
    none = part.filter(_col(key) == S.NO_LABEL).first()
    is_none = _col(label) == S.NO_LABEL
    rows = df.withColumns(
        {
            "_wanted": F.when(~is_none, _col(label)),
            "_salt": F.when(is_none, F.xxhash64(*[_col(c) for c in df.columns])).otherwise(0),
        }
    )
    part = part.withColumn("_zero", F.lit(0).cast("long"))
    same = (F.col("_wanted") == _col(key)) & (F.col("_salt") == F.col("_zero"))
    joined = rows.join(part, same, "left")
    filled = F.when(_col(label) == S.NO_LABEL, F.lit(none[value] if none else None).cast("int"))
    return joined.withColumn(value, filled.otherwise(_col(value))).drop(key, "_wanted", "_salt", "_zero")


def sub_type_target(columns: list[str] = S.SUB_TYPE_COLUMNS) -> Column:
    """The row's sub-types as a set, without the "no value" label."""
    return F.array_sort(
        F.array_except(F.array(*[_col(c) for c in columns]), F.array(F.lit(S.NO_LABEL)))
    )


def multi_hot(indexes: Column, size: int) -> Column:
    """A 0/1 vector of the given length with ones at the indexes, in time linear in the length.

    Between two neighbouring indexes stands a run of zeros and a one.
    """
    ends = F.concat(F.sort_array(F.array_distinct(indexes)), F.array(F.lit(size)))
    runs = F.transform(
        ends,
        lambda end, i: F.concat(
            F.array_repeat(F.lit(0), end - F.when(i > 0, F.get(ends, i - 1) + 1).otherwise(0)),
            F.array_repeat(F.lit(1), F.when(end < size, 1).otherwise(0)),
        ),
    )
    return F.flatten(runs)


def label_set_index(
    df: DataFrame,
    labels: Column,
    index: DataFrame,
    head: str,
    max_literal_rows: int = MAX_TABLE_ROWS,
) -> DataFrame:
    """Add ``ones``, the sorted indexes of a set of labels.

    With a small vocabulary this is a lookup inside the row. With a larger one the labels are
    exploded and joined, and gathered again by a row number, which no row shares with another.
    """
    part = index.filter(F.col("column") == head).select("label", "index").persist()
    known = part.limit(max_literal_rows + 1).collect()
    if len(known) <= max_literal_rows:
        table = {row["label"]: row["index"] for row in known}
        ones = F.array_compact(F.transform(labels, lambda x: lookup(x, table, "int")))
        return df.withColumn("ones", F.array_sort(F.array_distinct(ones)))
    rows = df.withColumn("_row", F.monotonically_increasing_id()).persist()
    found = (
        rows.select("_row", F.explode(labels).alias("label"))
        .join(broadcast_if_small(part), "label")
        .groupBy("_row")
        .agg(F.array_sort(F.collect_set("index")).alias("ones"))
    )
    nothing = F.array().cast("array<int>")
    return (
        rows.join(found, "_row", "left")
        .withColumn("ones", F.coalesce("ones", nothing))
        .drop("_row")
    )


def text_input(text_column: str = S.PRODUCT_TYPE) -> Column:
    """The classifier's text: lower case, since product types are usually all capitals."""
    return F.lower(_col(text_column))
