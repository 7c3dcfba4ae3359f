"""Decoding of scores in long form, for vocabularies of any size.

``decode`` keeps label tables in the plan and a row's scores in arrays. Here a score is a row
(id, head, index, score), label tables stay tables, and the masks of the basic types are bitmaps: a row
for each group and 32,768 labels that has any. Everything is aggregation that starts before the
shuffle; labels are joined last, to the few indexes that won.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provender import schema as S
from provender.functions.expressions import broadcast_if_small, is_any
from provender.operators.decode import DEFAULT_THRESHOLD, TOP_SUB_TYPES, inconsistent
from provender.operators.normalize import NON_FOOD
from provender.rules.fixed_values import HIERARCHY

#: Bits in a bitmap of Spark's bitmap aggregation (a fixed value of Spark).
BITMAP = 32_768
#: Scores this close are added up on one scale; exp() of it is far from the largest double.
SCALE = 500


def mask_bitmaps(masks: DataFrame, index: DataFrame) -> DataFrame:
    """(group, bucket, bits): which basic types, by index, were seen with the group."""
    types = index.where(F.col("column") == S.BASIC_TYPE).select(F.col("label").alias("_label"), "index").persist()
    place = F.col("index").cast("long")
    return (
        masks.join(broadcast_if_small(types), F.col("_label") == F.col(S.quoted(S.BASIC_TYPE)))
        .groupBy(F.col(S.quoted(S.FPG)).alias("group"), F.floor(place / BITMAP).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.pmod(place, F.lit(BITMAP).cast("long"))).alias("bits"))
    )


def has_bit(bits: Column, index: Column) -> Column:
    """Whether a bitmap has the bit of an index; null without a bitmap."""
    at = F.pmod(index.cast("int"), F.lit(BITMAP))
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), at % 8 + 1)) > 0


def _better(score: Column | str = "score") -> Column:
    """Sorts higher scores first, ties by index."""
    score = F.col(score) if isinstance(score, str) else score
    return F.struct((-score).alias("minus"), F.col("index").alias("index"))


def totals(scores: DataFrame, id_column: str) -> DataFrame:
    """(id, head, index, top, log_sum): the first largest score of each head and the logarithm of the sum
    of the exponentials of all.

    Sums are kept apart by scale, each ``SCALE`` wide, so that no exponential overflows and partial
    sums can be added up; scales below the two highest are nothing beside them.
    """
    scale = F.floor(F.col("score") / SCALE)
    by_scale = scores.groupBy(id_column, "head", scale.alias("scale")).agg(
        F.sum(F.exp(F.col("score") - scale * SCALE)).alias("sum"), F.min(_better()).alias("best")
    )
    highest = F.max("scale").over(Window.partitionBy(id_column, "head"))
    near = by_scale.withColumn("highest", highest).where("scale >= highest - 1")
    shifted = F.col("sum") * F.exp((F.col("scale") - F.col("highest")).cast("double") * SCALE)
    return near.groupBy(id_column, "head").agg(
        F.min("best").alias("best"),
        (F.log(F.sum(shifted)) + F.max("highest") * SCALE).alias("log_sum"),
    ).select(id_column, "head", F.col("best.index").alias("index"), (-F.col("best.minus")).alias("top"), "log_sum")


def best_valid(
    scores: DataFrame, groups: DataFrame, bitmaps: DataFrame, id_column: str
) -> DataFrame:
    """(id, index, top): the best basic type that the mask of the id's ``group`` lets through.

    An unseen group masks nothing. Where a mask lets nothing through, that is index 0 and no score.
    """
    bitmaps = bitmaps.persist()
    seen = bitmaps.select("group", F.lit(True).alias("seen")).distinct()
    known = groups.join(broadcast_if_small(seen), "group", "left")
    rows = scores.where(F.col("head") == S.BASIC_TYPE).withColumn("bucket", F.floor(F.col("index") / BITMAP))
    tested = rows.join(known, id_column).join(broadcast_if_small(bitmaps), ["group", "bucket"], "left")
    valid = F.isnull("seen") | F.coalesce(has_bit(F.col("bits"), F.col("index")), F.lit(False))
    best = tested.groupBy(id_column).agg(F.min(F.when(valid, _better())).alias("best"))
    return best.select(
        id_column, F.coalesce("best.index", F.lit(0)).alias("index"), (-F.col("best.minus")).alias("top")
    )


def with_labels(found: DataFrame, index: DataFrame) -> DataFrame:
    """``found`` (head, index, ...) with ``label``."""
    names = index.select(F.col("column").alias("head"), "index", "label").persist()
    return found.join(broadcast_if_small(names), ["head", "index"])


def sub_types(
    scores: DataFrame,
    index: DataFrame,
    counts: DataFrame,
    tags: DataFrame,
    id_column: str,
    threshold: float = DEFAULT_THRESHOLD,
) -> DataFrame:
    """(id, labels): the predicted sub-types in output order, for ids that have any.

    See ``decode.select_sub_types`` and ``decode.order_sub_types``. The two largest scores of an id are
    found before the shuffle.
    """
    rows = scores.where(F.col("head") == S.SUB_TYPES)
    none = index.where((F.col("column") == S.SUB_TYPES) & (F.col("label") == S.NO_LABEL)).select("index").first()
    is_none = F.col("index") == (none["index"] if none else -1)
    rows = rows.withColumn("score", F.when(is_none, 0.0).otherwise(F.col("score")))
    order = Window.partitionBy(id_column).orderBy(F.desc("score"), "index")
    top = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= TOP_SUB_TYPES)
    passed = top.where(~is_none & (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("score"))) > threshold))
    column = F.array_position(F.array(*[F.lit(c) for c in S.SUB_TYPE_COLUMNS]), F.col("column"))
    places = (
        counts.where(F.col("column").isin(S.SUB_TYPE_COLUMNS))
        .groupBy("label")
        .agg(F.min(F.struct(column.alias("col"), F.col("count").alias("n"))).alias("seen"))
        .join(broadcast_if_small(tags.select("label", F.lit(1).alias("tag")).distinct()), "label", "left")
        .select("label", F.struct(F.coalesce("tag", F.lit(0)).alias("tag"), "seen", "label").alias("place"))
    ).persist()
    placed = with_labels(passed.drop("place"), index).join(broadcast_if_small(places), "label")
    return placed.groupBy(id_column).agg(
        F.transform(F.array_sort(F.collect_list("place")), lambda p: p["label"]).alias("labels")
    )


def decode_long(
    scores: DataFrame,
    index: DataFrame,
    masks: DataFrame,
    counts: DataFrame,
    tags: DataFrame,
    *,
    id_column: str = "id",
    threshold: float = DEFAULT_THRESHOLD,
    assertion: bool = False,
    confidence: bool = False,
    hierarchy: dict = HIERARCHY,
) -> DataFrame:
    """What ``decode.decode`` adds to a row, a row for each id, from scores in long form.

    ``index``, ``counts`` and ``masks`` are the tables of the training preparation, ``tags`` has the tags'
    labels (``label``). An id has a score for each label of each head that it has at all; the three category
    heads have to be there. Nothing here is as large as a vocabulary in one row or in the driver.
    """
    single = scores.where(F.col("head") != S.SUB_TYPES)
    found = totals(single, id_column).persist()
    groups = with_labels(found.where(F.col("head") == S.FPG), index).select(id_column, F.col("label").alias("group"))
    valid = best_valid(scores, groups, mask_bitmaps(masks, index), id_column).select(
        id_column, F.lit(S.BASIC_TYPE).alias("head"), F.col("index").alias("_index"), F.col("top").alias("_top")
    )
    masked = F.isnotnull("_index")
    chosen = found.join(valid, [id_column, "head"], "left").select(
        id_column,
        "head",
        F.coalesce("_index", "index").alias("index"),
        F.when(masked & F.isnull("_top"), 0.0)
        .otherwise(F.exp(F.coalesce("_top", "top") - F.col("log_sum")))
        .alias("score"),
    )
    named = with_labels(chosen, index)
    heads = [h for h in S.HEADS if h != S.SUB_TYPES]
    of = {h: F.max(F.when(F.col("head") == h, F.struct("label", "score"))).alias(h) for h in heads}
    rows = named.groupBy(id_column).agg(*of.values())
    group, category, primary = (F.col(f"{S.quoted(c)}.label") for c in S.CATEGORY_LABELS)
    non_food = is_any(group, [NON_FOOD]) | is_any(category, [NON_FOOD])
    failed = inconsistent(group, category, primary, hierarchy) if assertion else F.lit(False)
    rows = rows.withColumns({"_non_food": non_food, "_failed": failed})
    void = F.col("_non_food") | F.col("_failed")
    columns: dict[str, Column] = {}
    for h in heads:
        label = F.col(f"{S.quoted(h)}.label")
        if h in S.CATEGORY_LABELS:
            columns[h] = F.when(F.col("_non_food"), NON_FOOD).when(~F.col("_failed"), label)
        else:
            columns[h] = F.when(~void, label)
        if confidence:
            columns[f"{h}_score"] = F.when(~F.col("_non_food"), F.col(f"{S.quoted(h)}.score"))
    lists = sub_types(scores, index, counts, tags, id_column, threshold)
    joined = rows.join(lists.withColumnRenamed(id_column, "_id"), F.col(id_column) == F.col("_id"), "left")
    for i, c in enumerate(S.SUB_TYPE_COLUMNS):
        columns[c] = F.when(~void, F.get("labels", F.lit(i)))
    return joined.select(id_column, *[v.alias(c) for c, v in columns.items()])
