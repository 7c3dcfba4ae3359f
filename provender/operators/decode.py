"""From model scores to labels: argmax, masks, consistency checks, sub-types, output tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provender import schema as S
from provender.errors import RuleError
from provender.functions.expressions import (
    broadcast_if_small,
    constant,
    is_any,
    let,
    lookup,
    strip,
)
from provender.functions.saved import read_json, write_json
from provender.operators.normalize import NON_FOOD
from provender.rules.fixed_values import HIERARCHY

TOP_SUB_TYPES = 2
#: Rows of a label table in a decoder, which is a literal of the plan searched by hash.
MAX_DECODER_ROWS = 200_000
DEFAULT_THRESHOLD = 0.5


@dataclass(frozen=True)
class Decoder:
    """What a trained model knows about its labels. Vocabulary-sized, never data-sized."""

    labels: dict[str, list[str]]
    sub_type_counts: dict[str, dict[str, int]]
    masks: dict[str, list[str]]
    tags: tuple[str, ...] = ()
    hierarchy: dict[str, list[str]] = field(default_factory=lambda: dict(HIERARCHY))

    @classmethod
    def from_tables(
        cls,
        index: DataFrame,
        counts: DataFrame,
        masks: DataFrame,
        tags: Iterable[str] = (),
        hierarchy: dict[str, list[str]] | None = None,
    ) -> "Decoder":
        """Read the label tables of the training preparation, refusing oversized ones."""
        labels: dict[str, list] = {head: [] for head in S.HEADS}
        for row in sorted(_bounded(index, "labels"), key=lambda r: r["index"]):
            labels[row["column"]].append(row["label"])
        sub_counts: dict[str, dict[str, int]] = {c: {} for c in S.SUB_TYPE_COLUMNS}
        for row in _bounded(counts.filter(F.col("column").isin(S.SUB_TYPE_COLUMNS)), "counts"):
            sub_counts[row["column"]][row["label"]] = row["count"]
        valid: dict[str, list[str]] = {}
        for group, basic_type in _bounded(masks, "masks"):
            valid.setdefault(group, []).append(basic_type)
        return cls(labels, sub_counts, valid, tuple(tags), dict(hierarchy or HIERARCHY))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the decoder beside the model that it belongs to."""
        value = {"labels": self.labels, "sub_type_counts": self.sub_type_counts, "tags": list(self.tags)}
        pairs = {"masks": list(self.masks.items()), "hierarchy": list(self.hierarchy.items())}
        write_json(spark, path, {**value, **pairs})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Decoder":
        value = read_json(spark, path)
        masks, hierarchy = (dict(map(tuple, value[k])) for k in ("masks", "hierarchy"))
        return cls(value["labels"], value["sub_type_counts"], masks, tuple(value["tags"]), hierarchy)

    def mask(self, group: str) -> list[int]:
        valid = set(self.masks[group])
        return [int(label in valid) for label in self.labels[S.BASIC_TYPE]]


def _bounded(table: DataFrame, what: str) -> list:
    rows = table.limit(MAX_DECODER_ROWS + 1).collect()
    if len(rows) > MAX_DECODER_ROWS:
        raise RuleError(f"the {what} table has more than {MAX_DECODER_ROWS} rows")
    return rows


def softmax(scores: Column) -> Column:
    """Probabilities of one head, shifted by the largest score."""
    return let(
        F.transform(scores, lambda x: x.cast("double")),
        lambda s: let(
            let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top))),
            lambda e: let(
                F.aggregate(e, F.lit(0.0), lambda total, x: total + x),
                lambda total: F.transform(e, lambda x: x / total),
            ),
        ),
    )


def argmax(scores: Column) -> Column:
    """Index of the first largest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def label_at(index: Column, labels: list[str]) -> Column:
    return F.get(constant(labels, "array<string>"), index)


def masked(scores: Column, group: Column, decoder: Decoder) -> Column:
    """Basic-type probabilities times 0/1 by the group; an unseen group masks nothing."""
    masks = {g: decoder.mask(g) for g in decoder.masks}
    mask = lookup(group, masks, "array<int>")
    return let(
        mask,
        lambda m: F.when(m.isNull(), scores).otherwise(F.zip_with(scores, m, lambda s, k: s * k)),
    )


def best_valid_labels(
    scores: DataFrame, index: DataFrame, masks: DataFrame, id_column: str
) -> DataFrame:
    """(id, group, label, score): the best basic type that goes with a group, by joins.

    The join form of :func:`masked` and :func:`argmax`, for label tables of any size. ``scores``
    has id, ``group``, ``index`` and ``score``, a row for each basic type with its probability;
    ``index`` and ``masks`` are the tables of the training preparation. An unseen group masks
    nothing, and ties go to the first index.
    """
    names = index.filter(F.col("column") == S.BASIC_TYPE).select("label", "index").persist()
    pairs = masks.select(
        F.col(S.quoted(S.FPG)).alias("group"), F.col(S.quoted(S.BASIC_TYPE)).alias("label")
    )
    valid = pairs.join(names, "label").select("group", "index", F.lit(True).alias("_valid")).persist()
    seen = pairs.select("group", F.lit(True).alias("_seen")).distinct().persist()
    kept = (
        scores.join(broadcast_if_small(valid), ["group", "index"], "left")
        .join(broadcast_if_small(seen), "group", "left")
        .withColumn("score", F.when(F.isnull("_seen") | F.isnotnull("_valid"), F.col("score")).otherwise(0.0))
    )
    best = F.min(F.struct((-F.col("score")).alias("minus"), "index", "group")).alias("_best")
    return (
        kept.groupBy(id_column)
        .agg(best)
        .select(id_column, "_best.group", "_best.index", (-F.col("_best.minus")).alias("score"))
        .join(broadcast_if_small(names), "index")
        .select(id_column, "group", "label", "score")
    )


def inconsistent(
    group: Column, category: Column, primary: Column, hierarchy: dict = HIERARCHY
) -> Column:
    """Whether predicted categories contradict each other.

    The category has to belong to the group; outside meals the primary category has to be the
    same and belong to it too.
    """
    # A category may be listed under two groups, so membership is tested per group.
    def belongs(value: Column) -> Column:
        members = lookup(group, hierarchy, "array<string>")
        return F.coalesce(F.array_contains(members, value), F.lit(False))

    not_meals = ~is_any(group, ["Meals"])
    return (
        ~belongs(category)
        | (not_meals & ~category.eqNullSafe(primary))
        | (not_meals & ~belongs(primary))
    )


def select_sub_types(
    scores: Column, decoder: Decoder, threshold: float = DEFAULT_THRESHOLD
) -> Column:
    """Indexes of the predicted sub-types: of the two largest scores those over the threshold.

    The "no value" class takes part with score 0 and is never predicted, and the scores that were
    not among the largest count as absent for any threshold.
    """
    labels = decoder.labels[S.SUB_TYPES]
    none_index = labels.index(S.NO_LABEL) if S.NO_LABEL in labels else -1
    pairs = F.transform(
        scores,
        lambda x, i: F.struct(
            (-F.when(i == none_index, F.lit(0.0)).otherwise(x.cast("double"))).alias("minus"),
            i.cast("int").alias("index"),
        ),
    )
    top = F.slice(F.array_sort(pairs), 1, TOP_SUB_TYPES)
    passed = F.filter(
        top,
        lambda p: (p["index"] != none_index)
        & (F.lit(1.0) / (F.lit(1.0) + F.exp(p["minus"])) > threshold),
    )
    return F.transform(passed, lambda p: p["index"])


def order_sub_types(indexes: Column, decoder: Decoder) -> Column:
    """Labels in output order.

    By the first sub-type column the label was seen in, then by its count there, then by name;
    labels that are also tags of another column go last, and unseen labels are left out.
    """
    places = {}
    for label in decoder.labels[S.SUB_TYPES]:
        for number, column in enumerate(S.SUB_TYPE_COLUMNS, start=1):
            if label in decoder.sub_type_counts.get(column, {}):
                places[label] = {
                    "tag": int(label in decoder.tags),
                    "col": number,
                    "n": decoder.sub_type_counts[column][label],
                    "label": label,
                }
                break
    found = F.transform(
        indexes,
        lambda i: lookup(
            label_at(i, decoder.labels[S.SUB_TYPES]),
            places,
            "struct<tag:int,col:int,n:bigint,label:string>",
        ),
    )
    ordered = F.array_sort(F.array_compact(found))
    return F.transform(ordered, lambda p: p["label"])


def combined_prediction(columns: Iterable[str]) -> Column:
    """One name from the predicted columns, without categories, scores and "no value"."""
    used = [c for c in columns if "_score" not in c and "Food" not in c]
    parts = [F.nullif(F.col(S.quoted(c)), F.lit(S.NO_LABEL)) for c in used]
    return F.rtrim(strip(F.concat_ws(", ", *parts)), F.lit(","))


def decode(
    df: DataFrame,
    scores: dict[str, Column],
    decoder: Decoder,
    *,
    threshold: float = DEFAULT_THRESHOLD,
    assertion: bool = False,
    confidence: bool = False,
    combine: bool = False,
) -> DataFrame:
    """Add the predicted label of every head to the rows, all as column expressions.

    ``scores`` gives each head's raw scores, in decoder order. Rows whose categories contradict
    each other lose all labels when ``assertion`` is set.
    """
    heads = [h for h in S.HEADS if h in scores and h != S.SUB_TYPES]
    work = df.select("*", *[softmax(scores[h]).alias(f"_p {h}") for h in heads])
    work = work.withColumns(
        {
            f"_l {h}": label_at(argmax(F.col(S.quoted(f"_p {h}"))), decoder.labels[h])
            for h in S.CATEGORY_LABELS
        }
    )
    group, category, primary = (F.col(S.quoted(f"_l {c}")) for c in S.CATEGORY_LABELS)
    if S.BASIC_TYPE in heads:
        name = f"_p {S.BASIC_TYPE}"
        work = work.withColumn(name, masked(F.col(S.quoted(name)), group, decoder))
    non_food = is_any(group, [NON_FOOD]) | is_any(category, [NON_FOOD])
    failed = F.lit(False)
    if assertion:
        failed = inconsistent(group, category, primary, decoder.hierarchy)
    work = work.withColumns({"_non_food": non_food, "_failed": failed})
    void = F.col("_non_food") | F.col("_failed")

    columns: dict[str, Column] = {}
    for h in heads:
        probabilities = F.col(S.quoted(f"_p {h}"))
        if h in S.CATEGORY_LABELS:
            columns[h] = F.when(F.col("_non_food"), NON_FOOD).when(
                ~F.col("_failed"), F.col(S.quoted(f"_l {h}"))
            )
        else:
            columns[h] = F.when(~void, label_at(argmax(probabilities), decoder.labels[h]))
        if confidence:
            columns[f"{h}_score"] = F.when(~F.col("_non_food"), F.array_max(probabilities))
    if S.SUB_TYPES in scores:
        chosen = select_sub_types(scores[S.SUB_TYPES], decoder, threshold)
        work = work.withColumn("_st", F.when(~void, order_sub_types(chosen, decoder)))
        for i, c in enumerate(S.SUB_TYPE_COLUMNS):
            columns[c] = F.get(F.col("_st"), F.lit(i))
    kept = [c for c in df.columns if c not in columns]
    result = work.select(
        *[F.col(S.quoted(c)) for c in kept], *[v.alias(c) for c, v in columns.items()]
    )
    if combine:
        result = result.withColumn("Combined Name", combined_prediction(columns))
    return result


def canonical_names(df: DataFrame) -> DataFrame:
    """Column names in any capitalization become the canonical ones."""
    known = {c.lower(): c for c in S.PREDICTION_COLUMNS}
    known["center product id"] = "Product Identifier"
    return df.toDF(*[known.get(c.lower(), c.lower()) for c in df.columns])


def no_label_to_null(df: DataFrame) -> DataFrame:
    """The "no value" label becomes null, on output."""
    return df.replace(S.NO_LABEL, None)


def prediction_output(df: DataFrame) -> DataFrame:
    """The output columns in order, missing ones as null, without "no value" labels."""
    return no_label_to_null(
        df.select(
            *[
                F.col(S.quoted(c)).cast("string").alias(c)
                if c in df.columns
                else F.lit(None).cast("string").alias(c)
                for c in S.PREDICTION_COLUMNS
            ]
        )
    )
