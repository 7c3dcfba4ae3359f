"""Evaluation: accuracy and support-weighted precision, recall and F1 per head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender import schema as S


def long_predictions(df: DataFrame, heads: list[str], label_suffix="", pred_suffix="_pred"):
    """(head, label, pred), one row per row and head."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(h).alias("head"),
                F.col(S.quoted(h + label_suffix)).alias("label"),
                F.col(S.quoted(h + pred_suffix)).alias("pred"),
            )
            for h in heads
        ]
    )
    return df.select(F.inline(pairs))


def confusion(long: DataFrame) -> DataFrame:
    """(head, label, pred, n). All single-label metrics come from this small table."""
    return long.groupBy("head", "label", "pred").agg(F.count(F.lit(1)).alias("n"))


def _weighted(value: Column, support: Column) -> Column:
    """Average weighted by support over the classes where the value is defined."""
    defined = value.isNotNull()
    weight = F.sum(F.when(defined, support))
    return F.when(weight > 0, F.sum(value * support) / weight)


def _weighted_scores(classes: DataFrame, keys: list[str], accuracy: Column) -> DataFrame:
    """Accuracy and weighted scores from (keys, class, tp, support, predicted)."""
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return classes.groupBy(*keys).agg(
        accuracy.alias("accuracy"),
        _weighted(F.try_divide(tp, predicted), support).alias("precision"),
        _weighted(F.try_divide(tp, support), support).alias("recall"),
        _weighted(F.try_divide(2 * tp, support + predicted), support).alias("f1"),
    )


def head_metrics(counts: DataFrame) -> DataFrame:
    """(head, accuracy, precision, recall, f1) from a confusion table.

    Never-predicted classes have no precision and leave its average, as the weights are taken
    over the defined classes only.
    """
    hit = F.col("label") == F.col("pred")
    sides = counts.select(
        F.col("head"),
        F.inline(
            F.array(
                F.struct(
                    F.col("label").alias("class"),
                    F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("bigint").alias("predicted"),
                ),
                F.struct(
                    F.col("pred").alias("class"),
                    F.lit(0).cast("bigint").alias("tp"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("predicted"),
                ),
            )
        ),
    )
    classes = sides.groupBy("head", "class").agg(
        *[F.sum(c).alias(c) for c in ("tp", "support", "predicted")]
    )
    # Every row supports one class, so the accuracy comes from the class table as well.
    return _weighted_scores(classes, ["head"], F.sum("tp") / F.sum("support"))


def multilabel_metrics(
    df: DataFrame, labels: str, predictions: str, head: str = S.SUB_TYPES
) -> DataFrame:
    """Subset accuracy (exact set equality) and weighted scores of two set columns.

    One pass: each row's labels are compared inside the row and become one row per class, and one
    more for the row itself, which carries whether its sets are equal. So the input is read once
    and nothing is joined.
    """
    truth, guess = F.col(S.quoted(labels)), F.col(S.quoted(predictions))
    exact = F.array_sort(F.array_distinct(truth)) == F.array_sort(F.array_distinct(guess))

    def part(name: Column, is_class: bool, tp: Column, support: Column, predicted: Column) -> Column:
        return F.struct(
            name.cast("string").alias("class"),
            F.lit(is_class).alias("is_class"),
            tp.cast("bigint").alias("tp"),
            support.cast("bigint").alias("support"),
            predicted.cast("bigint").alias("predicted"),
        )

    in_truth, in_guess = (lambda x: F.array_contains("_t", x)), (lambda x: F.array_contains("_g", x))
    one = F.lit(1)
    parts = df.select(truth.alias("_t"), guess.alias("_g"), exact.alias("_exact")).select(
        F.inline(
            F.concat(
                F.array(part(F.lit(None), False, F.col("_exact"), one, one)),
                F.transform(
                    F.array_union("_t", "_g"),
                    lambda x: part(x, True, in_truth(x) & in_guess(x), in_truth(x), in_guess(x)),
                ),
            )
        )
    )
    classes = parts.groupBy("is_class", "class").agg(
        *[F.sum(c).alias(c) for c in ("tp", "support", "predicted")]
    )
    # The rows' own class gives the accuracy and has no weight in the scores.
    of_rows = ~F.col("is_class")
    only = [F.when(F.col("is_class"), F.col(c)).alias(c) for c in ("tp", "support", "predicted")]
    scores = _weighted_scores(
        classes.select("is_class", *only, F.col("tp").alias("_tp"), F.col("support").alias("_n")),
        [],
        F.sum(F.when(of_rows, F.col("_tp"))) / F.sum(F.when(of_rows, F.col("_n"))),
    )
    return scores.select(
        F.lit(head).alias("head"), "accuracy", "precision", "recall", "f1"
    )


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Means over heads, and the accuracy of the basic type."""
    return metrics.agg(
        F.avg("accuracy").alias("mean_accuracy"),
        (F.sum("f1") / F.count(F.lit(1))).alias("mean_f1_score"),
        F.max(F.when(F.col("head") == S.BASIC_TYPE, F.col("accuracy"))).alias(
            "basic_type_accuracy"
        ),
    )
