"""Multinomial naive Bayes as joins of counts.

The classifier in ``classify`` holds labels times features in memory, which is right for heads with
few labels. Here the model is a table of (term, label, count) that is never gathered: a text's terms
are joined with it, so the vocabulary may be of any size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender import schema as S
from provender.errors import DataError
from provender.functions.expressions import broadcast_if_small

#: Every text is scored for every label, so there may be no more labels than this.
MAX_LABELS = 1000
#: What separates words; the same as in the features of ``classify``.
SEPARATORS = r"[^\p{L}\p{N}%&'-]+"


def terms_of(text: Column) -> Column:
    """The lower-cased words of a text."""
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "")


def term_counts(df: DataFrame, text_column: str, label_column: str) -> DataFrame:
    """(label, term, n): how often a term stands in the texts of a label."""
    label = F.col(S.quoted(label_column)).alias("label")
    terms = df.select(label, F.explode(terms_of(F.col(S.quoted(text_column)))).alias("term"))
    return terms.groupBy("label", "term").agg(F.count(F.lit(1)).alias("n"))


def document_frequency(df: DataFrame, text_column: str) -> DataFrame:
    """(term, texts, idf): in how many texts a term stands, and its weight by rarity."""
    texts = df.select(F.array_distinct(terms_of(F.col(S.quoted(text_column)))).alias("terms"))
    total = df.agg(F.count(S.quoted(text_column))).first()[0]
    counts = texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("texts"))
    return counts.withColumn("idf", F.log((F.lit(total) + 1) / (F.col("texts") + 1)))


@dataclass(frozen=True)
class Model:
    """``terms``: (term, counts by label). ``labels``: (label, base, per_term), the logarithm of a
    label's share and of what one more term without a count costs."""

    terms: DataFrame
    labels: DataFrame


def fit(df: DataFrame, text_column: str, label_column: str, smoothing: float = 1.0) -> Model:
    """Count terms and texts by label. Rows without a text or label do not count."""
    text, label = F.col(S.quoted(text_column)), F.col(S.quoted(label_column))
    rows = df.filter(text.isNotNull() & label.isNotNull())
    counts = term_counts(rows, text_column, label_column).persist()
    if counts.select("label").distinct().count() > MAX_LABELS:
        raise DataError(f"naive Bayes scores every label of a text; {MAX_LABELS} are the most")
    vocabulary = counts.select("term").distinct().count()
    texts = rows.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("texts")).persist()
    total = texts.agg(F.sum("texts")).first()[0] or 0
    sizes = counts.groupBy("label").agg(F.sum("n").alias("size"))
    size = F.coalesce("size", F.lit(0)) + smoothing * vocabulary
    labels = texts.join(sizes, "label", "left").select(
        "label", F.log(F.col("texts") / total).alias("base"), F.log(smoothing / size).alias("per_term")
    )
    gain = F.log((F.col("n") + smoothing) / smoothing).alias("gain")
    terms = counts.groupBy("term").agg(F.collect_list(F.struct("label", gain)).alias("gains"))
    return Model(terms.persist(), labels.persist())


def scores(df: DataFrame, model: Model, id_column: str, text_column: str) -> DataFrame:
    """(id, label, score): the joint log probability of each text with each label.

    What all terms cost without a count is one product for each text and label; only terms with a
    count are joined. Texts of one id count as one.
    """
    identity = F.col(S.quoted(id_column)).alias(id_column)
    read = df.select(identity, terms_of(F.col(S.quoted(text_column))).alias("_terms"))
    lengths = read.groupBy(id_column).agg(F.sum(F.greatest(F.size("_terms"), F.lit(0))).alias("_n"))
    used = (
        read.select(id_column, F.explode("_terms").alias("term"))
        .groupBy(id_column, "term")
        .agg(F.count(F.lit(1)).alias("_times"))
        .join(broadcast_if_small(model.terms), "term")
        .select(id_column, "_times", F.inline("gains"))
        .groupBy(id_column, "label")
        .agg(F.sum(F.col("_times") * F.col("gain")).alias("_gain"))
    )
    every = F.array(
        *[
            F.struct(F.lit(r["label"]).alias("label"), F.lit(r["base"]).alias("base"), F.lit(r["per_term"]).alias("per_term"))
            for r in model.labels.orderBy("label").collect()
        ]
    )
    plain = lengths.select(id_column, "_n", F.inline(every))
    return plain.join(used, [id_column, "label"], "left").select(
        id_column,
        "label",
        (F.col("base") + F.col("_n") * F.col("per_term") + F.coalesce("_gain", F.lit(0.0))).alias("score"),
    )


def predict(df: DataFrame, model: Model, id_column: str, text_column: str) -> DataFrame:
    """(id, label, score) of the best label, ties to the first in order."""
    ranked = scores(df, model, id_column, text_column)
    best = F.min(F.struct((-F.col("score")).alias("minus"), "label")).alias("_best")
    return ranked.groupBy(id_column).agg(best).select(
        id_column, "_best.label", (-F.col("_best.minus")).alias("score")
    )
