"""A multi-column text classifier: shared text features, one distributed linear model per head."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    NaiveBayes,
    NaiveBayesModel,
)
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provender import schema as S
from provender.errors import DataError
from provender.functions.expressions import let, lookup
from provender.functions.saved import read_json, write_json
from provender.functions.shared import kept as written
from provender.operators.dataset import sub_type_target, text_input
from provender.operators.metrics import confusion, head_metrics, mean_metrics, multilabel_metrics
from provender.rules.ruleset import MAX_TABLE_ROWS

FEATURES = "features"
ESTIMATORS = ("naive_bayes", "logistic_regression")
LOADED = {m.__name__: m for m in (NaiveBayesModel, LogisticRegressionModel)}
#: Labels times features of a head, which naive Bayes holds in the driver and in every task.
MAX_MODEL_CELLS = 50_000_000
#: The same of all heads together, up to which a Python worker holds naive Bayes models, to score blocks of rows.
MAX_SHARED_CELLS = 8_000_000
#: Rows scored side by side.
BLOCK = 512
#: A probability is taken as at least this.
LEAST = 1e-300
CHOICE_METRICS = ("basic_type_accuracy", "mean_f1_score")


def feature_pipeline(
    text_column: str = S.PRODUCT_TYPE, num_features: int = 1 << 15, ngrams: int = 1
) -> Pipeline:
    """Lower-cased words (and longer n-grams), hashed and weighted by rarity."""
    stages = [
        SQLTransformer(statement=f"SELECT *, lower(`{text_column}`) AS _text FROM __THIS__"),
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}%&'-]+"),
    ]
    terms = "_words"
    if ngrams > 1:
        parts = [terms]
        for n in range(2, ngrams + 1):
            stages.append(NGram(n=n, inputCol="_words", outputCol=f"_gram{n}"))
            parts.append(f"_gram{n}")
        stages.append(
            SQLTransformer(statement=f"SELECT *, concat({', '.join(parts)}) AS _terms FROM __THIS__")
        )
        terms = "_terms"
    stages += [
        HashingTF(inputCol=terms, outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol=FEATURES),
    ]
    return Pipeline(stages=stages)


def _estimator(kind: str):
    if kind not in ESTIMATORS:
        raise DataError(f"estimator must be one of {ESTIMATORS}, not {kind!r}")
    if kind == "naive_bayes":
        return NaiveBayes(featuresCol=FEATURES, labelCol="_y")
    return LogisticRegression(featuresCol=FEATURES, labelCol="_y", maxIter=30, regParam=1e-4)


@dataclass(frozen=True)
class TextClassifier:
    """Fitted models. ``labels`` lists each head's labels in score order."""

    text_column: str
    features: PipelineModel
    models: dict
    labels: dict[str, list[str]]

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        labels: dict[str, list[str]],
        *,
        text_column: str = S.PRODUCT_TYPE,
        estimator: str = "naive_bayes",
        num_features: int = 1 << 15,
        ngrams: int = 1,
    ) -> "TextClassifier":
        """Fit one model per head in ``labels`` on all rows.

        The sub-types head is trained on one row per sub-type that a row has; rows without any
        count for the "no value" class.
        """
        cells = num_features * max(map(len, labels.values()), default=0)
        if estimator == "naive_bayes" and cells > MAX_MODEL_CELLS:
            raise DataError(
                f"a model of {cells} numbers is held in memory; take fewer features, or ``bayes``"
            )
        *stages, rarity = feature_pipeline(text_column, num_features, ngrams).getStages()
        counting = PipelineModel(stages)
        targets = {head: _label_indexes(head, names) for head, names in labels.items()}
        # Texts are cut into words once: the weights by rarity are put on counts that are kept.
        data = counting.transform(df).select("_tf", *[y.alias(f"_y {head}") for head, y in targets.items()]).persist()
        weights = rarity.fit(data)
        features = PipelineModel([*stages, weights])
        models = {}
        for head, names in labels.items():
            # The number of classes, which is known, would be looked for in a pass of its own.
            about = {"ml_attr": {"type": "nominal", "num_vals": len(names)}}
            rows = data.select("_tf", F.explode(S.quoted(f"_y {head}")).alias("_y", metadata=about))
            models[head] = _estimator(estimator).fit(weights.transform(rows))
        data.unpersist()
        return cls(text_column, features, models, {h: list(v) for h, v in labels.items()})

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``<head> scores``, an array per head: log-probabilities, or log-odds for sub-types."""
        result = self.features.transform(df).drop("_text", "_words", "_terms", "_tf")
        cells = sum(m.numFeatures * m.numClasses for m in self.models.values())
        if cells <= MAX_SHARED_CELLS and all(isinstance(m, NaiveBayesModel) for m in self.models.values()):
            return self._scored_in_blocks(result).drop(FEATURES)
        for head, model in self.models.items():
            model = model.copy()
            model.setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_c")
            result = model.transform(result)
            p = vector_to_array(F.col("_p"))
            scores = (
                F.transform(p, lambda x: F.log(F.greatest(x, F.lit(LEAST))))
                if head != S.SUB_TYPES
                else F.transform(
                    p,
                    lambda x: F.log(
                        F.greatest(x, F.lit(LEAST)) / F.greatest(1 - x, F.lit(LEAST))
                    ),
                )
            )
            result = result.withColumn(f"{head} scores", scores).drop("_p", "_r", "_c")
        return result.drop(FEATURES)

    def _scored_in_blocks(self, df: DataFrame) -> DataFrame:
        """The scores of naive Bayes models of all heads at once. A feature's numbers lie side by side."""
        heads = list(self.models)
        sizes = [self.models[h].numClasses for h in heads]
        table = np.concatenate([m.theta.toArray() for m in self.models.values()]).T.copy()
        constants = np.concatenate([m.pi.toArray() for m in self.models.values()])
        shared = df.sparkSession.sparkContext.broadcast((table, constants))

        @F.arrow_udf(", ".join(f"s{i} array<double>" for i in range(len(heads))))
        def scored(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            table, constants = shared.value
            for indices, values in batches:
                starts = np.asarray(indices.offsets)
                at, weights = np.asarray(indices.flatten()), np.asarray(values.flatten())
                starts = starts - starts[0]
                result = np.tile(constants, (len(indices), 1))
                for first in range(0, len(result), BLOCK):
                    ends = starts[first : first + BLOCK + 1]
                    _add_weighted(result[first : first + BLOCK], table, at, weights, ends)
                    _to_scores(result[first : first + BLOCK], sizes, [h == S.SUB_TYPES for h in heads])
                yield score_lists(result, sizes)

        vector = F.unwrap_udt(F.col(FEATURES))
        work = df.withColumn("_scores", scored.asNondeterministic()(vector["indices"], vector["values"]))
        return work.select(
            *[F.col(S.quoted(c)) for c in df.columns if c not in {f"{h} scores" for h in heads}],
            *[F.col(f"_scores.s{i}").alias(f"{h} scores") for i, h in enumerate(heads)],
        )

    def score_columns(self) -> dict[str, Column]:
        """The score column of each head, as ``decode`` takes them."""
        return {head: F.col(S.quoted(f"{head} scores")) for head in self.models}

    def save(self, path: str) -> None:
        """Write features, models and labels below one directory."""
        self.features.write().overwrite().save(f"{path}/features")
        for i, model in enumerate(self.models.values()):
            model.write().overwrite().save(f"{path}/head_{i}")
        about = {"text_column": self.text_column, "labels": [[h, self.labels[h]] for h in self.models]}
        kinds = [type(m).__name__ for m in self.models.values()]
        write_json(SparkSession.active(), f"{path}/about", {**about, "kinds": kinds})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TextClassifier":
        """What :meth:`save` wrote, from any session."""
        about = read_json(spark, f"{path}/about")
        models = {
            head: LOADED[kind].load(f"{path}/head_{i}")
            for i, ((head, _), kind) in enumerate(zip(about["labels"], about["kinds"], strict=True))
        }
        features = PipelineModel.load(f"{path}/features")
        return cls(about["text_column"], features, models, dict(map(tuple, about["labels"])))


def score_lists(table: np.ndarray, sizes: list[int]) -> pa.Array:
    """A row of numbers each, cut into lists of the given sizes, as structs of them."""
    rows = len(table)
    lists = [
        pa.ListArray.from_arrays(
            pa.array(np.arange(rows + 1, dtype=np.int32) * part.shape[1]), pa.array(np.ascontiguousarray(part).ravel())
        )
        for part in np.split(table, np.cumsum(sizes)[:-1], axis=1)
    ]
    return pa.StructArray.from_arrays(lists, [f"s{i}" for i in range(len(lists))])


def _add_weighted(result: np.ndarray, table: np.ndarray, at: np.ndarray, weights: np.ndarray, starts: np.ndarray):
    """Add to each row of ``result`` its rows of ``table`` times their weights; a row's run of ``at`` and ``weights``
    lies between two of ``starts``. First members of all runs are added side by side, then second ones, and so on."""
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    ends, firsts, part = -sizes[order], starts[:-1][order], result[order]
    for place in range(-int(ends[0])):
        longer = int(np.searchsorted(ends, -place))
        members = firsts[:longer] + place
        part[:longer] += table.take(at[members], 0) * weights[members, None]
    result[order] = part


def _to_scores(rows: np.ndarray, sizes: list[int], independent: list[bool]) -> None:
    """Unscaled log-probabilities become log-probabilities head by head, or log-odds, in place."""
    start = 0
    for size, odds in zip(sizes, independent, strict=True):
        part = rows[:, start : start + size]
        part -= part.max(1, keepdims=True)
        np.exp(part, out=part)
        part /= part.sum(1, keepdims=True)
        against = np.maximum(1 - part, LEAST) if odds else 1
        np.log(np.maximum(part, LEAST) / against, out=part)
        start += size


def _label_indexes(head: str, names: list[str]) -> Column:
    """The indexes of a row's labels: one, or one for each sub-type. A label that is not listed is
    an error; training on the other rows only would go unnoticed."""
    table = {name: float(i) for i, name in enumerate(names)}

    def index(label: Column) -> Column:
        unknown = F.raise_error(
            F.concat(F.lit(f"{head}: label not listed: "), F.coalesce(label, F.lit("null")))
        )
        return F.coalesce(lookup(label, table, "double"), unknown.cast("double"))

    if head != S.SUB_TYPES:
        return F.array(index(F.col(S.quoted(head))))
    none = F.array(F.lit(S.NO_LABEL))
    subs = let(sub_type_target(), lambda found: F.when(F.size(found) > 0, found).otherwise(none))
    return F.transform(subs, index)


def labels_of(index: DataFrame) -> dict[str, list[str]]:
    """Each head's labels in order, from a label index of at most ``MAX_TABLE_ROWS`` rows."""
    rows = index.limit(MAX_TABLE_ROWS + 1).collect()
    if len(rows) > MAX_TABLE_ROWS:
        raise DataError(f"more than {MAX_TABLE_ROWS} labels; use ``bayes`` for such a head")
    labels: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["column"], r["index"])):
        labels.setdefault(row["column"], []).append(row["label"])
    return labels


def evaluate(df: DataFrame, classifier: TextClassifier) -> DataFrame:
    """Metrics per head on labeled rows; sub-types count as predicted at a probability over 1/2.

    Rows are scored once, for the single-label heads and the sub-types together.
    """
    heads = [h for h in classifier.models if h != S.SUB_TYPES]
    scored = classifier.score(df)
    single = F.array(
        *[
            F.struct(
                F.lit(h).alias("head"),
                F.col(S.quoted(h)).alias("label"),
                F.element_at(
                    F.array(*[F.lit(x) for x in classifier.labels[h]]),
                    F.array_position(
                        F.col(S.quoted(f"{h} scores")), F.array_max(S.quoted(f"{h} scores"))
                    ).cast("int"),
                ).alias("pred"),
            )
            for h in heads
        ]
    )
    if S.SUB_TYPES not in classifier.models:
        return head_metrics(confusion(scored.select(F.inline(single))))
    names = F.array(*[F.lit(x) for x in classifier.labels[S.SUB_TYPES]])
    odds = F.col(S.quoted(f"{S.SUB_TYPES} scores"))
    likely = F.transform(odds, lambda x, i: F.when(x > 0, F.get(names, i)))
    guess = F.array_except(F.array_compact(likely), F.array(F.lit(S.NO_LABEL)))
    kept = scored.select(
        single.alias("single"), sub_type_target().alias("truth"), guess.alias("guess")
    ).persist()
    result = multilabel_metrics(kept, "truth", "guess")
    return head_metrics(confusion(kept.select(F.inline("single")))).unionByName(result) if heads else result


def choose(
    candidates: Iterable[tuple[str, TextClassifier]],
    validation: DataFrame,
    metric: str = "basic_type_accuracy",
) -> tuple[str, TextClassifier, DataFrame]:
    """The candidate with the greatest metric, and the metric rows of all.

    Candidates are evaluated one after the other, so that a plan holds one of them."""
    if metric not in CHOICE_METRICS:
        raise DataError(f"metric must be one of {CHOICE_METRICS}, not {metric!r}")
    candidates = dict(candidates)
    rows = None
    for name, classifier in candidates.items():
        row = written(
            mean_metrics(evaluate(validation, classifier)).select(F.lit(name).alias("model"), "*")
        )
        rows = row if rows is None else rows.unionByName(row)
    best = rows.agg(F.max_by("model", metric).alias("best")).first()["best"]
    return best, candidates[best], rows


def prompt_input(df: DataFrame, text_column: str = S.PRODUCT_TYPE) -> DataFrame:
    """Rows with the classifier's text in lower case."""
    return df.withColumn(text_column, text_input(text_column))
