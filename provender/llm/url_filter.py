"""URL filtering: listed rules first, gradient-boosted trees on lexical features for the rest.

The trees are trained on the URLs that a rule judges. Everything is DataFrame functions and the
distributed tree learner that comes with Spark.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled URLs to train on, about; chosen by hash.
TRAIN_URLS = 200_000
#: Suffixes up to this number are broadcast with their statistics.
BROADCAST_SUFFIXES = 100_000
#: Labelled URLs that the overall rate counts for in a suffix's rate.
PRIOR = 20.0
TREES, DEPTH, SEED = 20, 4, 42


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a host, and from the first slash a path; hosts below it are meant too."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]

    def fits(self, host: Column, path: Column) -> Column:
        on_host = (host == self.host) | host.endswith("." + self.host)
        return on_host & path.startswith(self.path)


RULES = [
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
]


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)
    lowered = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lowered, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: list[Rule], host: Column, path: Column, value: str) -> Column:
    """The pattern or verdict of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.pattern)):
        result = rule.pattern if value == "rule" else rule.verdict
        found = F.when(rule.fits(host, path), F.lit(result)).otherwise(found)
    return found


FEATURES = [
    "length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "other_ratio",
    "hyphens", "entropy", "parameters", "parameter_length", "has_fragment", "secure",
    "suffix_rate", "suffix_known",
]


def with_features(df: DataFrame) -> DataFrame:
    """Lexical features of ``url, host, path``; missing URLs are empty ones."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    length = F.length(url)
    share = F.greatest(length, F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    # Entropy of the characters: each one that occurs is counted by what its removal leaves.
    entropy = F.aggregate(
        F.array_distinct(F.split(url, "")),
        F.lit(0.0),
        lambda sum_, c: sum_
        + F.when(c == "", 0.0).otherwise(_surprise((length - F.length(F.replace(url, c, F.lit("")))) / share)),
    )
    return df.select(
        "*",
        length.cast("double").alias("length"),
        F.length(host).cast("double").alias("host_length"),
        F.length(path).cast("double").alias("path_length"),
        F.size(F.filter(F.split(path, "/"), lambda p: p != "")).cast("double").alias("depth"),
        F.size(F.split(host, r"\.")).cast("double").alias("host_labels"),
        (F.length(F.regexp_replace(url, "[^0-9]", "")) / share).alias("digit_ratio"),
        (F.length(F.regexp_replace(url, "[A-Za-z0-9]", "")) / share).alias("other_ratio"),
        F.length(F.regexp_replace(host, "[^-]", "")).cast("double").alias("hyphens"),
        entropy.alias("entropy"),
        F.size(F.filter(F.split(query, "[&;]"), lambda p: p != "")).cast("double").alias("parameters"),
        F.length(query).cast("double").alias("parameter_length"),
        F.contains(url, F.lit("#")).cast("double").alias("has_fragment"),
        F.startswith(F.lower(F.substring(url, 1, 6)), F.lit("https:")).cast("double").alias("secure"),
        F.substring_index(host, ".", -1).alias("suffix"),
    )


def _surprise(share: Column) -> Column:
    return F.when(share > 0, -share * F.log2(share)).otherwise(0.0)


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """``suffix, suffix_rate, suffix_known``: the smoothed share of blocked URLs, and the logarithm
    of their number, over all labelled URLs."""
    overall = labelled.agg(F.avg("label")).first()[0] or 0.0
    n, blocked = F.count(F.lit(1)), F.sum("label")
    return labelled.groupBy("suffix").agg(
        ((blocked + overall * PRIOR) / (n + PRIOR)).alias("suffix_rate"), F.log1p(n).alias("suffix_known")
    )


def _with_suffixes(df: DataFrame, known: DataFrame, small: bool, overall: float) -> DataFrame:
    return df.join(F.broadcast(known) if small else known, "suffix", "left").fillna(
        {"suffix_rate": overall, "suffix_known": 0.0}
    )


def judge(
    df: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """``id, host, path, rule, verdict``, a row for each row of ``df``.

    A null URL or one without "://" has an empty host and path and is judged by its features. If
    the labelled URLs are all of one kind, so is every verdict of the method; without any it is
    "allow". Null ids and repeated rows stay, other columns are not looked at, and an empty table
    gives no rows. Suffix statistics cover all labelled URLs; the trees are fitted on about
    ``TRAIN_URLS`` of them, whose features are the only thing that is exchanged.
    """
    rules = RULES if rules is None else rules
    url = F.col(url_col).cast("string")
    parsed = df.select(
        F.col(id_col).alias("_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path")
    )
    parsed = parsed.select(
        "*",
        longest_rule(rules, F.col("host"), F.col("path"), "rule").alias("rule"),
        longest_rule(rules, F.col("host"), F.col("path"), "verdict").alias("listed"),
    )
    label = (F.col("listed") == "block").cast("double")
    suffix = F.substring_index("host", ".", -1).alias("suffix")
    labelled = parsed.where("listed is not null").select(suffix, label.alias("label"))
    sizes = labelled.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("b")).first()
    n, blocked = sizes["n"], sizes["b"]
    if blocked in (0, n):
        verdict = F.coalesce("listed", F.lit("block" if n and blocked else "allow"))
        return parsed.select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))

    known = suffix_statistics(labelled)
    small, overall = known.count() <= BROADCAST_SUFFIXES, blocked / n
    point = F.pmod(F.xxhash64("url", F.lit(SEED)), F.lit(1 << 30).cast("long")) / float(1 << 30)
    sample = parsed.where(F.col("listed").isNotNull() & (point < TRAIN_URLS / n))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    training = assembler.transform(
        _with_suffixes(with_features(sample).withColumn("label", label), known, small, overall)
    ).select("features", "label")
    # The sample has a bounded size, so it does not need as many partitions as the input.
    training = training.repartition(max(1, min(8, int(n) // 25_000)))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
    model = trees.fit(training)

    scored = model.transform(assembler.transform(_with_suffixes(with_features(parsed), known, small, overall)))
    predicted = F.when(F.col("prediction") == 1, "block").otherwise("allow")
    return scored.select(
        F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("listed", predicted).alias("verdict")
    )
