"""Model scores derived from the embeddings table, for the decoding queries.

Slices of each vector serve as the raw scores of a head. Group scores lean on the scores of their
categories, so that consistent and contradictory predictions both occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provender import schema as S
from provender.functions.partitions import dealt
from provender.operators.decode import Decoder
from provender.plans.purchases import CASES, read
from provender.rules.fixed_values import HIERARCHY
from provender.rules.ruleset import RuleSet, category_groups

CATEGORIES = sorted(category_groups(HIERARCHY))
GROUPS = sorted(HIERARCHY)
BASIC_TYPES = sorted({case[3].strip().lower() for case in CASES})
#: A vector is over a hundred scores in long form, some 13 KB in a sort, so a task gets this many.
VECTORS_PER_TASK = 10_000
# Labels of the other heads.
PACKAGING = ["None", "canned", "ss"]
FROZEN = ["None", "frozen"]
SUB_TYPE_LABELS = [
    "None", "almond", "apple", "bell", "blend", "blue", "cheddar", "corn", "cut", "flavored",
    "frozen", "fruit", "gala", "greek", "ham", "honeydew", "lamb", "mozzarella", "nut", "oat",
    "onion", "pear", "ss", "sweet", "variety", "wheat",
]
# How often each sub-type was seen in each column. "pear" was never seen.
SUB_TYPE_COUNTS = {
    "Sub-Type 1": {
        "almond": 40, "apple": 31, "blend": 77, "cheddar": 12, "cut": 5, "fruit": 31,
        "greek": 54, "ham": 9, "lamb": 3, "mozzarella": 22, "oat": 15, "sweet": 8, "frozen": 2,
    },
    "Sub-Type 2": {
        "blend": 6, "blue": 4, "corn": 19, "flavored": 33, "gala": 7, "nut": 7, "variety": 1,
        "wheat": 11, "almond": 5,
    },
    "Sub-Type 3": {"bell": 2, "honeydew": 1, "onion": 8, "ss": 3, "apple": 1},
}


def decoder() -> Decoder:
    masks: dict[str, set] = {g: set() for g in GROUPS}
    for group, _, _, base in CASES:
        if group:
            masks[group].add(base.strip().lower())
    return Decoder(
        labels={
            S.FPG: GROUPS,
            S.FPC: CATEGORIES,
            S.PFPC: CATEGORIES,
            S.BASIC_TYPE: BASIC_TYPES,
            "Frozen": FROZEN,
            "Packaging": PACKAGING,
            S.SUB_TYPES: SUB_TYPE_LABELS,
        },
        sub_type_counts=SUB_TYPE_COUNTS,
        masks={g: sorted(m) for g, m in masks.items()},
        tags=tuple(RuleSet.starter().all_tags),
    )


def label_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The decoder's labels, masks, counts and tags as the tables that training gives."""
    known = decoder()
    rows = [(h, label, i) for h, labels in known.labels.items() for i, label in enumerate(labels)]
    return {
        "index": spark.createDataFrame(rows, "column string, label string, index int"),
        "masks": spark.createDataFrame(
            [(g, t) for g, types in known.masks.items() for t in types], f"`{S.FPG}` string, `{S.BASIC_TYPE}` string"
        ),
        "counts": spark.createDataFrame(
            [(c, label, n) for c, table in SUB_TYPE_COUNTS.items() for label, n in table.items()],
            "column string, label string, count long",
        ),
        "tags": spark.createDataFrame([(t,) for t in known.tags], "label string"),
    }


def long_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, head, index, score``: the scores of all heads, a row each."""
    each = F.explode(
        F.array(*[F.struct(F.lit(h).alias("head"), c.alias("scores")) for h, c in score_columns().items()])
    )
    rows = dealt_vectors(spark, sf_dir).select("vec_id", each.alias("s"))
    return rows.select("vec_id", "s.head", F.posexplode("s.scores").alias("index", "score"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")
    )


def dealt_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors by hash of their id, a bounded number a task, for what makes many rows of each.

    Whatever is then grouped by the id stays where it is."""
    rows = vectors(spark, sf_dir)
    return dealt(rows, ["vec_id"], rows.count(), VECTORS_PER_TASK)


def score_columns() -> dict[str, Column]:
    """Raw scores per head from the vector column ``e``."""
    e = F.col("e")
    n = len(CATEGORIES)
    category = F.slice(e, 1, n)
    members = [[CATEGORIES.index(c) for c in HIERARCHY[g]] for g in GROUPS]
    group = F.array(
        *[
            F.greatest(*[e[i] for i in m], F.lit(-1e9)) + e[54 + g] * 0.25
            for g, m in enumerate(members)
        ]
    )
    primary = F.zip_with(category, F.slice(e, n + 1, n), lambda a, b: a + b * 0.5)
    return {
        S.FPG: group,
        S.FPC: category,
        S.PFPC: primary,
        S.BASIC_TYPE: F.slice(e, 5, len(BASIC_TYPES)),
        "Frozen": F.slice(e, 60, 2),
        "Packaging": F.slice(e, 10, 3),
        S.SUB_TYPES: F.slice(e, 20, len(SUB_TYPE_LABELS)),
    }
