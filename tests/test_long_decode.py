"""Decoding in long form against the decoding in arrays."""

import random

from pyspark.sql import functions as F

from provender import schema as S
from provender.operators import dataset, decode
from provender.operators import long_decode as L
from provender.plans import scores


def text(rows):
    return sorted(tuple("" if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


def test_equal_to_decoding_in_arrays(spark, sf_dir):
    for assertion in (False, True):
        options = {"assertion": assertion, "confidence": True}
        want = decode.decode(scores.vectors(spark, sf_dir), scores.score_columns(), scores.decoder(), **options)
        got = L.decode_long(
            scores.long_scores(spark, sf_dir).repartition(5), **scores.label_tables(spark), id_column="vec_id", **options
        )
        columns = [c for c in want.columns if c != "e"]
        assert set(columns) <= set(got.columns)
        listed = [S.quoted(c) for c in columns]
        assert text(got.select(*listed).collect()) == text(want.select(*listed).collect())


def test_bitmaps_beyond_one_bucket(spark):
    pick = random.Random(2)
    size = 3 * L.BITMAP
    seen = {g: sorted(pick.sample(range(size), 40)) for g in ("a", "b")} | {"c": [0, 7, 8, L.BITMAP - 1, L.BITMAP, size - 1]}
    index = spark.range(size).select(
        F.lit(S.BASIC_TYPE).alias("column"), F.concat(F.lit("t"), "id").alias("label"), F.col("id").cast("int").alias("index")
    )
    masks = spark.createDataFrame(
        [(g, f"t{i}") for g, held in seen.items() for i in held], f"`{S.FPG}` string, `{S.BASIC_TYPE}` string"
    )
    bitmaps = L.mask_bitmaps(masks, index)
    bits = bitmaps.join(index, F.floor(F.col("index") / L.BITMAP) == F.col("bucket"))
    rows = bits.where(L.has_bit(F.col("bits"), F.col("index"))).select("group", "index").collect()
    found = {g: sorted(r["index"] for r in rows if r["group"] == g) for g in seen}
    assert found == seen
    vectors = {r[S.FPG]: [i for i, x in enumerate(r["mask"]) if x] for r in dataset.mask_vectors(masks, index).collect()}
    assert vectors == seen


def test_best_valid_labels_ties_and_empty_masks(spark):
    rows = [(1, 0, 5.0), (1, 1, 9.0), (1, 2, 9.0), (2, 0, 1.0), (2, 1, 2.0), (3, 0, 1.0), (3, 1, 2.0)]
    table = spark.createDataFrame(rows, "id int, index int, score double").withColumn("head", F.lit(S.BASIC_TYPE))
    groups = spark.createDataFrame([(1, "g"), (2, "unseen"), (3, "other")], "id int, group string")
    index = spark.createDataFrame([(S.BASIC_TYPE, f"t{i}", i) for i in range(4)], "column string, label string, index int")
    masks = spark.createDataFrame([("g", "t1"), ("g", "t2"), ("other", "t3")], f"`{S.FPG}` string, `{S.BASIC_TYPE}` string")
    found = L.best_valid(table, groups, L.mask_bitmaps(masks, index), "id").collect()
    assert sorted(map(tuple, found), key=repr) == [(1, 1, 9.0), (2, 1, 2.0), (3, 0, None)]


def test_sums_of_exponentials_on_any_scale(spark):
    import math

    rows = [(1, 0, 1e5), (1, 1, 1e5 + 1), (1, 2, -1e5), (2, 0, 499.9), (2, 1, 500.1), (3, 0, -800.0), (3, 1, -800.0)]
    table = spark.createDataFrame(rows, "id int, index int, score double").withColumn("head", F.lit("h"))
    found = {r["id"]: r for r in L.totals(table, "id").collect()}
    for i, r in found.items():
        held = [s for k, _, s in rows if k == i]
        top = max(held)
        assert math.isclose(r["log_sum"], top + math.log(sum(math.exp(s - top) for s in held)), rel_tol=1e-12)
        assert (r["top"], r["index"]) == (top, held.index(top))


def test_plans_have_no_python_and_no_literal_tables(spark, sf_dir):
    done = L.decode_long(scores.long_scores(spark, sf_dir), **scores.label_tables(spark), id_column="vec_id")
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "WindowGroupLimit" in plan
