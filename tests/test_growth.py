"""What a task holds does not grow with the table, and wide projections are compiled."""

from pyspark.sql import functions as F

from provender import schema as S
from provender.functions.partitions import dealt
from provender.operators import clean, corrections, dataset
from provender.plans import queries as Q
from provender.plans import scores

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def test_dealt_bounds_the_rows_of_a_task(spark):
    rows = spark.range(20_000).withColumn("k", F.lit("one"))
    cores = spark.sparkContext.defaultParallelism
    parts = dealt(rows, ["id", "k"], 20_000, 20_000 // (4 * cores))
    sizes = [r["n"] for r in parts.groupBy(F.spark_partition_id()).agg(F.count("id").alias("n")).collect()]
    assert sum(sizes) == 20_000 and len(sizes) >= 4 * cores and max(sizes) < 20_000 / cores
    assert dealt(rows, ["id"], 20_000) is rows


def test_cleaning_strips_once_a_row(spark):
    row = ("1", "o", " \xa0beef, cut ", "beef", "Meat", "Beef", "Beef")
    rows = spark.createDataFrame([row], [*S.ID_COLUMNS, *S.GROUP_COLUMNS])
    loaded = rows.withColumn(S.PRODUCT_TYPE, F.coalesce(F.reverse(F.reverse(S.quoted(S.PRODUCT_TYPE))), F.lit("x")))
    done = clean.clean_rows(loaded)
    assert done.first()[S.PRODUCT_TYPE] == "beef, cut"
    assert done._jdf.queryExecution().optimizedPlan().toString().count("trim(") == 1


def test_wide_projections_are_compiled(spark, sf_dir):
    spark.conf.unset(LIMIT)
    index = spark.createDataFrame([("a", "x", 0), ("a", S.NO_LABEL, 1)], "column string, label string, index int")
    rows = spark.createDataFrame([("x",), (S.NO_LABEL,), ("y",), (None,)], "a string")
    found = dataset.encode_labels(rows, index, ["a"]).select("a", "a_index").collect()
    assert dict(map(tuple, found)) == {"x": 0, S.NO_LABEL: 1, "y": None, None: None}
    assert int(spark.conf.get(LIMIT)) == 8000
    spark.conf.unset(LIMIT)
    Q.normalized(spark, sf_dir)
    assert int(spark.conf.get(LIMIT)) == 8000


def test_only_columns_of_the_result_are_kept(spark, sf_dir):
    kept = Q.kept_labels(spark, sf_dir, S.ROW_ID)
    assert kept.columns == [S.ROW_ID, *S.LABELS] and kept.is_cached
    rows = Q._for_sorting(spark, sf_dir, [S.PRODUCT_NAME, S.NORMALIZED_NAME, S.PRODUCT_NAME])
    assert rows.columns == [S.ROW_ID, S.PRODUCT_NAME, S.NORMALIZED_NAME] and rows.is_cached
    spark.catalog.clearCache()


def test_long_scores_are_dealt_by_vector_and_stay(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(scores, "VECTORS_PER_TASK", 20)
    rows = scores.long_scores(spark, sf_dir)
    count = scores.vectors(spark, sf_dir).count()
    sizes = rows.groupBy(F.spark_partition_id()).agg(F.countDistinct("vec_id").alias("n")).collect()
    assert sum(r["n"] for r in sizes) == count and max(r["n"] for r in sizes) < 60
    plan = rows.groupBy("vec_id", "head").agg(F.max("score"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_chains_with_one_end_do_not_gather_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(corrections, "ROWS_PER_TASK", 100)
    key = F.col("id") + 1
    pairs = spark.range(2000).select(
        F.concat(F.lit("w"), key).alias("raw"), F.concat(F.lit("w"), F.floor(key / 2)).alias("clean")
    )
    done = corrections.closed(pairs)
    assert done.count() == 2000 and done.where("clean <> 'w0'").isEmpty()
    sizes = done.groupBy(F.spark_partition_id()).agg(F.count("raw").alias("n")).collect()
    assert max(r["n"] for r in sizes) < 200
