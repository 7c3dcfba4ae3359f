"""Tasks by number of rows, written rows in place of cached ones, and the plain ways that most rows take."""

import time

from pyspark.sql import functions as F

from provender.functions import expressions
from provender.operators import normalize as N
from provender.plans import queries as Q


def test_strip_collapse_and_repeats_keep_their_results(spark, rules):
    texts = ["", " ", "a", " a", "a ", "\xa0a b　", "é", "a\x1f", "\x7fa\x7f", "~", "!", None, " \t\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(expressions.strip(F.col("t")))
    assert [r[0] for r in got.collect()] == [t if t is None else t.strip() for t in texts]
    lists = [["a", None, "a", "b", None], ["a", "b", None], [None, None], [], None, ["a", "a"]]
    df = spark.createDataFrame([(x,) for x in lists], "x array<string>")
    want = [["a", None, None, "b", None], ["a", "b", None], [None, None], [], None, ["a", None]]
    assert [r[0] for r in df.select(N.without_repeats(F.col("x"))).collect()] == want
    kinds = spark.createDataFrame([(["blend", "x", "x"],), (["x", "variety", "y", "blend"],)], "x array<string>")
    found = kinds.select(N.collapse_subtypes(F.col("x"), F.lit("Meat"), rules)).collect()
    assert [r[0] for r in found] == [["blend", "x"], ["variety", "blend", "x", "y"]]


def test_values_without_repeats_are_told_apart_quickly(spark):
    """Looking for the place of each of 17 values took several times as long as comparing two counts."""
    values = F.array(*[F.concat(F.lit(f"v{i}-"), F.col("id").cast("string")) for i in range(17)])
    rows = spark.range(300_000, numPartitions=4).select(values.alias("v"))

    def seconds(column):
        took = []
        for _ in range(3):
            start = time.perf_counter()
            rows.select(column).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        return min(took)

    places = F.transform("v", lambda x, i: F.when(F.array_position("v", x) == i + 1, x))
    assert seconds(N.without_repeats(F.col("v"))) < 0.8 * seconds(places)
