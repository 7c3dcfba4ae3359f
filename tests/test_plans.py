"""Plans stay narrow and inside the JVM; results do not depend on how rows are laid out."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provender import schema as S
from provender.operators import dataset, report
from provender.operators.clean import clean_rows
from provender.operators.normalize import normalize
from provender.plans import purchases
from provender.plans.queries import QUERIES

import __spark_entry__ as contract


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_normalization_is_one_narrow_stage(make_rows):
    plan = _plan(normalize(clean_rows(make_rows([("Produce", "Fruit", "Fruit", "APPLE", "apple")]))))
    assert "Exchange" not in plan and "Join" not in plan
    assert plan.count("Generate") == 2


def test_filters_do_not_repeat_the_fold(make_rows):
    rows = normalize(clean_rows(make_rows([("Produce", "Fruit", "Fruit", "APPLE", "apple")])))
    plan = _plan(report.misc_overflow(rows, ordered=False))
    assert plan.count("Generate") == 2
    filters = [line for line in plan.splitlines() if re.match(r"[\s*()\d:+-]*Filter", line)]
    assert all("aggregate(" not in line for line in filters)


@pytest.mark.parametrize("name", ["normalize_names", "value_counts", "token_clean", "decoders"])
def test_no_python_in_plans(spark, sf_dir, name):
    plan = _plan(QUERIES[name](spark, sf_dir))
    assert "Python" not in plan and "Pandas" not in plan and "ArrowEval" not in plan


def test_scan_reads_only_the_keys(spark, sf_dir):
    plan = _plan(purchases.raw_purchases(spark, sf_dir))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    line = next(s for s in schemas if "l_orderkey" in s)
    assert set(c.split(":")[0] for c in line.split(",")) == set(purchases.LINE_KEYS)


def test_keep_first_is_a_partial_aggregation(spark):
    rows = spark.createDataFrame([(0, 1, "a")], "file_no int, row_id long, `Product Type` string")
    plan = _plan(dataset.keep_first(rows))
    assert "partial_min_by" in plan and "Window" not in plan


def test_every_query_but_the_classifiers_has_sql():
    missing = set(QUERIES) - set(contract.oracle_sql())
    assert missing == {"text_classifier", "category_classifier", "joint_classifier"}
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["head_metrics", "mean_metrics", "multilabel_metrics"])
def test_metrics_read_their_input_once(spark, sf_dir, name):
    plan = _plan(QUERIES[name](spark, sf_dir))
    assert len(re.findall(r"Scan parquet", plan.split("(1)")[0])) <= 4
    assert plan.count("lineitem.parquet") == 1 and "NestedLoop" not in plan


def test_multi_hot_is_narrow(spark, sf_dir):
    plan = _plan(QUERIES["multi_hot"](spark, sf_dir))
    assert "SortMergeJoin" not in plan and "Expand" not in plan


WORDS = st.sampled_from(
    ["apple", "cut", "sliced", "ss", "cheddar", "swiss", "popper", "bar", "ham", "gherkin", "blend",
     "corn pops", "", " frozen", "pear", "dried", "vanilla", "steak", "smoked", "new word"]
)
NAMES = st.lists(WORDS, min_size=1, max_size=7).map(",".join)
CATEGORY = st.sampled_from(
    [("Produce", "Fruit"), ("Meat", "Beef"), ("Meals", "Meals"), ("Milk & Dairy", "Cheese"),
     ("Condiments & Snacks", "Condiments & Snacks"), (None, None)]
)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(CATEGORY, NAMES), min_size=20, max_size=60))
def test_layout_does_not_matter(make_rows, drawn):
    rows = make_rows([(g, c, c, "TYPE", name) for (g, c), name in drawn]).persist()
    shown = ["row_id", *[S.quoted(c) for c in S.NORMALIZED_COLUMNS], S.quoted(S.SUB_TYPES), S.MISC]
    direct = {r["row_id"]: r for r in normalize(rows).select(*shown).collect()}
    shuffled = normalize(rows.repartition(3, F.rand(1))).select(*shown).collect()
    distinct = normalize(rows, distinct_first=True).select(*shown).collect()
    rows.unpersist()
    assert {r["row_id"]: r for r in shuffled} == direct
    assert {r["row_id"]: r for r in distinct} == direct
    for row in direct.values():
        values = [row[c] for c in S.NORMALIZED_COLUMNS if row[c] is not None]
        assert len(values) == len(set(values))
        assert len(row[S.SUB_TYPES]) == len(set(row[S.SUB_TYPES]))
        assert row[S.MISC] == row[S.SUB_TYPES][3:]


def test_a_hot_key_changes_nothing(make_rows):
    """A third of all rows under one text."""
    rows = [("Produce", "Fruit", "Fruit", f"TYPE {i}", f"apple, word {i}") for i in range(200)]
    rows += [("Produce", "Fruit", "Fruit", "TYPE HOT", "apple, hot")] * 100
    df = normalize(make_rows(rows).withColumn("file_no", F.lit(0)))
    counts = {(r["column"], r["value"]): r["count"] for r in report.value_counts(df).collect()}
    assert counts[("Sub-Types", "hot")] == 100 and counts[(S.BASIC_TYPE, "apple")] == 300
    assert dataset.keep_first(df).count() == 201
