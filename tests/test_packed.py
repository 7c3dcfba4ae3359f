"""Reports that are sorted carry little over the disks, and what several readers share is kept by columns."""

import re
from pathlib import Path

from pyspark.sql import functions as F

from provender import schema as S
from provender.functions import shared
from provender.operators import clean, report
from provender.operators import normalize as N
from provender.plans import queries as Q

ODD = ["", " ", None, 'a "quoted", text', "line\nbreak\r", "\x00\x1f\\", "ü 😀", "null", "{}", "[]", "\\N"]


def odd_rows(spark):
    rows = []
    for i in range(200):
        values = [ODD[(i * 7 + j * j) % len(ODD)] for j in range(len(S.EXPORT_COLUMNS))]
        misc = [None, [], [x for x in ODD if x is not None], ["a", None]][i % 4]
        rows.append((f"{i:05}", *values, misc, i))
    ddl = "row_id string, " + ", ".join(f"`{c}` string" for c in S.EXPORT_COLUMNS) + ", Misc array<string>, n int"
    return spark.createDataFrame(rows, ddl).repartition(5)


def test_odd_text_comes_through_a_sort(spark):
    df = odd_rows(spark)
    for names, shown in (
        (report.EXPORT_SORT, [*S.EXPORT_COLUMNS, "n"]),
        (report.MISC_SORT, S.MISC_EXPORT_COLUMNS),
        (["n"], [*S.EXPORT_COLUMNS, S.MISC]),
    ):
        order = [F.col(S.quoted(c)).asc_nulls_last() for c in [*names, S.ROW_ID]]
        want = df.orderBy(*order).select(*[S.quoted(c) for c in shown])
        got = report._sorted(df, names, shown)
        assert got.dtypes == want.dtypes
        assert got.collect() == want.collect()


def test_a_sort_sends_its_keys_and_one_value(spark):
    """All 23 columns went over the disks, each with a place of its own."""
    plan = report.normalized_export(odd_rows(spark))._jdf.queryExecution().executedPlan().toString()
    sort = plan.splitlines()
    below = next(sort[i + 1 :] for i, line in enumerate(sort) if "rangepartitioning" in line)
    assert "Project" in below[0] and below[0].count(" AS ") == 1 and below[0].rstrip().endswith("]")
    assert re.search(r" AS _packed#\d+\]$", below[0].rstrip())
    # It is taken apart above the sort, once a row.
    assert plan.count("from_json") == 1 and plan.index("from_json") < plan.index("rangepartitioning")


def test_rows_by_columns_are_few_bytes_and_go(spark, sf_dir):
    df = Q.normalized(spark, sf_dir).select(*[S.quoted(c) for c in [S.ROW_ID, *S.EXPORT_COLUMNS]])
    with shared.in_columns(df, "rows") as rows:
        place = Path(re.sub("^file:", "", rows.inputFiles()[0])).parent
        assert rows.exceptAll(df).isEmpty() and rows.count() == df.count()
        size = sum(f.stat().st_size for f in place.iterdir())
        assert size < 100 * rows.count()
    assert not place.exists()


def test_the_written_export_caches_nothing(spark, sf_dir):
    """Cached rows went to disk, beside what was sorted, when memory was short."""
    spark.catalog.clearCache()
    seen = []
    manager = spark._jsc.sc()
    write = Q.writers.write_table
    try:
        Q.writers.write_table = lambda df, path, **o: (seen.append(manager.getPersistentRDDs().size()), write(df, path, **o))[1]
        done = Q.q_written_export(spark, sf_dir)
    finally:
        Q.writers.write_table = write
    assert seen == [0, 0]
    folder = Path(re.sub("^file:", "", shared.shared_folder(spark)))
    assert not list(folder.glob("rows-*"))
    assert done.count() == Q.q_normalized_export(spark, sf_dir).count()
    spark.catalog.clearCache()


def test_distinct_rows_are_found_by_digest(spark, make_rows):
    """Rows were joined on five columns of text, and sent all of them beside the thirty of the result."""
    odd = [f"{x}abc, cut" for x in ODD if x is not None]
    rows = [(g, c, c, p, n) for i, n in enumerate(odd) for p in odd[i:] for g, c in (("Produce", "Fruit"), (None, None))]
    # Equal but for where a null stands, and where one column ends and the next begins.
    rows += [(None, "a", "b", "apple", "red"), ("a", None, "b", "apple", "red"), ("a", "b", None, "applered", "")] * 3
    df = make_rows(rows)
    direct, distinct = N.normalize(df), N.normalize(df, distinct_first=True)
    plan = distinct._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = [line for line in plan if re.search(r"(SortMerge|Hash)Join ", line)]
    assert len(joins) == 1 and re.search(r"\[_digest#\d+\], \[_digest#\d+\]", joins[0])
    keys = [re.search(r"hashpartitioning\((\w+)", line).group(1) for line in plan if "hashpartitioning(" in line]
    assert sorted(keys) == ["_digest", "_digest", "_packed"]
    assert distinct.dtypes == direct.dtypes
    key = lambda row: row[S.ROW_ID]
    assert sorted(distinct.collect(), key=key) == sorted(direct.collect(), key=key)


def test_filters_look_through_white_space(spark):
    space, placeholder = "\t\xa0 　\n", clean.EXCLUDED_PRODUCT_TYPE
    texts = [f"{a}{t}{b}" for t in ["", "ab", "abc", "a c", "a\nc", "é🙂z", "🙂🙂", placeholder, f"{placeholder} x", f"x {placeholder}", placeholder * 2]
             for a in ("", space) for b in ("", space)]
    rows = [(str(i), "o", t, "name", "Meat", "Beef", "Beef") for i, t in enumerate([*texts, None])]
    df = spark.createDataFrame(rows, [*S.ID_COLUMNS, *S.GROUP_COLUMNS])
    for least in (0, 1, 2, 3, 4):
        got = {r["Unique Id"]: r[S.PRODUCT_TYPE] for r in clean.clean_rows(df, min_length=least).collect()}
        want = {str(i): t.strip() for i, t in enumerate(texts) if len(t.strip()) >= least and t.strip() != placeholder}
        assert got == want


def test_the_fold_walks_no_lists_of_branches(rules):
    """Uncompiled, ``F.when`` finds a branch by walking a list; a token's step held dozens of them."""
    state = str(N.row_state(rules)._jc)
    assert state.count("CASE WHEN") + state.count("when(") < 12
