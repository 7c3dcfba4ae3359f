import duckdb
import pytest

from provender.llm import mixing as M

ROWS = [(i, f"t{i}", "en", "big" if i % 3 else "small" if i % 2 else None, 3) for i in range(900)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_same_as_sql(frame):
    rows = [*ROWS, (1, "other", "en", "big", 1), (1, "other", "en", "big", 1), (None, None, None, "rare", None)]
    got = M.mix(frame(rows, SCHEMA)).toPandas()
    import pandas as pd

    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"})
    want = duckdb.sql(M.mix_sql("documents", list(documents.columns))).df()
    key = ["shuffle_key", "text"]
    left = got.sort_values(key).reset_index(drop=True)[["doc_id", "copy_no", *key]].astype(str)
    right = want.sort_values(key).reset_index(drop=True)[["doc_id", "copy_no", *key]].astype(str)
    left["doc_id"] = left["doc_id"].str.replace(".0", "")
    right["doc_id"] = right["doc_id"].str.replace(".0", "").str.replace("<NA>", "nan")
    left["doc_id"] = left["doc_id"].str.replace("<NA>", "nan")
    assert left.replace("None", "nan").equals(right.replace("None", "nan").replace("<NA>", "nan"))


def test_rates_are_met(frame):
    weights = {"big": 1.0, "small": 3.0, None: 0.0}
    counts = {r["source"]: r["count"] for r in M.mix(frame(ROWS, SCHEMA), weights=weights, total=60_000).groupBy("source").count().collect()}
    assert set(counts) == {"big", "small"}
    assert counts["big"] == pytest.approx(15_000, rel=0.05)
    assert counts["small"] == pytest.approx(45_000, rel=0.05)


def test_draws_are_poisson(frame, spark):
    from pyspark.sql import functions as F

    draws = spark.range(20_000).select(M.poisson_at(M.hashed_point("s", F.col("id").cast("string")), F.lit(3.0)).alias("k"))
    row = draws.agg(F.avg("k"), F.variance("k")).first()
    assert row[0] == pytest.approx(3, rel=0.03) and row[1] == pytest.approx(3, rel=0.05)


def test_odd_tables(frame):
    df = frame(ROWS, SCHEMA)
    assert M.mix(df.limit(0)).collect() == []
    assert M.mix(df, weights={"absent": 1.0}).collect() == []
    clash = frame([(1, "a", 5)], "doc_id long, source string, copy_no int")
    assert M.mix(clash).columns == ["doc_id", "source", "copy_no", "shuffle_key"]


def test_large_source_tables_are_joined(frame, monkeypatch):
    df = frame(ROWS, SCHEMA)
    want = sorted(map(str, M.mix(df).collect()))
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, M.mix(df).collect())) == want


def test_names_inside_do_not_clash(spark, frame):
    plain = frame([(i, "t", "s") for i in range(60)], "doc_id long, text string, source string")
    odd = plain.selectExpr("*", "'a' AS _source", "'b' AS _rate", "7 AS _copies", "8 AS Copy_No", "'x' AS shuffle_key")
    mixed = M.mix(odd).collect()
    assert {(r["_source"], r["_rate"], r["_copies"]) for r in mixed} == {("a", "b", 7)}
    want = {(r["doc_id"], r["copy_no"]) for r in M.mix(plain).collect()}
    assert {(r["doc_id"], r["copy_no"]) for r in mixed} == want
