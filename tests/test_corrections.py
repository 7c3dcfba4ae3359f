"""Corrections of any size against the literal lookup and a walk along each chain."""

import random

import pytest
from pyspark.sql import functions as F

from provender import schema as S
from provender.errors import RuleError
from provender.operators import corrections as C
from provender.operators import normalize as N
from provender.plans import jobs
from provender.rules import ruleset
from provender.rules.ruleset import RuleSet, close_corrections

DDL = "raw string, clean string"


def table(spark, pairs):
    return spark.createDataFrame(list(pairs), DDL)


def test_chains_are_followed_to_their_ends(spark):
    pick = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    pairs = {w: pick.choice(words[i + 1 :] + [f"end{i % 7}"] * 40) for i, w in enumerate(words)}
    pairs |= {f"long {i}": f"long {i + 1}" for i in range(130)}
    found = dict(map(tuple, C.closed(table(spark, pairs.items())).collect()))
    assert found == close_corrections(pairs)


@pytest.mark.parametrize("size", [1, 2, 3, 8, 13])
def test_cycles_are_errors(spark, size):
    cycle = [(f"c{i}", f"c{(i + 1) % size}") for i in range(size)]
    with pytest.raises(RuleError, match="cycle"):
        C.closed(table(spark, [("in", "c0"), ("a", "b"), *cycle]))


def test_words_with_two_corrections_nulls_and_repeats(spark):
    with pytest.raises(RuleError, match="two corrections"):
        C.closed(table(spark, [("a", "b"), ("a", "c")]))
    rows = [("a", "b"), ("a", "b"), (None, "x"), ("y", None)]
    assert C.closed(table(spark, rows)).collect() == [("a", "b")]
    assert C.closed(table(spark, [])).collect() == []


def test_the_filter_lets_every_word_through_and_few_others(spark):
    words = spark.range(20_000).select(F.concat(F.lit("w"), F.col("id")).alias("raw"))
    test = C.may_hold(words, "raw")
    assert words.where(~test(F.col("raw"))).count() == 0
    others = spark.range(20_000).select(F.concat(F.lit("x"), F.col("id")).alias("t"))
    assert others.where(test(F.col("t"))).count() < 1000
    none = C.may_hold(words.limit(0), "raw")
    assert words.where(none(F.col("raw"))).count() == 0


def test_hot_words_are_not_shuffled_to_one_task(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), "id")).alias("token"), "id")
    words = table(spark, [("hot", "HOT"), ("w1", "W1"), ("none", "N")])
    found = C.by_word(rows, words)
    assert found.count() == 1001
    assert found.groupBy("clean").count().collect()
    plan = found._jdf.queryExecution().toString()
    assert "LeftAnti" in plan


def names(make_rows):
    texts = ["apple, grn , red", "GRN,,grn", "", None, "plain", "a chain, x1", "x2", " pear ,grn,x3"]
    return make_rows([("Produce", "Fruit", "Fruit", f"T{i}", t) for i, t in enumerate(texts)])


def test_tokens_and_names_by_both_ways(spark, make_rows):
    pairs = {"grn": "green", "x1": "x2", "x2": "x3", "x3": "apple", "plain": "cheese"}
    rules = RuleSet.build(corrections=pairs)
    rows = names(make_rows)
    resolved = C.with_tokens(rows, "row_id", S.PRODUCT_NAME, C.closed(table(spark, pairs.items())))
    want = rows.select("row_id", N.split_tokens(F.col(S.quoted(S.PRODUCT_NAME)), rules).alias("tokens"))
    assert sorted(map(tuple, resolved.select("row_id", "tokens").collect())) == sorted(map(tuple, want.collect()))
    without = RuleSet.build(corrections={})
    direct = {r["row_id"]: r for r in N.normalize(rows, rules).collect()}
    joined = N.normalize(resolved, without, tokens="tokens").collect()
    assert len(joined) == len(direct) and all(direct[r["row_id"]] == r for r in joined)
    with pytest.raises(RuleError):
        N.normalize(resolved, without, tokens="tokens", distinct_first=True)


def test_ids_may_repeat(spark):
    rows = spark.createDataFrame([(1, "a,b"), (1, "a,b"), (1, "b"), (None, "a"), (2, None)], "id int, name string")
    done = C.with_tokens(rows, "id", "name", table(spark, [("a", "x"), ("b", "y")]))
    found = sorted(((r["id"], r["tokens"]) for r in done.collect()), key=repr)
    assert found == [(1, ["x", "y"]), (1, ["x", "y"]), (1, ["y"]), (2, None), (None, ["x"])]


def test_plans_do_not_grow_with_the_table(spark, make_rows):
    def size(pairs):
        done = C.with_tokens(names(make_rows), "row_id", S.PRODUCT_NAME, C.closed(table(spark, pairs)))
        return len(done._jdf.queryExecution().analyzed().toString())

    small = size([("a", "b")] * 5)
    assert abs(size([(f"a{i}", "b") for i in range(5000)]) - small) < small / 10


def test_jobs_take_packs_beyond_the_literal_bound(spark, tmp_path, monkeypatch):
    pack = str(tmp_path / "pack")
    RuleSet.build(corrections={"grn": "green", "x1": "x2", "x2": "apple"}).to_directory(spark, pack)
    raw = tmp_path / "raw"
    raw.mkdir()
    header = [S.PRODUCT_TYPE, S.PRODUCT_NAME, S.FPG, S.FPC, S.PFPC]
    lines = [",".join(header)] + [f'type{i},"x1, grn, {i}",Produce,Fruit,Fruit' for i in range(5)]
    (raw / "f.csv").write_text("\n".join(lines))

    def exported(folder):
        options = jobs.CleaningOptions("f.csv", str(raw), str(tmp_path / folder), rule_pack=pack, run_folder="run")
        paths = jobs.run_cleaning(spark, options)
        return sorted(map(tuple, spark.read.option("header", True).csv(paths["normalized"]).collect()))

    direct = exported("one")
    assert jobs.large_corrections(spark, pack) is None
    monkeypatch.setattr(jobs, "MAX_TABLE_ROWS", 2)
    assert jobs.large_corrections(spark, pack).count() == 3
    monkeypatch.setattr(ruleset, "MAX_TABLE_ROWS", 20_000)
    assert exported("two") == direct
    assert any("apple" in row for row in direct)
