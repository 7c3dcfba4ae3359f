"""Lexical search against scores of every document by the definition."""

import math
import random
import re

import pytest

from provender.llm import lexical, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def by_definition(items, docs, k=10):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, length = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    weight = {x: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for x, d in df.items()}
    rows = []
    for item, text in dict.fromkeys(items):
        scores = []
        for doc, t in held:
            m = 10 + 90 * len(t) * n_docs // length
            tf = {x: t.count(x) for x in set(terms(text)) & set(t)}
            score = sum(weight[x] * (10**9 * f // (1000 * f + 8 * m)) for x, f in tf.items())
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        rows += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return rows


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(lexical, "SHARD", 8)
    monkeypatch.setattr(lexical, "STRATUM", 3)
    monkeypatch.setattr(lexical, "FIRST", 5)


def made_up(seed, size):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Über", "X9", "ñ_o"]
    docs = [(i, " ".join(pick.choices(words, k=pick.choice([0, 1, 3, 3, 3, 9])))) for i in range(size)]
    docs += [(1000 + i, "hot words stand here, hot") for i in range(60)]
    items = [(f"i{i}", " ".join(pick.choices([*words, "hot", "here", "none"], k=pick.randint(0, 4)))) for i in range(9)]
    return items, docs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_the_definition(spark, frame, small_shards, seed):
    items, docs = made_up(seed, 150)
    found = lexical.search(frame(items, "item_id string, text string"), frame(docs, "doc_id long, text string").repartition(5), 4)
    assert listed(found) == sorted(by_definition(items, docs, 4), key=repr)


def test_rounds_of_items(spark, frame, small_shards, monkeypatch):
    monkeypatch.setattr(lexical, "TERMS", 4)
    items, docs = made_up(3, 60)
    found = lexical.search(frame(items, "item_id string, text string"), frame(docs, "doc_id long, text string"))
    assert listed(found) == sorted(by_definition(items, docs), key=repr)


def test_whole_tables(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert listed(queries.op13_lexical_search(spark, SF)) == sorted(by_definition(items, docs), key=repr)


def test_strata_are_left_out_on_proof(spark):
    """Searching with a bound visits fewer strata and finds the same."""
    import numpy as np

    pick = np.random.default_rng(1)
    sizes = pick.integers(1, 6, 300)
    m = pick.integers(10, 90, 300)
    held = np.concatenate([pick.choice(40, s, replace=False) for s in sizes])
    shard = lexical.Shard(m, sizes, held, pick.integers(1, 5, len(held)))
    visited = []

    class Watched(list):
        def __getitem__(self, at):
            visited.append(at)
            return super().__getitem__(at)

    strata, shard.strata = shard.strata, Watched(shard.strata)
    asked, weights, order = np.array([1, 5, 9]), np.array([3, 5, 7]), np.arange(300)
    rows, scores = shard.search(asked, weights, 5, 0, order)
    first, visited[:] = len(visited), []
    assert 0 < first < len(strata)
    again, same = shard.search(asked, weights, 5, int(scores.min()), order)
    assert sorted(zip(again, same, strict=True)) == sorted(zip(rows, scores, strict=True))
    assert len(visited) <= first


def test_edges(spark, frame):
    items = [("a", "Twice x"), ("a", "Twice x"), ("a", "other"), (None, "x"), ("b", None), ("c", "..."), ("d", "unknown")]
    docs = [(1, "twice x"), (1, "twice x"), (None, "x twice"), (2, None), (3, ""), (4, "other " * 5000), (5, "x")]
    ddl = "doc_id long, text string, item_id string, score int, m int"
    table = frame([(*d, "z", 1, 2) for d in docs], ddl)
    asked = frame([(*i, 3, 1) for i in items], "item_id string, text string, doc_id int, rank int")
    found = lexical.search(asked, table)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert listed(found) == sorted(by_definition(items, docs), key=repr)
    assert lexical.search(asked.limit(0), table).collect() == []
    assert lexical.search(asked, table.limit(0)).collect() == []
