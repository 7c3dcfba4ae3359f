import math
import random

from provender.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k, every):
    vectors = [
        (i, [math.floor(1024.0 * x) for x in v])
        for i, v, _ in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    asked = {}
    for q, a in vectors:
        if q % every == 0:
            scored = [(-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q]
            asked.setdefault(q, []).extend(scored)
    return sorted((q, n + 1, i, -s) for q, found in asked.items() for n, (s, i) in enumerate(sorted(found)[:k]))


def collected(df):
    return sorted(map(tuple, df.collect()))


def make(n, seed, dimensions=8):
    r = random.Random(seed)
    scale = 2.0**-8
    return [(i, [round(r.gauss(0, 40)) * scale for _ in range(dimensions)], "x") for i in range(n)]


def test_against_brute_force(frame, monkeypatch):
    rows = make(700, 1)
    rows += [(1000 + i, rows[5][1], "copy") for i in range(60)]  # ties
    df = frame(rows, SCHEMA)
    want = brute(rows, 10, 20)
    assert collected(T.top_k(df, 10, 20)) == want
    for name, value in (("SHARD", 100), ("BLOCK", 7), ("BLOCKS", 2)):
        monkeypatch.setattr(T, name, value)
    assert collected(T.top_k(df, 10, 20)) == want


def test_odd_rows(frame):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, -0.5], ""), (1, None, ""), (2, [nan, 1.0], ""), (3, [inf, 1.0], ""), (4, [None, 1.0], ""),
        (None, [1.0, 1.0], ""), (5, [0.25], ""), (6, [], ""), (100, [1.0, -0.5], ""), (100, [2.0, 0.5], ""),
        (100, [1.0, -0.5], ""), (-100, [-1e-4, 3.0], ""),
    ]
    df = frame(rows, SCHEMA)
    assert collected(T.top_k(df)) == brute(rows, 10, 100)
    assert T.top_k(df.limit(0)).collect() == []


def test_repeated_ids_are_candidates_each_for_itself(frame, spark):
    import duckdb

    rows = make(60, 7) + [(7, [float(n % 3)] * 8, "again") for n in range(40)] + [(20, [2.0] * 8, "again")] * 15
    df = frame(rows, SCHEMA)
    got = collected(T.top_k(df, 10, 20))
    assert got == brute(rows, 10, 20)
    table = df.toPandas()
    with duckdb.connect() as db:
        db.register("embeddings", table)
        assert sorted(db.execute(T.top_k_sql("embeddings", 10, 20)).fetchall()) == got


def test_stops_before_the_last_segment():
    import numpy as np

    r = np.random.default_rng(1)
    values = r.integers(-400, 400, (3000, 64))
    index = T.Index(np.arange(3000), values)
    used = []
    index.segments = [(_Counting(s, used), n) for s, n in index.segments]
    found = list(index.best(np.array([0]), values[:1], 10))
    exact = values @ values[0]
    assert [i for _, i, _ in found] == np.lexsort((np.arange(3000), -exact))[1:11].tolist()
    assert 0 < len(used) < len(index.segments)


class _Counting:
    def __init__(self, segment, used):
        self.segment, self.used = segment, used

    @property
    def T(self):
        self.used.append(1)
        return self.segment.T
