"""Whitening against dense eigenvectors of the exact covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest

from provender.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def dense(vectors):
    """Eigenvalues and vectors, falling, of the covariance of the whole numbers, centred first."""
    x = np.floor(np.array(vectors, float) * 64) + 1e6
    centred = x - x.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    return centred, values[::-1], axes[:, ::-1]


def spectrum(dimensions, values, seed=1):
    """A symmetric matrix with the given eigenvalues."""
    axes, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return (axes * values) @ axes.T, axes


@pytest.mark.parametrize("values", [
    np.geomspace(1e4, 1e-2, 150),
    np.linspace(2, 1, 150),
    np.r_[np.full(5, 3.0), np.linspace(1, 0, 145)],
    np.r_[np.full(3, 7.0), np.zeros(147)],
])
def test_leading_eigenvectors(values):
    matrix, _ = spectrum(150, values)
    calls = []

    def apply(block):
        calls.append(block.shape[1])
        return matrix @ block

    found, axes = whitening.leading(apply, 150, 8)
    assert np.allclose(found, values[:8], rtol=1e-11, atol=1e-11 * values[0])
    assert np.abs(axes.T @ axes - np.eye(8)).max() < 1e-12
    assert np.linalg.norm(matrix @ axes - axes * found, axis=0).max() <= 2 * whitening.EXACT * values[0]
    assert max(calls) < 150  # the matrix is only ever applied to blocks


def test_minres_solves_symmetric_systems():
    matrix, _ = spectrum(20, np.r_[np.linspace(-3, -1, 6), np.linspace(1, 4, 14)])
    right = np.random.default_rng(2).standard_normal((20, 3))
    right[:, 1] = 0
    found = whitening.minres(lambda v: matrix @ v, right, 60, 1e-12)
    assert np.allclose(matrix @ found, right, atol=1e-9)


def test_whole_table(spark):
    rows = queries.op12_whitening(spark, SF).collect()
    table = sorted(
        (r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()
        if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])
    )
    centred, values, axes = dense([v for _, v in table])
    white = np.zeros((len(table), 32))
    at = {i: k for k, (i, _) in enumerate(table)}
    for r in rows:
        white[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["n"] == len(table)
        assert math.isclose(r["explained"], values[r["component"] - 1] / values.sum(), rel_tol=1e-9)
        assert r["identity_error"] < 1e-9
    assert len(rows) == 32 * len(table)
    expected = centred @ axes[:, :32] / np.sqrt(values[:32])
    signs = np.sign((white * expected).sum(0))
    assert np.abs(white * signs - expected).max() < 1e-6
    x = [[math.floor(Fraction(c) * 64) + 1_000_000 for c in v] for _, v in table]
    sums = [sum(column) for column in zip(*x, strict=True)]
    exact = {i: sum((len(x) * a - s) ** 2 for a, s in zip(row, sums, strict=True))
             for (i, _), row in zip(table, x, strict=True)}
    assert {r["vec_id"]: r["deviation"] for r in rows} == exact


def test_more_entries_than_components_over_partitions(spark, frame):
    pick = np.random.default_rng(3)
    data = pick.standard_normal((400, 40)) @ (np.diag(np.geomspace(50, 0.5, 40)))
    table = frame([(i, [float(c) for c in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    found = whitening.whiten(table.repartition(300), 5)
    white = np.zeros((400, 5))
    for r in found.collect():
        white[r["vec_id"], r["component"] - 1] = r["whitened"]
    centred, values, axes = dense(data)
    expected = centred @ axes[:, :5] / np.sqrt(values[:5])
    assert np.abs(white * np.sign((white * expected).sum(0)) - expected).max() < 1e-8


def test_edges(spark, frame):
    ddl = "vec_id long, embedding array<float>, id string, v int"
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0, 0.5], "a", 1), (2, [2.0, 1.0, 0.5], "a", 1), (None, [0.0, 4.0, 0.5], "a", 1),
        (3, None, "a", 1), (4, [nan, 1.0, 1.0], "a", 1), (5, [inf, 1.0, 1.0], "a", 1), (6, [None, 1.0, 1.0], "a", 1),
        (7, [1.0], "a", 1), (7, [1.0], "a", 1), (8, [], "a", 1), (9, [3e38, 1.0, 1.0], "a", 1),
    ]
    found = whitening.whiten(frame(rows, ddl))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = found.collect()
    used = [v for i, v, _, _ in rows[:3] + rows[7:10]]
    _, values, _ = dense([v + [0.0] * (3 - len(v)) for v in used])
    rank = int((values > 1e-9).sum())
    assert sorted(r["component"] for r in got) == sorted(list(range(1, rank + 1)) * len(used))
    assert all(r["n"] == len(used) for r in got)
    assert whitening.whiten(frame([], ddl)).collect() == []
    assert whitening.whiten(frame(rows[:1], ddl)).collect() == []
    assert whitening.whiten(frame(rows[:1] * 4, ddl)).collect() == []
    assert whitening.whiten(frame(rows[9:10], ddl)).collect() == []


def test_sums_beyond_a_long_are_exact():
    centre = whitening.Centre(10**12, [10**30, 5])
    rows = np.array([[2**52, 1], [3, 4]])
    assert centre.multiples(rows).tolist() == [[2**52 * 10**12 - 10**30, 10**12 - 5], [3 * 10**12 - 10**30, 4 * 10**12 - 5]]
    assert centre.deviations(rows) == [None, None]
    assert whitening.Centre(3, [6, 9]).deviations(np.array([[2, 4]])) == [9]
