"""Classifiers work on blocks of rows: few passes over the outputs, words cut once, all heads scored at once."""

import time

import numpy as np
import pytest
from pyspark.ml.feature import IDF
from pyspark.sql import functions as F

from provender import schema as S
from provender.operators import classify, joint
from provender.plans import queries as Q


def plain_error(shape, outputs, truth, subs, owners):
    """Heads and sub-types one by one, whatever the size of the numbers."""
    rows, at, loss = np.arange(outputs.shape[1]), 0, 0.0
    hit = np.zeros_like(outputs)
    hit[truth, rows], hit[subs, owners] = 1, 1
    for size in shape.heads:
        part = outputs[at : at + size]
        part -= part.max(0)
        loss -= float(part[hit[at : at + size] == 1].sum())
        np.exp(part, out=part)
        total = part.sum(0)
        loss += float(np.log(total).sum())
        part /= total
        at += size
    odds = outputs[at:]
    small = np.exp(-np.abs(odds))
    loss += float((np.maximum(odds, 0) + np.log(1 + small)).sum() - odds[hit[at:] == 1].sum())
    odds[:] = np.where(odds >= 0, 1, small) / (1 + small)
    return loss, outputs - hit


def drawn(rows, scale, dtype=np.float64):
    random = np.random.default_rng(5)
    shape = joint.Shape(8, 4, (9, 27, 57), 123)
    outputs = (scale * random.standard_normal((shape.outputs, rows))).astype(dtype)
    starts = np.cumsum(shape.heads) - shape.heads
    truth = np.stack([s + random.integers(0, h, rows) for s, h in zip(starts, shape.heads, strict=True)])
    return shape, outputs, truth, sum(shape.heads) + random.integers(0, 123, rows), np.arange(rows)


@pytest.mark.parametrize("scale", [1, 30, 500])
def test_errors_of_near_and_far_outputs(scale):
    shape, outputs, *rest = drawn(300, scale)
    want_loss, want = plain_error(shape, outputs.copy(), *rest)
    loss, found = shape._error(outputs.copy(), *rest)
    assert loss == pytest.approx(want_loss, rel=1e-9)
    assert np.allclose(found, want, atol=1e-9)
    loss, found = shape._error(outputs.astype(np.float32), *rest)
    assert loss == pytest.approx(want_loss, rel=1e-4) and np.abs(found - want).max() < 1e-3


def test_errors_take_few_passes():
    shape, outputs, *rest = drawn(4096, 1, np.float32)

    def seconds(work):
        took = []
        for _ in range(7):
            copy = outputs.copy()
            start = time.perf_counter()
            work(copy)
            took.append(time.perf_counter() - start)
        return min(took)

    assert seconds(lambda x: shape._error(x, *rest)) < 0.7 * seconds(lambda x: plain_error(shape, x, *rest))


def test_tiles_change_nothing(monkeypatch):
    random = np.random.default_rng(6)
    shape = joint.Shape(20, 4, (3, 5), 6)
    sizes, sub_sizes = random.integers(1, 5, 40), random.integers(0, 3, 40)
    words, subs = random.integers(0, 21, sizes.sum()), np.concatenate([np.arange(n) for n in sub_sizes])
    labels = np.stack([random.integers(0, 3, 40), random.integers(0, 5, 40)], 1)
    one = shape.gradient(shape.start().astype(float), words, sizes, labels, subs, sub_sizes)
    monkeypatch.setattr(joint, "TILE", 7)
    other = shape.gradient(shape.start().astype(float), words, sizes, labels, subs, sub_sizes)
    assert one[0] == pytest.approx(other[0]) and np.allclose(one[1], other[1])


def test_words_are_cut_once_and_heads_scored_at_once(spark, sf_dir, monkeypatch):
    rows = Q.kept_labels(spark, sf_dir, S.PRODUCT_TYPE)
    found = {h: [r[0] for r in rows.select(S.quoted(h)).distinct().collect()] for h in (S.FPG, S.FPC)}
    subs = sorted({r[0] for c in S.SUB_TYPE_COLUMNS for r in rows.select(S.quoted(c)).distinct().collect()})
    labels = {h: sorted(x) for h, x in found.items()} | {S.SUB_TYPES: subs}
    plans, fit = [], IDF.fit

    def spied(self, data, *rest):
        plans.append(data._jdf.queryExecution().withCachedData().toString())
        return fit(self, data, *rest)

    monkeypatch.setattr(IDF, "fit", spied)
    model = classify.TextClassifier.fit(rows, labels, num_features=1 << 10)
    # What the weights by rarity are found from is kept: no text is cut into words again.
    assert "InMemoryRelation" in plans[0] and "UDF(" not in plans[0].split("InMemoryRelation")[0]
    some = rows.limit(40).unionByName(rows.limit(1).withColumn(S.PRODUCT_TYPE, F.lit("")))
    blocks = model.score(some.coalesce(1))
    assert "ArrowEvalPython" in blocks._jdf.queryExecution().executedPlan().toString()
    got = blocks.select(*[S.quoted(f"{h} scores") for h in labels]).collect()
    monkeypatch.setattr(classify, "MAX_SHARED_CELLS", 0)
    apart = model.score(some.coalesce(1))
    assert "ArrowEvalPython" not in apart._jdf.queryExecution().executedPlan().toString()
    want = apart.select(*[S.quoted(f"{h} scores") for h in labels]).collect()
    assert len(got) == 41
    for row, other in zip(got, want, strict=True):
        for a, b in zip(row, other, strict=True):
            assert np.allclose(a, b, rtol=1e-6, atol=1e-9)
    assert model.score(some.limit(0)).collect() == []
    rows.unpersist()
