import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from provender.llm import quality as Q

BEGIN, END = "\U0010fffe", "\U0010ffff"


def model_of(texts):
    """Interpolated modified Kneser-Ney over character trigrams, from its definition."""
    three = Counter()
    for t in texts:
        s = [BEGIN, BEGIN, *t, END]
        three.update(zip(s, s[1:], s[2:]))
    two, one = Counter(), Counter()
    for g in three:
        two[g[1:]] += 1
    for g in two:
        one[g[1:]] += 1

    def level(counts, context):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        raw = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else y for i in (1, 2, 3)]
        d = [min(max(x, 0.05), 0.95 * i) for i, x in zip((1, 2, 3), raw)]
        total, freed = defaultdict(float), defaultdict(float)
        for g, c in counts.items():
            total[context(g)] += c
            freed[context(g)] += d[min(c, 3) - 1]
        return lambda g: ((counts[g] - d[min(counts[g], 3) - 1]) / total[context(g)] if g in counts else 0.0), (
            lambda h: freed[h] / total[h] if h in total else 1.0
        )

    p3, g3 = level(three, lambda g: g[:2])
    p2, g2 = level(two, lambda g: g[:1])
    p1, g1 = level(one, lambda g: ())

    def probability(a, b, c):
        lowest = p1((c,)) + g1(()) / (len(one) + 1)
        return p3((a, b, c)) + g3((a, b)) * (p2((b, c)) + g2((b,)) * lowest)

    return probability, {g[2] for g in three}


def perplexity(probability, text):
    s = [BEGIN, BEGIN, *text, END]
    return math.exp(-sum(math.log(probability(*g)) for g in zip(s, s[1:], s[2:])) / (len(text) + 1))


TEXTS = ["the cat sat", "the hat", "a cat", "that", "é😀 the", "hat hat hat", "b"]


@pytest.fixture(scope="module")
def trained(frame):
    model, unseen = Q.train(frame([(t,) for t in TEXTS], "text string"))
    return model, unseen


@pytest.mark.parametrize("size", [4_000_000, 15])
@pytest.mark.parametrize("dense", [160, 3])
def test_perplexity_against_definition(frame, trained, monkeypatch, size, dense):
    monkeypatch.setattr(Q, "SHARD", size)
    monkeypatch.setattr(Q, "DENSE", dense)
    monkeypatch.setattr(Q, "AT_ONCE", 5)
    shards = Q.shards(*trained)
    assert (len(shards) > 1) == (size == 15)
    texts = [*TEXTS, "zebra 123", "the the the cat", "x", "😀"]
    probability, _ = model_of(TEXTS)
    parts = [s.score(texts) for s in shards]
    got = np.exp(-sum(p[0] for p in parts) / parts[0][1])
    assert got == pytest.approx([perplexity(probability, t) for t in texts], rel=1e-4)


def test_probabilities_sum_to_one(trained):
    probability, symbols = model_of(TEXTS)
    for a, b in ((BEGIN, BEGIN), ("t", "h"), ("q", "q")):
        whole = sum(probability(a, b, c) for c in symbols) + probability(a, b, "never")
        assert whole == pytest.approx(1)


def corpus(n=160):
    r = random.Random(9)
    words = "the of and to in that was house water green people under number".split()
    docs, labels = [], []
    for i in range(n):
        text = " ".join(r.choice(words) for _ in range(40))
        bad = i % 4 == 0
        if bad:
            text = text.upper() + "!!" if i % 8 else " | ".join(text.split())
        docs.append((i, text, "en" if i % 3 else "fr", "x", 0.5))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    return docs, labels


DOCS = "doc_id long, text string, lang string, perplexity string, threshold double"
LABELS = "doc_id long, quality int, toxic int"


def test_junk_is_rejected_and_the_rest_kept(frame):
    docs, labels = corpus()
    docs += [(None, docs[1][1], "en", "x", 0.0), (900, None, "en", "x", 0.0), (901, "", None, "x", 0.0), (1, *docs[1][1:]), (902, docs[1][1], "xx", "x", 0.0)]
    labels += [(None, 1, 0), (2, None, None), (2, 1, 0), (5000, 1, 0)]
    df, marks = frame(docs, DOCS), frame(labels, LABELS)
    rows = Q.classify(df, marks).collect()
    assert len(rows) == len(docs)
    for r in rows:
        if r["doc_id"] in (900, 901):
            assert r["perplexity"] is None and not r["accepted"]
        elif r["doc_id"] is not None and r["doc_id"] < 900:
            assert r["accepted"] == (r["doc_id"] % 4 != 0)
    kept = Q.keep_accepted(df, marks)
    assert kept.columns == df.columns
    want = sorted(str(r["doc_id"]) for r in rows if r["accepted"])
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want


def test_without_labels_all_texts_pass(frame):
    docs, labels = corpus(20)
    rows = Q.classify(frame(docs, DOCS), frame([], LABELS)).collect()
    assert len(rows) == 20 and all(r["accepted"] for r in rows)


def test_empty(frame):
    docs, labels = corpus(20)
    assert Q.classify(frame([], DOCS), frame(labels, LABELS)).collect() == []
    assert Q.keep_accepted(frame([], DOCS), frame(labels, LABELS)).collect() == []


def test_every_trusted_document_is_counted_whole(frame, monkeypatch):
    docs, labels = corpus(60)
    docs.append((1000, "zq" * 15_000, "en", "x", 0.5))
    trusted = {i for i, quality, _ in [*labels, (1000, 1, 0)] if quality}
    seen = []
    train = Q.train
    monkeypatch.setattr(Q, "train", lambda texts: seen.append(sorted(r[0] for r in texts.collect())) or train(texts))
    monkeypatch.setattr(Q, "TRAIN_DOCUMENTS", 5, raising=False)
    Q.fit(frame(docs, DOCS), frame([*labels, (1000, 1, 0)], LABELS))
    assert seen == [sorted(d[1] for d in docs if d[0] in trusted)]


def test_large_models_are_joined(frame, monkeypatch):
    docs, labels = corpus(80)
    docs += [(None, docs[1][1], "en", "x", 0.0), (900, None, "en", "x", 0.0), (901, "", None, "x", 0.0), (902, "é😀 unseen", "xx", "x", 0.0)]
    df, marks = frame(docs, DOCS), frame(labels, LABELS)
    want = {r["doc_id"]: r for r in Q.classify(df, marks).collect()}
    kept = sorted(str(r) for r in Q.keep_accepted(df, marks).collect())
    monkeypatch.setattr(Q, "SHARD", 100)
    monkeypatch.setattr(Q, "AT_ONCE", 50)
    monkeypatch.setattr(Q, "perplexity_column", None)
    got = Q.classify(df, marks).collect()
    assert len(got) == len(docs)
    for r in got:
        other = want[r["doc_id"]]
        assert r["threshold"] == pytest.approx(other["threshold"], rel=1e-5)
        assert (r["perplexity"] or 0) == pytest.approx(other["perplexity"] or 0, rel=1e-5)
        assert r["accepted"] == other["accepted"]
    assert sorted(str(r) for r in Q.keep_accepted(df, marks).collect()) == kept
