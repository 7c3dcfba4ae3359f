import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from provender.llm import lm_score as L
from provender.llm import restaurants as R

SCHEMA = "doc_id long, text string, score string"


def corpus(n=150):
    r = random.Random(10)
    follow = {w: r.sample("abcdefghijklmnopqrst", 3) for w in "abcdefghijklmnopqrst"}
    rows = []
    for i in range(n):
        word, words = r.choice("abc"), []
        for _ in range(r.randrange(60)):
            words.append(word + word)
            word = r.choice(follow[word]) if r.random() < 0.9 else r.choice(list(follow))
        rows.append((i, " ".join(words).title(), "x"))
    return rows + [(5, rows[5][1], "x"), (None, "aa bb", "x"), (900, None, "x"), (901, "", "x"), (902, "unseen\x1cword é\x0baa", "x")]


def words(text):
    return (text or "").encode().lower().split() + [b""]


def out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def expected(rows):
    counts = Counter(w for i, t, _ in rows if not out(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    result = []
    for i, t, _ in rows:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))
        result.append((str(i), out(i), len(words(t)), sum(w in counts for w in words(t)), n, round(base, 6)))
    return sorted(result)


def fixed(rows):
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)


def test_counts_and_base_against_brute_force(frame):
    rows = corpus()
    got = L.score(frame(rows, SCHEMA).repartition(3)).collect()
    assert fixed(got) == expected(rows)
    assert all(r["score"] < 0 for r in got)


def test_blocks_and_long_texts_change_no_count(frame, monkeypatch):
    for name, value in (("TOKENS", 11), ("ROWS", 3), ("FREQUENT", 6), ("SHARD_TOKENS", 100)):
        monkeypatch.setattr(L, name, value)
    rows = corpus(60)
    assert fixed(L.score(frame(rows, SCHEMA).repartition(2)).collect()) == expected(rows)


def test_same_result_each_time(frame):
    df = frame(corpus(60), SCHEMA)
    assert sorted(map(str, L.score(df).collect())) == sorted(map(str, L.score(df).collect()))


@pytest.mark.parametrize("frequent", [4096, 3])
def test_context_beats_words_alone(frame, monkeypatch, frequent):
    monkeypatch.setattr(L, "FREQUENT", frequent)
    held = [r for r in L.score(frame(corpus(400), SCHEMA)).collect() if r["held_out"]]
    score, base = sum(r["score"] for r in held), sum(r["base_score"] for r in held)
    assert score > 0.75 * base  # both negative


def test_scores_do_not_depend_on_partitions(spark, frame, monkeypatch):
    monkeypatch.setattr(L, "FREQUENT", 8)  # so that some words are dealt out
    monkeypatch.setattr(L, "LEAST_TOKENS", 10)
    rows = corpus(120)
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for inputs, shuffles, at_once in ((1, 1, 1_000_000), (3, 7, 500), (5, 4, 40)):
            spark.conf.set("spark.sql.shuffle.partitions", str(shuffles))
            monkeypatch.setattr(L, "TOKENS", at_once)
            got = L.score(frame(rows, SCHEMA).repartition(inputs)).collect()
            found.append(sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in got))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for other in found[1:]:
        assert [r[:2] for r in other] == [r[:2] for r in found[0]]
        assert [r[2] for r in other] == pytest.approx([r[2] for r in found[0]], rel=1e-9)


def test_text_ids_and_clashing_columns(frame):
    rows = [(f"a{i}\n", t, "x") for i, t, _ in corpus(30)]
    got = L.score(frame(rows, "doc_id string, text string, score string")).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)


def test_without_training_rows_and_empty(frame):
    rows = [(i, "a b", "x") for i in range(200) if out(i)]
    got = L.score(frame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and {r["train_tokens"] for r in got} == {0} and {r["score"] for r in got} == {0.0}
    assert L.score(frame([], SCHEMA)).collect() == []


def test_a_text_seen_in_training_scores_above_its_like(frame):
    """Rare words have contexts of their own, so a second copy of a text is told apart."""
    r = random.Random(4)
    pool = [f"w{i}" for i in range(3000)]
    trained = [i for i in range(400) if not out(i)]
    held = [i for i in range(400, 800) if out(i)]
    rows = [(i, " ".join(r.choices(pool, k=60)), "x") for i in trained]
    copied, fresh = held[::2], held[1::2]
    rows += [(i, rows[n][1], "x") for n, i in enumerate(copied)]
    rows += [(i, " ".join(r.choices(pool, k=60)), "x") for i in fresh]
    score = {x["doc_id"]: x["score"] for x in L.score(frame(rows, SCHEMA)).collect()}
    assert min(score[i] for i in copied) > max(score[i] for i in fresh)


def whole_chain(texts, asked, turns=L.BURN_IN + 1):
    """The probabilities of pairs, all on one shard, by the steps that the Spark job takes."""
    packer = L.Packer({b"": 0, b"aa": 1}, 1)
    for i, text in enumerate(texts):
        packer.add(i, str(i), False, text, b"")
    for i, pair in enumerate(asked):
        packer.add(10**6 + i, str(i), True, pair[1:], pair[0])
    rows = L.built(0, [b[3] for b in packer.blocks() if b[1] == L.TOKENS_OF], 1)

    def totals(*parts):
        t = L.Totals.__new__(L.Totals)
        t.sums = np.zeros((2, L.DEALT + 2 * L.SAMPLES))
        for row in (x for part in parts for x in part if x[1] == L.TOTAL):
            t.sums[:, row[4]] += row[5:7]
        return t

    def block(rows, kind):
        return [(x[2], x[3]) for x in rows if x[1] == kind]

    index = {}

    level = L.Level.of(block(rows, L.PAIRS)[0][1], 1)
    last, seatings = None, [level.first()]
    for turn in range(turns + 1):
        homes = L.home(0, {L.REPORT: block(rows, L.REPORT), **index}, last, turn)
        index = index or {k: block(homes, k) for k in (L.WORDS, L.INDEX)}
        last = totals(rows, homes)
        answers = level.answers(block(homes, L.ANSWER))
        if turn < turns:
            rows = L.turned(0, level, seatings[-1], answers, last, turn)
            seatings = L._seatings(level, block(rows, L.SEATS))
    return level, seatings, answers, last


def test_probabilities_sum_to_one():
    """Over all known words and one unknown: after a dealt-out word, another, and a new one."""
    texts = [words(t) for i, t, _ in corpus(80)]
    vocabulary = sorted({w for t in texts for w in t})
    contexts = [b"aa", b"bb", b"never"]
    level, seatings, answers, totals = whole_chain(texts, [[c, w] for c in contexts for w in [*vocabulary, b"other"]])
    assert (totals.tokens, totals.vocabulary) == (sum(map(len, texts)), len(vocabulary))
    assert len(seatings) == L.SAMPLES
    probability = L.probabilities(level, seatings, answers, totals)
    assert ((probability > 0) & (probability < 1)).all()
    half = np.uint64(32)
    asked = L._hash([*vocabulary, b"other"]) >> half
    for context in L._hash(contexts) >> half:
        mine = (level.short[level.before] == context) & np.isin(level.short[level.word], asked)
        assert mine.sum() == len(asked)
        assert probability[mine].sum() == pytest.approx(1, abs=1e-9)
    for seats in seatings:
        assert ((seats >= np.minimum(level.customers, 1)) & (seats <= level.customers)).all()


def exact_tables(c, weight, d):
    """Chances of 1, 2, ... tables by the recursion of the numbers themselves."""
    row = np.array([0.0])
    for n in range(c):
        t = np.arange(len(row))
        new = np.full(len(row) + 1, -np.inf)
        with np.errstate(divide="ignore"):
            new[:-1] = row + np.log(np.maximum(n - t * d, 0))
        new[1:] = np.logaddexp(new[1:], row)
        row = new
    logs = row[1:] + np.arange(1, c + 1) * math.log(weight)
    p = np.exp(logs - logs.max())
    return p / p.sum()


@pytest.mark.parametrize(("c", "weight"), [(2, 0.3), (3, 0.15), (40, 2.0), (1024, 9.0)])
def test_tables_of_a_dish_have_the_right_distribution(c, weight):
    d, n = 0.8, 40_000
    got = R.tables(np.full(n, c), np.full(n, weight), d, np.arange(n, dtype=np.uint64), 3)
    want = exact_tables(c, weight, d)
    assert np.abs(np.cumsum(np.bincount(got, minlength=c + 1)[1:] / n) - np.cumsum(want)).max() < 0.01


@pytest.mark.parametrize("weight", [0.01, 0.5, 10.0, 300.0, 1e5])
def test_large_dishes_are_close_to_the_exact_distribution(weight):
    d, n, c = 0.8, 20_000, 5000
    # Evenly laid points instead of hashes, so that what is left is the bias.
    got = R._large(np.full(n, c), np.full(n, math.log(weight)), d, (np.arange(n) + 0.5) / n)
    p, t = exact_tables(c, weight, d), np.arange(1, c + 1)
    mean = (p * t).sum()
    spread = math.sqrt((p * t**2).sum() - mean**2)
    assert got.mean() == pytest.approx(mean, rel=0.005, abs=0.02)
    assert got.std() == pytest.approx(spread, rel=0.1, abs=0.05)


def test_sweeps_of_a_restaurant_have_the_right_distribution():
    """Two dishes share a restaurant: all seatings weighed against many chains."""
    d, s, p, counts = L.DISCOUNT[1], L.STRENGTH[1], (0.3, 0.05), (4, 3)
    stirling = np.exp(R.stirling(d)[:5, :5])
    want = {}
    for a in range(1, 5):
        for b in range(1, 4):
            up = np.prod([s + d * i for i in range(a + b)])
            want[a, b] = stirling[4, a] * stirling[3, b] * p[0] ** a * p[1] ** b * up
    total = sum(want.values())
    n = 30_000
    words = np.arange(n + 2, dtype=np.uint64)
    before = np.repeat(np.arange(n), 2)
    level = L.Level(words, np.zeros(n + 2, np.int64), before, np.tile([n, n + 1], n), np.tile(counts, n), 1)
    weight = np.concatenate([np.ones(n), p])
    seats = level.first()
    for sweep in range(12):
        seats = level.sweep(seats, weight, np.zeros(1), sweep)
    got = Counter(zip(seats[::2].tolist(), seats[1::2].tolist(), strict=True))
    for key, value in want.items():
        assert got[key] / n == pytest.approx(value / total, abs=0.012), key


def test_gamma_variables():
    for shape in (0.1, 0.4, 1.0, 4.0, 1e6):
        x = R.gamma(np.full(100_000, shape), np.arange(100_000, dtype=np.uint64), 3)
        assert x.mean() == pytest.approx(shape, rel=0.03) and x.var() == pytest.approx(shape, rel=0.06)
