import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from provender.llm import simhash as H
from provender.llm.components import components


def print_of(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(items, near):
    """The least item that each reaches."""
    items = sorted(items)
    found = {}
    for i in items:
        if i in found:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in found:
                found[x] = i
                todo += [y for y in items if y not in found and near(x, y)]
    return found


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", "xx\x1cy", " "]), max_size=12), st.sampled_from([" ", "\n", "\x0b", "\t "]))
def test_fingerprint(words, space):
    text = space.join(words)
    assert H.fingerprint(text) == print_of(text)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    monkeypatch.setattr(H, "WORDS_AT_ONCE", 37)
    assert H.fingerprint(text) == print_of(text)


def test_components(frame):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    graph = {}
    for a, b in links:
        graph.setdefault(a, set()).add(b)
        graph.setdefault(b, set()).add(a)
    want = roots(graph, lambda x, y: y in graph[x])
    want = {k: v for k, v in want.items() if graph[k] - {k}}
    got = components(frame(links, "a long, b long")).collect()
    assert len(got) == len(want) and {r["node"]: r["root"] for r in got} == want


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def near(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count() <= 3


@pytest.mark.parametrize("together", [512, 4])
def test_links_against_brute_force(frame, monkeypatch, together):
    """Random prints, chains of near ones, and a dense cloud around one print."""
    monkeypatch.setattr(H, "TOGETHER", together)
    r = random.Random(5)
    prints = {r.getrandbits(64) for _ in range(60)}
    for start in list(prints)[:8]:
        for _ in range(6):
            for _ in range(r.randint(1, 4)):
                start ^= 1 << r.randrange(64)
            prints.add(start)
    centre = r.getrandbits(64)
    prints |= {centre ^ (r.getrandbits(6) << 3) ^ (1 << r.randrange(64)) for _ in range(150)}
    prints = {signed(p) for p in prints}
    want = roots(prints, near)
    found = H.classes(frame([(p,) for p in prints], "fp long")).collect()
    got = {r["fp"]: r["root"] for r in found}
    assert {p: got.get(p, p) for p in prints} == want


SCHEMA = "doc_id long, text string, fp string"


def documents():
    r = random.Random(6)
    base = [" ".join(f"w{r.randrange(900)}" for _ in range(300)) for _ in range(12)]
    rows = []
    for i in range(90):
        words = r.choice(base).split()
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "x"))
    rows += [(500, None, "x"), (501, "", "x"), (502, "  ", "x"), (None, base[0], "x"), (None, "alone here now", "x"), (3, rows[3][1], "x"), (503, "one", "x"), (504, "One", "x")]
    return rows


def test_near_duplicates(frame):
    rows = documents()
    got = sorted(map(tuple, H.near_duplicates(frame(rows, SCHEMA)).collect()), key=str)
    prints = {print_of(t) for _, t, _ in rows}
    root = roots(prints, near)
    least = {}
    for i, t, _ in rows:
        of = root[print_of(t)]
        if i is not None:
            least[of] = min(least.get(of, i), i)
    want = [(i, f"{print_of(t):016x}", least.get(root[print_of(t)])) for i, t, _ in rows]
    assert got == sorted(want, key=str)


def test_one_of_each(frame):
    rows = documents() + [(0, documents()[0][1], "x")]
    kept = H.one_of_each(frame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp"]
    kept = kept.collect()
    root = roots({print_of(t) for _, t, _ in rows}, near)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(root[print_of(t)], []).append(i)
    ids = sorted((min(i for i in g if i is not None) for g in groups.values() if any(i is not None for i in g)), key=str)
    assert sorted((r["doc_id"] for r in kept if r["doc_id"] is not None), key=str) == ids
    assert len(kept) == len(groups)


def test_empty(frame):
    df = frame([], SCHEMA)
    assert H.near_duplicates(df).collect() == [] and H.one_of_each(df).collect() == []


def test_forest_connects_the_same():
    pairs = np.array([[1, 2], [2, 3], [1, 3], [7, 8], [8, 7]])
    assert len(H._forest(pairs)) == 3


def test_one_of_each_keeps_columns_of_any_name(spark, frame):
    rows = [(1, "one two three four", "a", 5, "h", 1, "r"), (2, "one two three four", "b", 6, "h", 2, "r"),
            (3, "something else that differs", "c", 7, "h", 3, "r"), (3, "something else that differs", "c", 7, "h", 3, "r")]
    table = frame(rows, "doc_id long, text string, _text string, _id int, _hash string, id int, row string")
    kept = H.one_of_each(table)
    assert kept.columns == table.columns
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
