import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from provender.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    doc, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        windows = {tuple(w[i : i + window]) for i in range(len(w) - window + 1)} or ({tuple(w)} if w else set())
        for x in windows:
            for i in range(len(doc) - len(x) + 1):
                if tuple(doc[i : i + len(x)]) == x:
                    hit.update(range(i, i + len(x)))
                    found.add(name)
    return len(doc), len(hit), found


texts = st.lists(st.sampled_from(["a", "b", "B", "é", "1"]), max_size=12).map(" ".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(texts, max_size=4), texts, st.integers(1, 4))
def test_automaton_against_brute_force(items, text, window):
    named = [(str(i), t) for i, t in enumerate(items)]
    automaton = D.Automaton([(n, D.words_of(t)) for n, t in named], window)
    spans, found = automaton.hits(D.words_of(text))
    n_hit = sum(b - a for a, b in D.union(spans))
    assert (len(D.words_of(text)), n_hit, {automaton.names[i] for i in found}) == brute(text, named, window)


def fixture(frame):
    line = " ".join(f"w{i}" for i in range(16))
    docs = [
        (1, f"Start {line.upper()} end", "x"), (2, "nothing here", "x"), (3, None, "x"), (4, "", "x"),
        (None, line, "y"), (1, f"Start {line.upper()} end", "x"),
        (6, "long " * 1000 + line, "y"), (7, "one, two -- three", "z"), (8, "w1 w2 w3", "z"),
    ]
    items = [(10, line), (9, line), (9, line), (11, "one TWO three"), (12, None), (13, "..."), (None, "w2 w3 w4 w5")]
    return (
        frame(docs, "doc_id long, text string, n_hit string"),
        frame([(*i, "x") for i in items], "item_id long, text string, n_words string"),
        docs,
        items,
    )


def expected(docs, items):
    rows = []
    named = [("" if n is None else str(n), t) for n, t in items]
    for identity, text, _ in docs:
        n, hit, found = brute(text, named, 13)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        rows.append((identity, n, hit, len(found), digest, hit > 0 and 20 * hit >= n))
    return sorted(rows, key=str)


def test_report(frame):
    df, bench, docs, items = fixture(frame)
    got = D.contamination_report(df, bench)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs, items)


def test_several_automata_give_the_same(frame, monkeypatch):
    df, bench, docs, items = fixture(frame)
    monkeypatch.setattr(D, "WORDS_AT_ONCE", 8)
    assert sorted(map(tuple, D.contamination_report(df, bench).collect()), key=str) == expected(docs, items)


def test_empty_tables(frame):
    df, bench, docs, _ = fixture(frame)
    assert D.contamination_report(df.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in D.contamination_report(df, bench.limit(0)).collect()} == {0}


def test_spans_are_cut_out(frame):
    df, bench, docs, _ = fixture(frame)
    got = {(r["doc_id"], r["text"]) for r in D.remove_spans(df, bench).collect()}
    assert {(1, "Start   end"), (2, "nothing here"), (3, None), (4, ""), (7, " "), (None, " ")} <= got
    assert D.remove_spans(df, bench).columns == df.columns
    assert (6, docs[6][1]) in got  # below the share of words


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aB1é ,\n-"), max_size=30), st.data())
def test_without_keeps_other_words(text, data):
    w = D.words_of(text)
    begin = data.draw(st.integers(0, len(w)))
    end = data.draw(st.integers(begin, len(w)))
    if begin < end:
        assert D.words_of(D.without(text, [(begin, end)])) == w[:begin] + w[end:]
    assert D.without(text, []) == text


def test_columns_of_any_name_and_lengths_after_cuts(spark, frame):
    item = " ".join(f"w{i}" for i in range(13))
    rows = [(1, f"before {item} after", "s", "i", 2, "f", 99, "_", 5), (2, "clean text", "s", "i", 2, "f", 10, "_", 5), (3, None, "s", "i", 2, "f", None, "_", 5)]
    ddl = "doc_id long, text string, _spans string, _items string, _n_words int, _found string, n_chars long, _ string, row int"
    items = frame([("q", item)], "item_id string, text string")
    table = frame(rows, ddl)
    found = D.remove_spans(table, items, length_col="n_chars")
    assert found.columns == table.columns
    assert sorted(map(tuple, found.collect())) == [(1, "before   after", *rows[0][2:6], 14, "_", 5), *rows[1:]]


def test_an_item_repeated_much_is_one_piece(frame, spark):
    line = " ".join(f"w{i}" for i in range(20))
    items = frame([(1, line)] * 300 + [(2, line), (3, "other words")], "item_id long, text string").repartition(3)
    pieces = D.item_pieces(items, "item_id", "text", 13, 50)
    assert sorted(r["item"] for r in pieces.collect()) == ["1", "2", "3"]
    parts = list(D.automaton_parts(pieces, 15))
    assert sum(map(len, parts)) == 3 and max(map(len, parts)) <= 3
