"""Packing: ids against the library, plans against all combinations, placings against the contract."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from provender.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, docs, library, capacity=2048):
    """Every id of every document stands once, in order; sequences have no gap and fit."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    texts = defaultdict(list)
    for doc_id, text in docs:
        texts[doc_id].append(ids_of(library, text))
    assert set(by_doc) == set(texts)
    for doc_id, held in by_doc.items():
        expected = Counter()
        for ids in texts[doc_id]:
            first = len(ids) % capacity or capacity
            bounds = [0, *range(first, len(ids), capacity), len(ids)]
            if len(ids) <= capacity:
                bounds = [0, len(ids)]
            for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                expected[piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
        assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in held) == expected
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_ids_are_those_of_the_library(library):
    ids = packing.TextIds(PATH)
    assert ids.quick
    pick = random.Random(5)
    odd = [" ", "  ", "\n", "\t", " \n", " ", "　", "\x1c", "\x85", "a", "B", "é", "7", "٣", "中",
           "'s", "'", "...", "<|endoftext|>", "<|", "ſ", "​", "́", "\U0001f600", "\x00", "word", "ⅷ"]
    texts = ["".join(pick.choices(odd, k=pick.randint(0, 9))) for _ in range(4000)]
    texts += ["a" * 50_000, " " * 50_000, "\n " * 20_000, "中" * 20_000]
    for text in texts:
        assert ids(text) == packing.as_bytes(library.encode(text, add_special_tokens=False).ids), text[:50]


def test_every_character_is_cut_alike(library):
    ids = packing.TextIds(PATH)
    for at in range(0, 0x110000, 4096):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}'s" for c in range(at, at + 4096) if not 0xD800 <= c < 0xE000)
        assert ids(text) == packing.as_bytes(library.encode(text, add_special_tokens=False).ids), hex(at)


def test_other_vocabularies_go_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = packing.TextIds(path)
    assert not ids.quick
    assert ids("Some words") == packing.as_bytes(Tokenizer.from_file(path).encode("Some words", add_special_tokens=False).ids)


def combinations(counts, room):
    """All fillings by length, by trying everything."""
    found = [()]
    for length, n in counts.items():
        found = [f + (k,) for f in found for k in range(n + 1)]
    lengths = list(counts)
    return max(
        (sum(k * x for k, x in zip(f, lengths, strict=True)) for f in found
         if sum(k * x for k, x in zip(f, lengths, strict=True)) <= room),
        default=0,
    )


def test_fullest_combination_against_all_of_them():
    pick = random.Random(3)
    for _ in range(300):
        counts = {pick.randint(1, 30): pick.randint(1, 3) for _ in range(pick.randint(0, 5))}
        room = pick.randint(0, 60)
        taken = packing.fullest(counts, room)
        assert all(0 < n <= counts[x] for x, n in taken.items())
        assert sum(x * n for x, n in taken.items()) == combinations(counts, room)


def test_plans_use_every_piece_once_and_stay_short():
    pick = random.Random(4)
    for capacity in (7, 64, 2048):
        counts = {x: pick.randint(0, 10**9 if pick.random() < 0.1 else 50) for x in range(1, capacity + 1)}
        used, bins = Counter(), 0
        steps = list(packing.plan(counts, capacity))
        for times, taken in steps:
            assert sum(x * n for x, n in taken.items()) <= capacity
            used.update({x: n * times for x, n in taken.items()})
            bins += times
        assert used == Counter({x: n for x, n in counts.items() if n})
        assert len(steps) <= capacity * 4
        assert bins >= -(-sum(x * n for x, n in counts.items()) // capacity)


def test_documents_of_the_table(spark, library):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op11_bin_packing(spark, SF).collect()
    sequences = check(rows, docs, library)
    tokens = sum(r["length"] for r in rows)
    assert sequences <= -(-tokens // 2048) + 1


def test_hot_lengths_over_many_partitions(spark, frame, library):
    docs = [(i, "same text again") for i in range(3000)] + [(3000 + i, "w " * (i % 50)) for i in range(500)]
    rows = packing.pack(frame(docs, "doc_id long, text string").repartition(13), PATH, capacity=32).collect()
    sequences = check(rows, docs, library, 32)
    assert sequences <= -(-sum(r["length"] for r in rows) // 32) * 1.02


def test_edges(spark, frame, library):
    docs = [(1, None), (2, ""), (None, "lost id"), (3, "twice"), (3, "twice"), (4, "long " * 9000), (5, " x<|endoftext|>y ")]
    table = frame([(*d, 7, "p") for d in docs], "doc_id long, text string, piece int, part string")
    rows = packing.pack(table, PATH)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check(rows.collect(), docs, library)
    assert packing.pack(table.limit(0), PATH).collect() == []
    named = frame([("a", "x")], "name string, body string")
    assert packing.pack(named, PATH, id_col="name", text_col="body").first()["name"] == "a"
