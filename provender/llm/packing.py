"""Packing of tokenized documents into sequences by minimum bin slack.

Lengths of pieces are whole numbers up to the capacity, so all that a packing depends on is how many
pieces there are of each length: a table of at most ``capacity`` rows, whatever the input. On it, bin
after bin is filled: it starts with the longest piece left, and a subset-sum over the lengths that
are available (a bitset of reachable sums, bounded copies by binary splitting) finds the fullest
feasible rest, longer pieces first. The combination is taken out as many times as the pieces
left allow, so a plan has a few steps for each length, not one for each bin.

Pieces are numbered within their length by Spark: inside a partition as they are cut, across
partitions by offsets. Length and number say which step, bin and place a piece has.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer

from provender.llm.common import cut, long_texts, text_of
from provender.llm.token_counts import PATTERN, byte_symbols


def as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.array(ids, "<u4").tobytes()


class TextIds:
    """Ids of whole texts, in little-endian 32-bit integers, as the library ``tokenizers`` gives them
    for the vocabulary file.

    If the file is a byte-level vocabulary whose merges stand in the order of their ids, the same
    ranks are given to ``tiktoken``, which yields the same ids in a fifth of the time. Texts that hold
    a special string, and all texts under other vocabularies, go to ``tokenizers``.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        content = json.loads(self.library.to_str())
        self.special = [token["content"] for token in content["added_tokens"]]
        ranks = byte_ranks(content)
        self.quick = ranks and tiktoken.Encoding(
            path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def __call__(self, text: str) -> bytes:
        if self.quick and not any(special in text for special in self.special):
            return as_bytes(self.quick.encode_ordinary(text))
        return as_bytes(self.library.encode(text, add_special_tokens=False).ids)


def byte_ranks(content: dict) -> dict[bytes, int] | None:
    """Ids by bytes, if a vocabulary file's content says no more than that."""
    model, cutter = content["model"], content["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE"
        and cutter.get("type") == "ByteLevel"
        and cutter.get("use_regex", True)
        and not cutter.get("add_prefix_space")
        and content["normalizer"] is None
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    )
    if not plain:
        return None
    merged = [model["vocab"].get("".join(pair)) for pair in map(_pair, model["merges"])]
    if None in merged or merged != sorted(merged):
        return None
    byte = {symbol: number for number, symbol in enumerate(byte_symbols())}
    special = {token["content"] for token in content["added_tokens"]}
    return {bytes(map(byte.__getitem__, w)): i for w, i in model["vocab"].items() if w not in special}


def _pair(merge: str | list[str]) -> list[str]:
    return merge.split(" ") if isinstance(merge, str) else merge


_ids: dict[str, TextIds] = {}


def text_ids(path: str) -> TextIds:
    """One per worker process and vocabulary, kept between batches and tasks."""
    if path not in _ids:
        _ids.clear()
        _ids[path] = TextIds(path)
    return _ids[path]


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """Where a document of ``length`` ids is cut (from, to): pieces of ``capacity``, the first shorter
    if need be."""
    first = length % capacity or min(length, capacity)
    starts = [0, *range(first, length, capacity)] if length else []
    return [(a, min(length, a + capacity) if a else first) for a in starts]


def pieces(df: DataFrame, path: str, capacity: int, id_col: str, text_col: str, end: int) -> DataFrame:
    """``id, piece, start, length, ids_crc32, part, number``: all pieces, with their partition and
    their number among its pieces of equal length. Kept in the checkpoint folder, so that a task that
    is run again cannot number them otherwise."""
    read = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    numbers = ["start", "length", "ids_crc32", "part", "number"]
    schema = StructType([
        StructField("id", df.schema[id_col].dataType),
        StructField("piece", IntegerType()),
        *[StructField(n, LongType()) for n in numbers],
    ])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, last = text_ids(path), as_bytes([end])
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple[int, ...]] = []
            for row, text in enumerate(batch.column(1)):
                held = ids(text.as_py()) + last
                for piece, (a, b) in enumerate(cuts(len(held) // 4, capacity)):
                    rows.append((row, piece, a, b - a, zlib.crc32(held[4 * a : 4 * b]), part, seen[b - a]))
                    seen[b - a] += 1
            table = np.array(rows, np.int64).reshape(-1, 7)
            columns = [batch.column(0).take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32))]
            columns += [pa.array(table[:, i]) for i in range(2, 7)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", *numbers])

    return cut(read.mapInArrow(cut_up, schema))


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Copies by length of the fullest combination of the available pieces that fits into ``room``.
    Among equally full ones, that with the longer pieces."""
    layers: list[tuple[int, int]] = []  # length, sums reachable without it
    reachable, mask = 1, (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        copies = min(counts[length], room // length)
        if copies <= 0:
            continue
        layers.append((length, reachable))
        part = 1
        while copies:
            part = min(part, copies)
            reachable |= (reachable << (part * length)) & mask
            copies -= part
            part *= 2
        if reachable >> room:
            break
    left = reachable.bit_length() - 1
    taken: dict[int, int] = {}
    for length, before in reversed(layers):
        while not before >> left & 1:
            taken[length] = taken.get(length, 0) + 1
            left -= length
    return taken


def plan(counts: dict[int, int], capacity: int) -> Iterator[tuple[int, dict[int, int]]]:
    """``bins, copies by length``: how often a combination is used, longest piece first.

    Each step uses a combination until one of its lengths has too few pieces left for another
    time, which can happen to a length once for each halving of what a bin could take of it; so
    the number of steps depends on the capacity only.
    """
    left = {length: n for length, n in counts.items() if n}
    while left:
        longest = max(left)
        left[longest] -= 1
        taken = fullest(left, capacity - longest)
        left[longest] += 1
        taken = {longest: taken.pop(longest, 0) + 1} | dict(sorted(taken.items(), reverse=True))
        bins = min(left[length] // copies for length, copies in taken.items())
        for length, copies in taken.items():
            left[length] -= bins * copies
            if not left[length]:
                del left[length]
        yield bins, taken


def places(steps: Iterator[tuple[int, dict[int, int]]]) -> np.ndarray:
    """``length, first number, first bin, place in the bin, copies a bin`` for each length of each step,
    in order of length and number."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for bins, taken in steps:
        place = 0
        for length, copies in taken.items():
            rows.append((length, used.get(length, 0), sequence, place, copies))
            used[length] = used.get(length, 0) + bins * copies
            place += length * copies
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(
    df: DataFrame,
    path: str,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    end: int = 0,
) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset``, a row for each piece of each document.

    A document is its ids and the id ``end``, so a null or empty text is one piece of length 1. One
    longer than ``capacity`` is cut into pieces of ``capacity``, the first shorter if need be; no other is
    cut. ``start`` counts the document's ids before the piece, ``offset`` the ids before it in its
    sequence, which has no gap. Null ids stay, rows that repeat are documents of their own, an empty
    table gives an empty result, and other columns, whatever their names, are not looked at.

    Texts are read in one narrow pass; after that only short rows of numbers move. The driver sees a
    count for each length and makes the plan from it.
    """
    long_texts(df.sparkSession)
    rows = pieces(df, path, capacity, id_col, text_col, end)
    sizes = cut(rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = df.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    numbered = rows.join(earlier, ["part", "length"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("earlier")).alias("number")
    )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts, bins, spots, copies = table.value.T
        bounds = np.searchsorted(lengths, np.arange(capacity + 2))
        for batch in batches:
            length, number = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            at = np.empty(len(length), np.int64)
            for one in np.unique(length):
                here, (a, b) = length == one, bounds[one : one + 2]
                at[here] = a + np.searchsorted(firsts[a:b], number[here], side="right") - 1
            turn = number - firsts[at]
            columns = [
                *batch.columns[:5],
                pa.array(bins[at] + turn // copies[at]),
                pa.array(spots[at] + turn % copies[at] * length),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    schema = StructType([
        *numbered.schema.fields[:5],
        StructField("sequence_id", LongType()),
        StructField("offset", LongType()),
    ])
    return numbered.mapInArrow(placed, schema).withColumnRenamed("id", id_col)
