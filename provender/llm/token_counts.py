"""Token counts by byte-pair merging over a heap and a linked list.

A text is cut into words by the vocabulary's pattern, a word into its bytes. The pair of adjacent
symbols with the lowest rank is merged until none is left, so a word of n bytes and m merges has
n - m tokens. No identifier is looked up or emitted.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.llm.common import long_texts, text_of

# Fixed value: the pattern of byte-level vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words whose counts a worker remembers, and the longest of them. Bounds memory, not results.
REMEMBERED, LONGEST = 400_000, 40
#: Texts beyond this many characters are walked word by word instead of split at once.
AT_ONCE = 1_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


def read_vocabulary(path: str) -> dict:
    """The merges and special strings of a byte-level vocabulary file, in plain lists.

    The file has a fixed size of a megabyte or two whatever the data, so the driver reads it and
    broadcasts the result.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model = content["model"]
    if model["type"] != "BPE" or (content["pre_tokenizer"] or {}).get("type") != "ByteLevel":
        raise ValueError("a byte-level BPE vocabulary is needed")
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    special = [t["content"] for t in content["added_tokens"] if t["special"]]
    return {"merges": pairs, "special": special, "name": path}


class WordCounter(dict):
    """Tokens of a word; a dictionary that computes what it does not hold."""

    def __init__(self, merges: list[tuple[str, str]]):
        super().__init__()
        symbols = byte_symbols()
        number = {s: i for i, s in enumerate(symbols)}
        for a, b in merges:
            number.setdefault(a + b, len(number))
        self.merges = {
            (number[a], number[b]): (rank, number[a + b]) for rank, (a, b) in enumerate(merges)
        }

    def __missing__(self, word: str) -> int:
        count = self.count(word.encode())
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = count
        return count

    def count(self, word: bytes) -> int:
        merges, symbols = self.merges, list(word)
        size = len(symbols)
        following, previous = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = []
        for i in range(size - 1):
            if found := merges.get((symbols[i], symbols[i + 1])):
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(heap)
        left = size
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = following[i]
            if symbols[i] != a or j >= size or symbols[j] != b:
                continue  # one of the two was merged meanwhile
            left -= 1
            symbols[i], symbols[j] = merged, -1
            after = following[i] = following[j]
            if after < size:
                previous[after] = i
                if found := merges.get((merged, symbols[after])):
                    heapq.heappush(heap, (found[0], i, merged, symbols[after], found[1]))
            before = previous[i]
            if before >= 0 and (found := merges.get((symbols[before], merged))):
                heapq.heappush(heap, (found[0], before, symbols[before], merged, found[1]))
        return left


class TextCounter:
    """Tokens of whole texts; special strings inside count one each."""

    def __init__(self, vocabulary: dict):
        self.words = WordCounter(vocabulary["merges"])
        self.pattern = regex.compile(PATTERN)
        longest_first = sorted(vocabulary["special"], key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None

    def __call__(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(map(self.plain, pieces))

    def plain(self, text: str) -> int:
        known = self.words.__getitem__
        if len(text) <= AT_ONCE:
            return sum(map(known, self.pattern.findall(text)))
        return sum(known(m.group()) for m in self.pattern.finditer(text))


_counters: dict[str, TextCounter] = {}


def _counter(vocabulary: dict) -> TextCounter:
    """One counter per worker process and vocabulary, kept between batches and tasks."""
    if vocabulary["name"] not in _counters:
        _counters.clear()
        _counters[vocabulary["name"]] = TextCounter(vocabulary)
    return _counters[vocabulary["name"]]


def count_texts(texts: Iterable[str], vocabulary: dict) -> list[int]:
    return list(map(_counter(vocabulary), texts))


def token_count(df: DataFrame, text: Column, path: str) -> Column:
    """A column with the number of tokens of ``text``."""
    long_texts(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(count_texts(batch, shared.value), dtype="int64")

    return counted(text)


def token_counts(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024
) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit``, a row for each row of ``df``.

    A narrow pass: nothing is shuffled, and a worker keeps a bounded memory of words. A null text
    is an empty one with 0 bytes and tokens; a null id stays; repeated rows stay; other columns,
    whatever their names, are not looked at; an empty table gives an empty result.
    """
    text = text_of(text_col)
    counted = df.select(F.col(id_col).alias(id_col), text.alias("_text"))
    return counted.select(
        id_col,
        F.octet_length("_text").cast("long").alias("n_bytes"),
        token_count(df, F.col("_text"), path).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
