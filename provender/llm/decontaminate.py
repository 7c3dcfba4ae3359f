"""Removing benchmark passages with a generalised suffix automaton of the test items.

All items go into one suffix automaton over words. The words of a document are streamed through
it; after each word the automaton's state is the longest run of words ending there that occurs in
some item. Where that run reaches the window length (or is a whole item that is shorter), the
words of the window are hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.llm.common import cut, free_name, long_texts, text_of

#: Words of items in one automaton; more items go into further automata and passes. An automaton
#: of this size takes at most some hundred MB in a worker.
WORDS_AT_ONCE = 250_000

# A-Z to a-z; what is no digit, letter or byte of a longer character to a space.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Words of a text: runs of digits, letters (A-Z lower-cased) and characters beyond ASCII."""
    return text.encode().translate(_WORDS).split()


class Automaton:
    """Suffix automaton of many word sequences, with the items that a window belongs to."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.owners: list[set[int]] = [set()]
        ends: dict[int, list[tuple[int, int]]] = {}
        self.shortest = window
        for number, (_, words) in enumerate(items):
            if not words:
                continue
            state = 0
            for word in words:
                state = self._extend(state, self.vocabulary.setdefault(word, len(self.vocabulary)))
                self.owners[state].add(number)
            if len(words) < window:
                self.shortest = min(self.shortest, len(words))
                ends.setdefault(state, []).append((len(words), number))
        self._finish(ends)

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.owners.append(set())
        return len(self.next) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """The state of the longest run through ``state`` into ``target``, split off if needed."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        state, fresh = last, self._new(self.length[last] + 1, 0, {})
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = fresh
            state = self.link[state]
        if state >= 0:
            self.link[fresh] = self._split(state, word, self.next[state][word])
        return fresh

    def _finish(self, ends: dict[int, list[tuple[int, int]]]) -> None:
        """Pass owners up the links; note for each state its window's state and whole short items."""
        size = len(self.next)
        order = sorted(range(1, size), key=self.length.__getitem__)
        for state in reversed(order):
            if self.length[state] >= self.window:
                parent = self.link[state]
                if self.length[parent] >= self.window:
                    self.owners[parent] |= self.owners[state]
        self.holds = [-1] * size  # the state whose runs include the last ``window`` words
        self.whole: list[tuple[tuple[int, int], ...]] = [()] * size
        for state in order:
            parent = self.link[state]
            if self.length[state] >= self.window:
                self.holds[state] = state if self.length[parent] < self.window else self.holds[parent]
            self.whole[state] = self.whole[parent] + tuple(ends.get(state, ()))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans of word positions (from, to), in order of their ends, and the items that occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if len(words) < self.shortest or not self.vocabulary:
            return spans, found
        lookup = self.vocabulary.get
        ids = [lookup(w, -1) for w in words]
        known = np.fromiter(ids, np.int64, len(ids)) >= 0
        edges = np.flatnonzero(np.diff(known, prepend=False, append=False))
        # Words outside the vocabulary lead back to the start, so only long enough runs matter.
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - begin >= self.shortest:
                self._run(ids, begin, end, spans, found)
        return spans, found

    def _run(self, ids, begin, end, spans, found) -> None:
        step, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for i in range(begin, end):
            word = ids[i]
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            if word in step[state]:
                state = step[state][word]
                matched += 1
            reach = 0
            if matched >= window:
                reach = window
                # the state may hold longer runs than matched, but its window is the same
                found |= self.owners[self.holds[state]]
            for size, item in self.whole[state]:
                if size <= matched:
                    reach = max(reach, size)
                    found.add(item)
            if reach:
                spans.append((i + 1 - reach, i + 1))


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    joined: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if joined and begin <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(end, joined[-1][1]))
        else:
            joined.append((begin, end))
    return joined


def item_pieces(items: DataFrame, item_col: str, text_col: str, window: int, limit: int) -> DataFrame:
    """``item, words, whole`` with items of over ``limit`` words cut into overlapping pieces, so
    that every window lies in one of them."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item"], batch["text"], strict=True):
                words = words_of(text)
                for at in range(0, max(1, len(words) - window + 1), limit):
                    piece = words[at : at + limit + window - 1]
                    rows.append((item, b" ".join(piece), len(piece)))
            yield pd.DataFrame(rows, columns=["item", "words", "n"])

    read = items.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), text_of(text_col).alias("text")
    )
    # Once each, or an item that is repeated much would fill one group of the automata.
    return read.mapInPandas(pieces, "item string, words binary, n long").where("n > 0").distinct()


def automaton_parts(pieces: DataFrame, limit: int) -> list[list[tuple[str, bytes]]] | Iterator:
    """Pieces in groups of about ``limit`` words, fetched one group at a time."""
    total = pieces.agg(F.sum("n")).first()[0] or 0
    groups = -(-int(total) // limit)
    if groups <= 1:
        yield [(r["item"], bytes(r["words"])) for r in pieces.collect()] if total else []
        return
    # Twice the groups needed, so that one that is fuller than the mean still is of bounded size.
    for group in range(2 * groups):
        held = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(2 * groups)) == group)
        yield [(r["item"], bytes(r["words"])) for r in held.collect()]


def contamination(
    df: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
) -> DataFrame:
    """``df`` with ``_n_words``, ``_spans`` (hit word positions, from and to) and ``_items``.

    A narrow pass over the documents for every ``WORDS_AT_ONCE`` words of items; the broadcast is
    an automaton of bounded size, and passes beyond the first start from a checkpoint. Null texts
    have no words; items without words are ignored; items that repeat count once by id. Empty
    tables give empty results or no hits. A document of any length is one stream.
    """
    long_texts(df.sparkSession)
    names = [c for c in df.columns if c not in ("_n_words", "_spans", "_items")]
    done = df.select(*names)
    pieces = cut(item_pieces(items, item_col, item_text_col, window, WORDS_AT_ONCE))
    for number, part in enumerate(automaton_parts(pieces, WORDS_AT_ONCE)):
        scanned = scanner(df.sparkSession.sparkContext.broadcast(part), window)
        found = done.withColumn("_found", scanned(text_of(text_col)))
        if number == 0:
            done = found.select(
                *names,
                F.col("_found.n_words").alias("_n_words"),
                F.col("_found.spans").alias("_spans"),
                F.col("_found.items").alias("_items"),
            )
        else:
            done = cut(
                found.select(
                    *names,
                    "_n_words",
                    _joined_spans("_spans", "_found.spans").alias("_spans"),
                    F.array_union("_items", "_found.items").alias("_items"),
                )
            )
    return done


def scanner(shared: Broadcast, window: int):
    """A function on text columns that streams texts through the automaton of the shared items."""

    @F.pandas_udf("n_words long, spans array<struct<begin:int,end:int>>, items array<string>")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = Automaton([(i, w.split(b" ")) for i, w in shared.value], window)
        for texts in batches:
            rows = []
            for text in texts:
                words = words_of(text)
                spans, found = automaton.hits(words)
                owners = sorted({automaton.names[i] for i in found})
                rows.append((len(words), [{"begin": a, "end": b} for a, b in union(spans)], owners))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    # Else a filter on the result would be pushed down and have each text scanned again.
    return scanned.asNondeterministic()


def _joined_spans(first: str, second: str) -> Column:
    """The union of two lists of spans, in order."""

    @F.pandas_udf("array<struct<begin:int,end:int>>")
    def joined(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(
            [
                [
                    {"begin": s, "end": e}
                    for s, e in union([(x["begin"], x["end"]) for x in [*one, *other]])
                ]
                for one, other in zip(a, b, strict=True)
            ]
        )

    return joined(F.col(first), F.col(second))


def hit_words(spans: str = "_spans") -> Column:
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])


def is_contaminated(share: int = 20) -> Column:
    """At least one word in ``share`` is hit."""
    return (hit_words() > 0) & (hit_words() * share >= F.col("_n_words"))


def contamination_report(df: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, n_words, n_hit, n_items, items_sha256, contaminated``, a row for each of ``df``."""
    read = df.select(F.col(id_col).alias(id_col), F.col("text"))
    scanned = contamination(read, items)
    return scanned.select(
        id_col,
        F.col("_n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def remove_spans(
    df: DataFrame, items: DataFrame, text_col: str = "text", window: int = 13, length_col: str | None = None
) -> DataFrame:
    """The columns of ``df`` with the hit words cut out of contaminated texts.

    What stood between two words that stay is kept as it was; where a span is cut, one space
    stands. A text whose every word is hit becomes empty. Clean documents are left alone, null texts
    stay null, and repeated rows stay. ``length_col`` names a column with the texts' lengths in
    characters; it is set anew where a text was cut. Columns of ``df`` may have any names.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    packed = df.select(F.struct(F.lit(0).alias(free_name(df, "_")), *others).alias("row"), F.col(text_col).alias("text"))
    scanned = contamination(packed, items, "text", window=window)

    @F.pandas_udf("string")
    def trimmed(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without(t, [(s["begin"], s["end"]) for s in x]) for t, x in zip(texts, spans, strict=True)])

    text = F.when(is_contaminated(), trimmed(text_of("text"), F.col("_spans"))).otherwise(F.col("text"))
    cut_texts = scanned.select("row", is_contaminated().alias("hit"), text.alias("text"))

    def column(name: str) -> Column:
        kind = df.schema[name].dataType
        if name == text_col:
            return F.col("text").cast(kind).alias(name)
        same = F.col("row").getField(name)
        if name == length_col:
            return F.when(F.col("hit"), F.length("text").cast(kind)).otherwise(same).alias(name)
        return same.alias(name)

    return cut_texts.select(*map(column, df.columns))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words in ``spans``."""
    if not spans:
        return text
    raw = text.encode()
    shaped = np.frombuffer(raw.translate(_WORDS), np.uint8) != 32
    edges = np.flatnonzero(np.diff(shaped, prepend=False, append=False))
    starts, stops = edges[::2], edges[1::2]
    kept, at = [], 0
    for begin, end in spans:
        kept.append(raw[at : starts[begin]])
        at = int(stops[end - 1])
    kept.append(raw[at:])
    return b" ".join(kept).decode()

