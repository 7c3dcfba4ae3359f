"""Scoring texts with a hierarchical Pitman-Yor language model.

The model predicts a word from the one before. Every word that occurs in a training text has a
restaurant of its own for what follows it, so what is gathered grows with the corpus. All these
share a parent, one restaurant for the whole corpus, whose base is uniform over the training
vocabulary and one unknown word.

Restaurants are dealt over shards by hash of their word, so all customers of one are in one shard.
A word with a large share of all tokens is dealt by the word that follows, and its totals are
summed up; there is a bounded number of these. In a turn, shards seat their customers in several
sweeps (``restaurants``) and send the tables of each word, which are its customers in the corpus
restaurant, to the word's home; homes seat these and send each shard what it needs for its words.
Turns before the last are burn-in. The last one yields ``SAMPLES`` seatings of both levels, whose
predictive probabilities are averaged.

Within a turn, shards draw a word's weight in the corpus from the seating that the homes have
(a gamma variable, the part of the base by its mean), and keep it and the totals of dealt-out
restaurants for the turn. Randomness is a hash of the words concerned, so scores do not depend on
partitions.

Tokens travel in packed blocks once, pairs of words (with their number of customers) in each turn.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.llm import restaurants
from provender.llm.common import cut, let_go, long_texts, partitions, text_of

#: A word is dealt out over shards if it makes up one in so many training tokens.
FREQUENT = 4096
#: Discounts and strengths of the corpus and of the words.
DISCOUNT, STRENGTH = (0.6, 0.8), (20.0, 2.0)
#: Turns of burn-in, sweeps of each; seatings that are averaged, and sweeps up to each.
BURN_IN, SWEEPS, SAMPLES, APART = 2, 2, 3, 2
#: Tokens and rows packed at once; they bound the memory of a task that packs.
TOKENS, ROWS = 1_000_000, 16_000
#: Tokens after which a task reports the frequent words that it has seen.
COUNTED = 2_000_000
#: Training tokens of a shard, about, at most and (where there are partitions for more) at least,
#: and shards that a task has, one after the other.
SHARD_TOKENS, LEAST_TOKENS, SHARDS = 2_000_000, 200_000, 3

# Kinds of rows: what is known of texts, tokens, a shard's pairs of words, where its texts have
# them, its seatings, words sent home, a home's words and where shards have them, the homes'
# answers, sums over texts, and totals.
ABOUT, TOKENS_OF, PAIRS, POSTINGS, SEATS, REPORT, WORDS, INDEX, ANSWER, SUMS, TOTAL = range(11)
# Keys of totals: tokens and vocabulary, then customers and tables of the corpus by seating, then
# those of dealt-out restaurants.
SIZES, CORPUS, DEALT = 0, 1, 1000


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 1


def words_of(text: str) -> list[bytes]:
    """Words of a text (A-Z lower-cased, cut at ASCII white space) and the end, an empty word."""
    words = text.encode().lower().split()
    words.append(b"")
    return words


def frequent_words(texts: DataFrame) -> tuple[list[bytes], int]:
    """The end and all words that make up about one in ``FREQUENT`` tokens, of which there can be
    at most as many, and the number of tokens. A word that does so overall is above a sixteenth of
    that share somewhere; tasks report those words and how often they saw them. Whether a word is
    on the list decides only where its context is counted, not what it predicts."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> pd.DataFrame:
            least = max(1, seen // (16 * FREQUENT))
            common = [(w, n) for w, n in counts.items() if n >= least]
            return pd.DataFrame([*common, (None, seen)], columns=["word", "n"])

        counts: Counter = Counter()
        seen = 0
        for batch in batches:
            for text in batch["text"]:
                words = words_of(text)
                counts.update(words)
                seen += len(words)
                if seen > COUNTED:
                    yield rows()
                    counts, seen = Counter(), 0
        yield rows()

    sums = texts.mapInPandas(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    sums = cut(sums)
    total = sums.where("word is null").select(F.sum("n")).first()[0] or 0
    common = sums.where((F.col("word") != b"") & (F.col("n") * FREQUENT >= total)).select("word")
    return [b"", *sorted(bytes(r[0]) for r in common.collect())], total


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays, whole numbers in their smallest type, compressed byte place by byte place."""
    parts = []
    for name, array in arrays.items():
        if array.dtype.kind in "iu" and len(array) and array.min() >= 0:
            array = array.astype(np.min_scalar_type(int(array.max())))
        planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.dtype.itemsize).T
        parts.append(f"{name},{array.dtype.str},{len(array)}".encode() + b"\n" + planes.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(block: bytes) -> dict[str, np.ndarray]:
    raw, at, arrays = zstandard.ZstdDecompressor().decompress(block), 0, {}
    while at < len(raw):
        line = raw.index(b"\n", at)
        name, kind, size = raw[at:line].decode().split(",")
        size, width = int(size), np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, size * width, line + 1).reshape(width, size)
        arrays[name] = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
        at = line + 1 + size * width
    return arrays


def _hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))

def _hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


#: Rows that steps exchange: where to, of what kind, from which shard, and a packed block or a total.
ROW = "to long, kind long, source long, block binary, key long, a double, b double"
_FIELDS = ("to", "kind", "source", "block", "key", "a", "b")
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64())


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of ``ROW``; those with a block may leave out the rest."""
    rows = [(*r, *[None] * (7 - len(r))) for r in rows]
    columns = zip(*rows, strict=True) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)], list(_FIELDS))


def _steps(values: np.ndarray) -> np.ndarray:
    """Sorted numbers as differences, which pack well."""
    return np.diff(values, prepend=values.dtype.type(0))


def _home_of(rows: np.ndarray, shards: int) -> np.ndarray:
    """Where the sums of a row meet."""
    return (restaurants.mixed(rows, 77) % np.uint64(shards)).astype(np.int64)


def _home_of_word(short: np.ndarray, shards: int) -> np.ndarray:
    """Where the sums of a word meet, by the upper half of its hash: homes hold ranges of hashes."""
    return (short * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _shard_of(before: np.ndarray, word: np.ndarray, dealt: np.ndarray, often: np.ndarray, shards: int) -> np.ndarray:
    """Pairs by hash of the first word; those of a dealt-out word by that of the second, and of both
    if the second one is as frequent."""
    key = np.where(dealt, np.where(often, restaurants.mixed(before, 78) ^ word, word), before)
    return (restaurants.mixed(key, 79) % np.uint64(shards)).astype(np.int64)


class Packer:
    """Gathers tokens of a task's rows and packs them by shard."""

    def __init__(self, common: dict[bytes, int], shards: int):
        self.common, self.shards = common, shards
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.owner: list[np.ndarray] = []
        self.rows: list[tuple[int, str | None, bool, int]] = []
        self.size = 0

    def add(self, row: int, identity: str | None, out: bool, words: list[bytes], before: bytes) -> None:
        number = self.number
        size = len(number)
        ids = []
        for word in words:
            i = number.get(word)
            if i is None:
                number[word] = i = size
                size += 1
            ids.append(i)
        first = number.setdefault(before, size)
        ids = np.array(ids, np.int32)
        self.words.append(ids)
        self.before.append(np.concatenate([[first], ids[:-1]]).astype(np.int32))
        self.owner.append(np.full(len(ids), len(self.rows), np.int32))
        self.rows.append((row, identity, out, len(ids)))
        self.size += len(ids)

    def full(self) -> bool:
        return self.size >= TOKENS or len(self.rows) >= ROWS

    def blocks(self) -> list[tuple[int, int, int, bytes]]:
        """Rows with tokens for shards, and with what is known of the texts for their homes."""
        if not self.rows:
            return []
        # Words in order of their hashes, so that a block's hashes are sorted and their steps small.
        vocabulary = list(self.number)
        hashes = _hash(vocabulary)
        order = np.argsort(hashes)
        hashes, vocabulary = hashes[order], [vocabulary[i] for i in order.tolist()]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        common = np.array([self.common.get(w, -1) for w in vocabulary], np.int64)
        # At most 2 * TOKENS words and ROWS owners: 22 + 22 + 18 bits.
        key = (rank[np.concatenate(self.before)] << 40) | (rank[np.concatenate(self.words)] << 18) | np.concatenate(self.owner)
        key, times = np.unique(key, return_counts=True)
        before, word, owner = key >> 40, (key >> 18) & 0x3FFFFF, key & 0x3FFFF
        shard = _shard_of(hashes[before], hashes[word], common[before] >= 0, common[word] >= 0, self.shards)
        row, identity, out, sizes = zip(*self.rows, strict=True)
        row, out = np.array(row, np.int64), np.array(out)
        result = []
        order = np.argsort(shard, kind="stable")
        starts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in range(self.shards):
            mine = order[starts[s] : starts[s + 1]]
            if len(mine):
                own = np.unique(np.concatenate([before[mine], word[mine]]))
                result.append((s, TOKENS_OF, 0, pack(
                    rows=_steps(row), out=out.astype(np.uint8), hashes=_steps(hashes[own]), common=common[own] + 1,
                    before=_steps(np.searchsorted(own, before[mine])), word=np.searchsorted(own, word[mine]),
                    owner=owner[mine], times=times[mine] - 1,
                )))
        home = _home_of(row, self.shards)
        for s in np.unique(home).tolist():
            mine = np.flatnonzero(home == s)
            ids = [identity[i] for i in mine.tolist()]
            plain = [b"" if i is None else i.encode() for i in ids]
            result.append((s, ABOUT, 0, pack(
                row=row[mine], known=np.array([i is not None for i in ids], np.uint8), out=out[mine].astype(np.uint8),
                n=np.array(sizes, np.int64)[mine], lengths=np.array(list(map(len, plain)), np.int64),
                ids=np.frombuffer(b"".join(plain), np.uint8),
            )))
        self.clear()
        return result


def built(shard: int, blocks: list[bytes], shards: int) -> list[tuple]:
    """A shard's pairs of words with their training customers, the places of its pairs in texts,
    its words with their training tokens and contexts for their homes, and its totals."""
    parts = [unpack(b) for b in blocks]
    hashes = np.concatenate([np.cumsum(p["hashes"].astype(np.uint64), dtype=np.uint64) for p in parts])
    words, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    common = np.concatenate([p["common"] for p in parts]).astype(np.int64)[first]
    key, row, times, counted, base = [], [], [], [], 0
    for p in parts:
        before, word = which[base + np.cumsum(p["before"].astype(np.int64))], which[base + p["word"].astype(np.int64)]
        base += len(p["hashes"])
        key.append(before << 32 | word)
        row.append(np.cumsum(p["rows"].astype(np.int64))[p["owner"]])
        times.append(p["times"].astype(np.int64) + 1)
        counted.append(times[-1] * (p["out"][p["owner"]] == 0))
    key, row, times, counted = map(np.concatenate, (key, row, times, counted))
    pairs, at = np.unique(key, return_inverse=True)
    customers = np.bincount(at, counted, minlength=len(pairs)).astype(np.int64)
    order = np.lexsort((row, at))
    rows, owner = np.unique(row, return_inverse=True)
    before, word = pairs >> 32, pairs & 0xFFFFFFFF
    short = words >> np.uint64(32)
    level = Level(short, common, before, word, customers, shards)
    return [
        (shard, PAIRS, shard, pack(short=_steps(short), common=common, before=_steps(before), word=word, customers=customers)),
        (shard, POSTINGS, shard, pack(pair=_steps(at[order]), rows=_steps(rows), owner=owner[order], times=times[order] - 1)),
        *level.report(shard, [level.first()], words),
    ]


class Level:
    """The restaurants of a shard's words, which are sorted by hash.

    Only the upper halves of hashes are kept, as keys of random numbers, which words may share."""

    def __init__(self, short, common, before, word, customers, shards: int):
        self.short, self.common, self.before, self.word = short, common, before, word
        self.customers, self.shards = customers, shards
        self.words = restaurants.mixed(short, 4)
        self.keys = restaurants.mixed(self.words[before], 5) ^ self.words[word]
        self.moving = np.flatnonzero(customers > 1)
        self.all_customers = np.bincount(before, customers, minlength=len(short))

    @classmethod
    def of(cls, block: bytes, shards: int) -> Level:
        p = unpack(block)
        whole = {k: p[k].astype(np.int64) for k in ("common", "word", "customers")}
        short = np.cumsum(p["short"].astype(np.uint64), dtype=np.uint64)
        return cls(short, whole["common"], np.cumsum(p["before"].astype(np.int64)), whole["word"], whole["customers"], shards)

    def first(self) -> np.ndarray:
        """The seating at the start: one table for each pair."""
        return np.minimum(self.customers, 1)

    def all_tables(self, seats: np.ndarray, dealt: np.ndarray) -> np.ndarray:
        """Tables of each word's restaurant; ``dealt`` has those of dealt-out ones."""
        own = np.bincount(self.before, seats, minlength=len(self.words))
        return np.where(self.common > 0, dealt[np.maximum(self.common - 1, 0)], own)

    def sweep(self, seats: np.ndarray, weight: np.ndarray, dealt: np.ndarray, salt: int) -> np.ndarray:
        """All customers seated anew, for the words' weights in the corpus."""
        d, s = DISCOUNT[1], STRENGTH[1]
        x = restaurants.gamma(s / d + self.all_tables(seats, dealt), self.words, salt)
        who = self.moving
        seats = seats.copy()
        seats[who] = restaurants.tables(
            self.customers[who], d * x[self.before[who]] * weight[self.word[who]], d, self.keys[who], salt
        )
        return seats

    def report(self, shard: int, seatings: list[np.ndarray], hashes: np.ndarray | None = None) -> list[tuple]:
        """Rows for homes (tables of each word in each seating, at first with its hash and tokens)
        and totals of dealt-out restaurants."""
        size = len(self.words)
        values = {f"tables{i}": np.bincount(self.word, s, minlength=size).astype(np.int64) for i, s in enumerate(seatings)}
        if hashes is not None:
            values["tokens"] = np.bincount(self.word, self.customers, minlength=size).astype(np.int64)
        rows = []
        cuts = np.searchsorted(_home_of_word(self.short, self.shards), np.arange(self.shards + 1)).tolist()
        for home in range(self.shards):
            mine = slice(cuts[home], cuts[home + 1])
            if cuts[home] < cuts[home + 1]:
                parts = {k: v[mine] for k, v in values.items()}
                if hashes is not None:
                    parts["hashes"] = _steps(hashes[mine])
                rows.append((home, REPORT, shard, pack(**parts)))
        dealt = np.flatnonzero((self.common > 0) & (self.all_customers > 0))
        for i, s in enumerate(seatings):
            tables = np.bincount(self.before, s, minlength=size)
            for w in dealt.tolist():
                key = DEALT + (int(self.common[w]) - 1) * SAMPLES + i
                rows.append((shard, TOTAL, shard, None, key, float(self.all_customers[w]), float(tables[w])))
        return rows

    def answers(self, blocks: list[tuple[int, bytes]]) -> dict[str, np.ndarray]:
        """What homes say of each word: by seating ``customers0``, ``tables0``, ..., and at the end
        ``tokens``."""
        parts = [unpack(b) for _, b in sorted(blocks)]
        return {k: np.concatenate([p[k].astype(np.int64) for p in parts]) for k in parts[0]}


class Totals:
    """Sums over all shards and homes, of a bounded number of entries."""

    def __init__(self, rows: DataFrame, dealt: int):
        found = rows.where(F.col("kind") == TOTAL).groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toPandas()
        self.sums = np.zeros((2, DEALT + dealt * SAMPLES))
        self.sums[:, found["key"].to_numpy(int)] = found[["a", "b"]].to_numpy(float).T

    def dealt(self, seating: int) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of the dealt-out restaurants."""
        return self.sums[0, DEALT + seating :: SAMPLES], self.sums[1, DEALT + seating :: SAMPLES]

    def corpus(self, seating: int) -> tuple[float, float]:
        return self.sums[0, CORPUS + seating], self.sums[1, CORPUS + seating]

    @property
    def tokens(self) -> float:
        return self.sums[0, SIZES]

    @property
    def vocabulary(self) -> float:
        return self.sums[1, SIZES]


def predicted(customers, tables, all_customers, all_tables, above, level: int):
    """The predictive probability of dishes, that of the level above given."""
    given = customers - DISCOUNT[level] * tables + (STRENGTH[level] + DISCOUNT[level] * all_tables) * above
    return np.where(all_customers > 0, given / (STRENGTH[level] + all_customers), above)


def home(number: int, kinds: dict, last: Totals | None, turn: int) -> list[tuple]:
    """The corpus restaurant's part at a home: answers to each shard that asked, and totals.

    At the start each word has one table, and the home makes its list of words; after that all
    customers are seated once in a turn."""
    reports = [(shard, unpack(b)) for shard, b in sorted(kinds[REPORT])]
    rows = []
    if last is None:
        hashes = [np.cumsum(p["hashes"].astype(np.uint64), dtype=np.uint64) for _, p in reports]
        words, at = np.unique(np.concatenate(hashes), return_inverse=True)
        places = np.split(at, np.cumsum([len(h) for h in hashes])[:-1])
        short = words >> np.uint64(32)
        tokens = np.bincount(at, np.concatenate([p["tokens"] for _, p in reports])).astype(np.int64)
        rows.append((number, WORDS, number, pack(short=_steps(short), tokens=tokens)))
        rows.extend((number, INDEX, s, pack(at=_steps(own))) for (s, _), own in zip(reports, places, strict=True))
    else:
        known, index = unpack(kinds[WORDS][0][1]), dict(kinds[INDEX])
        short, tokens = np.cumsum(known["short"].astype(np.uint64), dtype=np.uint64), known["tokens"].astype(np.int64)
        places = [np.cumsum(unpack(index[s])["at"].astype(np.int64)) for s, _ in reports]
        at = np.concatenate(places)
    rows.append((number, TOTAL, number, None, SIZES, float(tokens.sum()), float((tokens > 0).sum())))
    whole = {"tokens": tokens} if turn > BURN_IN else {}
    for i in range(sum(k.startswith("tables") for k in reports[0][1])):
        given = np.concatenate([p[f"tables{i}"] for _, p in reports])
        customers = np.bincount(at, given, minlength=len(short)).astype(np.int64)
        if last is None:
            tables = np.minimum(customers, 1)
        else:
            d, one, salt = DISCOUNT[0], np.zeros(1, np.uint64), 1000 * turn + 900 + i
            x = restaurants.gamma(np.array([STRENGTH[0] / d + last.corpus(0)[1]]), one, salt)[0]
            weight = np.full(len(short), d * x / (last.vocabulary + 1))
            tables = restaurants.tables(customers, weight, d, restaurants.mixed(short, 6), salt)
        whole |= {f"customers{i}": customers, f"tables{i}": tables}
        rows.append((number, TOTAL, number, None, CORPUS + i, float(customers.sum()), float(tables.sum())))
    for (shard, _), own in zip(reports, places, strict=True):
        rows.append((shard, ANSWER, number, pack(**{k: v[own] for k, v in whole.items()})))
    return rows


def turned(shard: int, level: Level, seats: np.ndarray, answers: dict, totals: Totals, turn: int) -> list[tuple]:
    """A turn of a shard: its seatings, and what it reports."""
    all_customers, all_tables = totals.corpus(0)
    shape = answers["customers0"] - DISCOUNT[0] * answers["tables0"]
    shape = shape + (STRENGTH[0] + DISCOUNT[0] * all_tables) / (totals.vocabulary + 1)
    weight = restaurants.gamma(shape, level.words, 1000 * turn + 999) / (STRENGTH[0] + all_customers)
    weight = np.maximum(weight, 1e-300)
    dealt = totals.dealt(0)[1]
    last = turn == BURN_IN
    seatings = []
    for sample in range(SAMPLES if last else 1):
        for sweep in range(APART if last else SWEEPS):
            seats = level.sweep(seats, weight, dealt, 1000 * turn + 50 * sample + sweep)
        seatings.append(seats)
    block = pack(**{f"seats{i}": s[level.moving] for i, s in enumerate(seatings)})
    return [(shard, SEATS, shard, block), *level.report(shard, seatings)]


def probabilities(level: Level, seatings: list[np.ndarray], answers: dict, totals: Totals) -> np.ndarray:
    """Of each pair: the mean over the seatings of its predictive probability."""
    mean = np.zeros(len(level.word))
    for i, seats in enumerate(seatings):
        corpus = predicted(
            answers[f"customers{i}"], answers[f"tables{i}"], *totals.corpus(i), 1 / (totals.vocabulary + 1), 0
        )
        dealt_customers, dealt_tables = totals.dealt(i)
        customers = np.where(level.common > 0, dealt_customers[np.maximum(level.common - 1, 0)], level.all_customers)
        tables = level.all_tables(seats, dealt_tables)
        at = level.before
        mean += predicted(level.customers, seats, customers[at], tables[at], corpus[level.word], 1) / len(seatings)
    return mean


def _by_place(batches: Iterator[pa.RecordBatch]) -> dict[int, dict[int, list[tuple[int, bytes]]]]:
    """Blocks (with their source) of a partition by where they go and kind."""
    found: dict[int, dict[int, list[tuple[int, bytes]]]] = {}
    for batch in batches:
        for to, kind, source, block in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            found.setdefault(to, {}).setdefault(kind, []).append((source, block))
    return found


def _each(work):
    """``work(number, blocks by kind)`` for each shard or home of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _by_place(batches)
        for number in sorted(found):
            yield _rows(work(number, found.pop(number)))

    return run


def _seatings(level: Level, blocks: list[tuple[int, bytes]]) -> list[np.ndarray]:
    if not blocks:
        return [level.first()]
    found = []
    for values in unpack(blocks[0][1]).values():
        seats = level.first()
        seats[level.moving] = values
        found.append(seats)
    return found


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score``, a row for each of ``df``.

    Null and empty texts are the end alone. Ids may be of any type that is read back from its text;
    a row without an id hashes as the empty text. Rows that repeat are scored, and learnt from, each
    for itself. Without any training row the model is the uniform distribution over one unknown
    word. An empty table gives no rows; other columns are not looked at. A long text is packed in
    several blocks whose sums meet again.
    """
    spark = df.sparkSession
    long_texts(spark)
    kind = df.schema[id_col].dataType
    read = df.select(F.col(id_col).cast("string").alias("id"), held_out(id_col).alias("out"), text_of(text_col).alias("text"))
    common, size = frequent_words(read.where("not out").select("text"))
    # By tokens, as shards and homes exchange a block for each two of them.
    shards = max(1, -(-size // SHARD_TOKENS), min(partitions(spark), size // LEAST_TOKENS))
    tasks = -(-shards // SHARDS)
    shared = spark.sparkContext.broadcast(common)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(tasks, F.floor(F.col("to") / SHARDS).cast("int"))

    def of(rows: DataFrame, *kinds: int) -> DataFrame:
        return rows.where(F.col("kind").isin(*kinds))

    packed = read.mapInArrow(_packing(shared, shards), ROW)
    rows = cut(dealt(packed).mapInArrow(_each(_building(shards)), ROW))
    base, seats, totals = of(rows, PAIRS), of(rows, SEATS), None
    about_and_postings, index = of(rows, ABOUT, POSTINGS), None
    for turn in range(BURN_IN + 2):
        asked = of(rows, REPORT) if index is None else of(rows, REPORT).union(index)
        homes = cut(dealt(asked).mapInArrow(_each(_seating(spark.sparkContext.broadcast(totals), turn)), ROW))
        index = of(homes, WORDS, INDEX) if index is None else index
        totals = Totals(of(rows, TOTAL).union(homes), len(common))
        known = spark.sparkContext.broadcast(totals)
        answers = of(homes, ANSWER)
        let_go(spark)
        if turn <= BURN_IN:
            rows = cut(dealt(base.union(seats).union(answers)).mapInArrow(_each(_turning(known, shards, turn)), ROW))
            seats = of(rows, SEATS)
    placed = dealt(about_and_postings.union(base).union(seats).union(answers))
    parts = placed.mapInArrow(_scoring(known, shards), ROW)
    sums = parts.repartitionById(shards, F.col("to").cast("int")).mapInArrow(
        _adding, "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return sums.select(
        F.col("id").cast(kind).alias(id_col), "held_out", "n_tokens", "n_known",
        F.lit(int(totals.tokens)).cast("long").alias("train_tokens"), "base_score", "score",
    )


def _packing(shared: Broadcast, shards: int):
    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer({w: i for i, w in enumerate(shared.value)}, shards)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(batch.num_rows):
                identity, out, text = (batch.column(i)[at].as_py() for i in range(3))
                words, before = words_of(text), b""
                for begin in range(0, len(words), TOKENS):
                    piece = words[begin : begin + TOKENS]
                    packer.add(row, identity, out, piece, before)
                    before = piece[-1]
                    if packer.full():
                        yield _rows(packer.blocks())
                row += 1
        yield _rows(packer.blocks())

    return packing


def _building(shards: int):
    def work(number: int, kinds: dict) -> list[tuple]:
        rows = [(number, ABOUT, 0, b) for _, b in kinds.get(ABOUT, [])]
        tokens = [b for _, b in kinds.get(TOKENS_OF, [])]
        return rows + (built(number, tokens, shards) if tokens else [])

    return work


def _seating(last: Broadcast, turn: int):
    def work(number: int, kinds: dict) -> list[tuple]:
        return home(number, kinds, last.value, turn)

    return work


def _turning(known: Broadcast, shards: int, turn: int):
    def work(number: int, kinds: dict) -> list[tuple]:
        level = Level.of(kinds[PAIRS][0][1], shards)
        answers = level.answers(kinds[ANSWER])
        return turned(number, level, _seatings(level, kinds.get(SEATS, []))[-1], answers, known.value, turn)

    return work


def _scoring(known: Broadcast, shards: int):
    """Sums of each row's tokens in the shards of a task, sent to the row's home."""

    def scored(kinds: dict) -> tuple[np.ndarray, ...]:
        """Rows, known tokens, base scores and scores; all else of the shard is let go."""
        totals = known.value
        level = Level.of(kinds[PAIRS][0][1], shards)
        answers = level.answers(kinds[ANSWER])
        logs = np.log10(probabilities(level, _seatings(level, kinds[SEATS]), answers, totals))
        unigram = np.log10((answers["tokens"] + 0.5) / (totals.tokens + 0.5 * (totals.vocabulary + 1)))[level.word]
        seen = (answers["tokens"] > 0)[level.word]
        part = unpack(kinds[POSTINGS][0][1])
        pair, at = np.cumsum(part["pair"].astype(np.int64)), part["owner"].astype(np.int64)
        times, rows = part["times"].astype(np.int64) + 1, np.cumsum(part["rows"].astype(np.int64))
        return rows, *(np.bincount(at, values[pair] * times) for values in (seen, unigram, logs))

    def scoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _by_place(batches)
        yield _rows([(n, ABOUT, 0, b) for n in sorted(found) for _, b in found[n].pop(ABOUT, [])])
        tables = [scored(found.pop(n)) for n in sorted(found) if PAIRS in found[n]]
        if tables:
            yield _rows(_sum_blocks(tables, shards))

    return scoring


def _sum_blocks(tables: list[tuple[np.ndarray, ...]], shards: int) -> list[tuple]:
    """Rows with the sums that a task's shards have for each text, for their homes."""
    rows, at = np.unique(np.concatenate([t[0] for t in tables]), return_inverse=True)
    seen, base, score = (np.bincount(at, np.concatenate([t[i] for t in tables])) for i in (1, 2, 3))
    home = _home_of(rows, shards)
    order = np.argsort(home, kind="stable")
    starts = np.searchsorted(home[order], np.arange(shards + 1))
    result = []
    for s in range(shards):
        own = order[starts[s] : starts[s + 1]]
        if len(own):
            known = seen[own].astype(np.int64)
            result.append((s, SUMS, 0, pack(row=_steps(rows[own]), n=known, base=base[own], score=score[own])))
    return result


def _adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their sums."""
    about, sums = [], []
    for batch in batches:
        for kind, block in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            (sums if kind == SUMS else about).append(block)
    about = [unpack(b) for b in about]
    if not about:
        return
    names = []
    for p in about:
        ends = np.cumsum(p["lengths"].astype(np.int64)).tolist()
        whole = p["ids"].tobytes()
        names.extend(whole[a:b].decode() for a, b in zip([0, *ends], ends, strict=False))
    texts = {k: np.concatenate([p[k].astype(np.int64) for p in about]) for k in ("row", "known", "out", "n")}
    rows, first, which = np.unique(texts["row"], return_index=True, return_inverse=True)
    size = len(rows)
    n_known, base, score = np.zeros(size), np.zeros(size), np.zeros(size)
    for block in sorted(sums, key=zlib.crc32):
        part = unpack(block)
        at = np.searchsorted(rows, np.cumsum(part["row"].astype(np.int64)))
        n_known[at] += part["n"]
        base[at] += part["base"]
        score[at] += part["score"]
    tokens = np.bincount(which, texts["n"]).astype(np.int64)
    ids = pa.array([names[i] if texts["known"][i] else None for i in first.tolist()], pa.string())
    yield pa.RecordBatch.from_arrays(
        [
            ids, pa.array(texts["out"][first] == 1), pa.array(tokens), pa.array(n_known.astype(np.int64)),
            pa.array(base), pa.array(score),
        ],
        ["id", "held_out", "n_tokens", "n_known", "base_score", "score"],
    )
