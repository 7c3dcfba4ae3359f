"""Near-duplicates by SimHash with deletion-variant signatures.

A document's fingerprint has bit i set if more than half of its shingles' hashes have. Documents
whose fingerprints differ in at most three bits are linked. Cut in two halves, one half of such a
pair differs in at most one bit, so both have equal variants of that half with that bit deleted.
Each fingerprint is indexed under its 64 one-wildcard variants (32 for each half), equal variants
are brought together, and what meets is verified on all 64 bits.

Where many different fingerprints share a variant, they are not compared all with all: the half
that is not yet fixed, which still differs in at most three bits, is cut in two again and indexed
in the same way, down to quarters and eighths. Then so few bits are free that a bucket has at most
2,048 different fingerprints, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.llm.common import cut, long_texts, partitions, text_of
from provender.llm.components import components

#: Fingerprints of a bucket up to which all are compared.
TOGETHER = 512
#: Bits that may differ.
DISTANCE = 3
# Words of a text hashed at once, which bounds memory for very long texts.
WORDS_AT_ONCE = 500_000


def fingerprint(text: str, size: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text: words are runs of what is no ASCII white space, A-Z lower-cased."""
    words = text.encode().lower().split()
    if not words:
        return 0
    counts, shingles = np.zeros(64, np.int64), max(1, len(words) - size + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, shingles, WORDS_AT_ONCE):
        upto = min(shingles, at + WORDS_AT_ONCE)
        hashes = np.array([digest(join(words[i : i + size]), seed) for i in range(at, upto)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * counts > shingles, bitorder="little")
    return int(majority.view(np.uint64)[0])


def fingerprint_column(text: Column, size: int = 3, seed: int = 42) -> Column:
    """Fingerprints as signed 64-bit integers."""

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            prints = np.array([fingerprint(t, size, seed) for t in texts], np.uint64)
            yield pd.Series(prints.view(np.int64))

    return hashed(text)


def variants(bits: Column, width: int, free: list[int]) -> Column:
    """The one-wildcard variants of parts of ``bits``: for each part (its lowest bit in ``free``,
    ``width`` bits long) and each of its bits, a number that says which, and the part without it."""
    found = []
    for number, low in enumerate(free):
        part = F.shiftrightunsigned(bits, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        for i in range(width):
            label = (number * width + i) << width
            found.append(part.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << i)).cast("long")) + F.lit(label).cast("long"))
    return F.array(*found)


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Links that keep what ``pairs`` connect connected, at most one for each node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    kept = []
    for a, b in np.unique(pairs, axis=0).tolist():
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return np.array(kept, np.int64).reshape(-1, 2)


def near_pairs(bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Links among equal neighbours in ``bucket`` (sorted) whose prints differ in few bits."""
    found = []
    at = np.arange(len(bucket) - 1)
    step = 1
    while len(at):
        at = at[at + step < len(bucket)]
        at = at[bucket[at] == bucket[at + step]]
        near = at[np.bitwise_count((prints[at] ^ prints[at + step]).view(np.uint64)) <= DISTANCE]
        if len(near):
            found.append(np.stack([prints[near], prints[near + step]], axis=1))
        step += 1
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _linker(limit: int | None):
    """Reads (key, sub, print) sorted by key and sub; writes links, and what has to be cut finer."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """Runs of whole buckets; a bucket too large to be compared comes in several."""
        kept: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            now = tuple(np.asarray(batch.column(i)) for i in range(3))
            if kept is not None:
                now = tuple(map(np.concatenate, zip(kept, now, strict=True)))
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) if len(now[0]) else np.empty(0, bool)
            start = len(same) - int(same[::-1].argmin()) if not same.all() else 0
            if start:
                yield tuple(x[:start] for x in now)
            kept = tuple(x[start:] for x in now)
            if limit and len(kept[0]) > 64 * limit:
                yield kept  # far beyond the limit; what follows of it may be judged small and is
                kept = (kept[0][-limit - 1 :], kept[1][-limit - 1 :], kept[2][-limit - 1 :])
        if kept is not None and len(kept[0]):
            yield kept

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = np.empty((0, 2), np.int64)
        for key, sub, prints in blocks(batches):
            change = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1
            sizes = np.diff(np.concatenate([[0], change, [len(key)]]))
            bucket = np.repeat(np.arange(len(sizes)), sizes)
            large = np.repeat(sizes > limit, sizes) if limit else np.zeros(len(key), bool)
            if large.any():
                yield _rows(key[large], sub[large], prints[large], True)
            links = np.concatenate([links, near_pairs(bucket[~large], prints[~large])])
            if len(links) > 1_000_000:
                links = _forest(links)
        links = _forest(links)
        yield _rows(links[:, 0], links[:, 1], links[:, 0], False)

    return linked


def _rows(a: np.ndarray, b: np.ndarray, c: np.ndarray, finer: bool) -> pa.RecordBatch:
    columns = [pa.array(x, pa.int64()) for x in (a, b, c)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([finer] * len(a), pa.bool_())], ["a", "b", "c", "finer"])


def links(prints: DataFrame) -> DataFrame:
    """``a, b``: links that connect what fingerprints in at most three bits' distance connect.

    ``prints`` has different fingerprints ``fp``. Every pair in reach is verified; of the links
    found in a task those are kept that are needed to connect the same fingerprints.
    """
    count = partitions(prints.sparkSession)

    def compared(rows: DataFrame, limit: int | None) -> tuple[DataFrame, DataFrame]:
        """Links among the rows of each (key, sub), and the rows of those that are too many."""
        dealt = rows.repartition(count, "key", "sub").sortWithinPartitions("key", "sub")
        found = cut(dealt.mapInArrow(_linker(limit), "a long, b long, c long, finer boolean"))
        many = found.where("finer").selectExpr("a AS key", "b AS sub", "c AS fp").distinct()
        return found.where("not finer").select("a", "b"), many

    first = prints.select(
        F.explode(variants(F.col("fp"), 32, [0, 32])).alias("key"), F.lit(0).cast("long").alias("sub"), "fp"
    )
    result, many = compared(first, TOGETHER)
    for width, limit in ((16, TOGETHER), (8, None)):
        if many.isEmpty():
            break
        finer = F.transform(
            variants(_free_part(width), width, [0, width]), lambda v: F.col("sub") * F.lit(1 << 24) + v
        )
        found, many = compared(many.select("key", F.explode(finer).alias("sub"), "fp"), limit)
        result = result.union(found)
    return result


def _free_part(width: int) -> Column:
    """The bits that the bucket's key leaves free: the other half, or the other quarter of it."""
    lower_half = F.shiftright(F.col("key"), 32) < 32  # the key is a variant of the lower half
    half = F.when(lower_half, F.shiftrightunsigned(F.col("fp"), 32)).otherwise(
        F.col("fp").bitwiseAND(F.lit((1 << 32) - 1).cast("long"))
    )
    if width == 16:
        return half
    lower_quarter = F.shiftright(F.col("sub"), 16) < 16
    return F.when(lower_quarter, F.shiftrightunsigned(half, 16)).otherwise(
        half.bitwiseAND(F.lit((1 << 16) - 1).cast("long"))
    )


def classes(prints: DataFrame) -> DataFrame:
    """``fp, root``: the class of each fingerprint in ``prints`` (``fp``, each once) that has a link."""
    found = components(links(prints))
    return found.select(F.col("node").alias("fp"), "root")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3
) -> DataFrame:
    """``id, fingerprint, component_id``, a row for each row of ``df``.

    Null and empty texts have fingerprint zero and are linked like any other; fewer words than a
    shingle has are one shingle. Rows without an id belong to components like all, but name none:
    a component of such rows only has a null id. Repeated rows stay. An empty table gives none.
    Other columns are not looked at. Texts are read once; what is exchanged is ids, fingerprints
    and 64 variants of each different fingerprint.
    """
    long_texts(df.sparkSession)
    hashed = cut(df.select(F.col(id_col).alias("_id"), fingerprint_column(text_of(text_col), size).alias("fp")))
    named = components_of(hashed, F.min("_id"))
    return hashed.join(named, "fp").select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("_of").alias("component_id"),
    )


def components_of(hashed: DataFrame, least: Column, classes_of=classes) -> DataFrame:
    """``fp, _of`` for each fingerprint: the least of ``least`` over all rows of its component."""
    prints = cut(hashed.groupBy("fp").agg(least.alias("_least")))
    rooted = prints.join(classes_of(prints.select("fp")), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    of = rooted.groupBy("root").agg(F.min("_least").alias("_of"))
    return rooted.select("fp", "root").join(of, "root").select("fp", "_of")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """The rows of ``df`` with one of each component: that with the smallest id (null last), then
    the smallest hash of its text. Rows equal in both are exact repetitions; one stays. Null and empty
    texts are one component. Columns of ``df`` may have any names."""
    long_texts(df.sparkSession)
    text_hash = F.xxhash64(text_of(text_col))
    hashed = cut(
        df.select(
            F.col(id_col).alias("_id"), text_hash.alias("_text"), fingerprint_column(text_of(text_col), size).alias("fp")
        )
    )
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_text").alias("text"))
    kept = cut(
        hashed.select("fp", order.alias("_order"))
        .join(components_of(hashed, F.min(order)), "fp")
        .where(F.col("_order") == F.col("_of"))
        .groupBy("_of")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("_of.id").alias("kept_id"), F.col("_of.text").alias("kept_hash"), "n")
    )
    rows = df.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).alias("id"), text_hash.alias("hash")
    )
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash"))
    result = rows.join(kept.select("kept_id", "kept_hash"), same, "left_semi")
    if not kept.where("n > 1").isEmpty():
        result = result.dropDuplicates(["id", "hash"])
    return result.select("row.*")
