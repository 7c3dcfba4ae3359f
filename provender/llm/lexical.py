"""Ranked lexical search over an index stratified by document length.

A term's impact on a document depends on its occurrences ``tf`` and on the document's normaliser
``m`` only. Documents of equal ``m`` form a stratum. Within it the postings of a term are grouped by
``tf``, so impacts are worked out once for each ``tf`` of a stratum. The largest ``tf`` of each term
gives a bound on what any document of the stratum can score for an item; strata are visited by
falling bound, and the search for an item ends when the next bound is below its k-th best score.

Documents are dealt into shards of whole strata, a stratum with many documents being cut into several.
A few shards are searched first; the k-th best scores found there are where the search of all
others starts, so most of their strata are never visited.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from provender.llm.common import cut, long_texts, text_of

#: Distinct terms of items that are searched together, on average; documents in a shard and of one
#: stratum in it; share of the shards that is searched first.
TERMS, SHARD, STRATUM, FIRST = 200_000, 16_384, 4_096, 32

#: Bytes of a term, A-Z lower-cased; all else is space.
_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_TERMS).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, terms, n``: the different terms of the different items that have any."""
    schema = StructType([
        StructField("item", items.schema[id_col].dataType),
        StructField("terms", ArrayType(BinaryType())),
        StructField("n", LongType()),
    ])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(terms_of(text))) for text in batch.column(1).to_pylist()]
            sizes = pa.array([len(t) for t in terms], pa.int64())
            columns = [batch.column(0), pa.array(terms, pa.list_(pa.binary())), sizes]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    read = items.select(F.col(id_col).alias("item"), text_of(text_col).alias("text")).distinct()
    return cut(read.mapInArrow(found, schema).where("n > 0"))


def postings(df: DataFrame, id_col: str, text_col: str, shared: Broadcast) -> DataFrame:
    """``id, n, terms, tfs``: for each document with terms their number, and the numbers and occurrences
    of those that items ask for."""
    schema = StructType([
        StructField("id", df.schema[id_col].dataType),
        StructField("n", LongType()),
        StructField("terms", ArrayType(IntegerType())),
        StructField("tfs", ArrayType(IntegerType())),
    ])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        asked = known.keys()
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for text in batch.column(1):
                words = terms_of(text.as_py())
                held = Counter(words)
                common = held.keys() & asked
                sizes.append(len(words))
                terms.append([known[w] for w in common])
                tfs.append([held[w] for w in common])
            lists = pa.list_(pa.int32())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, lists), pa.array(tfs, lists)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    read = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return cut(read.mapInArrow(counted, schema).where("n > 0"))


class Stratum:
    """Postings of documents with one normaliser: for each term its documents, by falling ``tf``."""

    def __init__(self, m: int, documents: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        order = np.lexsort((-tfs, terms))
        self.documents, terms, tfs = documents[order], terms[order], tfs[order]
        values, at = np.unique(tfs, return_inverse=True)
        impacts = 1_000_000_000 * values // (1000 * values + 8 * m)  # once for each tf
        self.impacts = impacts[at]
        self.terms, self.starts = np.unique(terms, return_index=True)
        self.ends = np.append(self.starts[1:], len(terms))
        self.best = self.impacts[self.starts]  # the largest tf of a term comes first


class Shard:
    """Strata, and for each term the strata that hold it with its best impact there."""

    def __init__(self, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        documents = np.repeat(np.arange(len(m)), sizes)
        order = np.argsort(m, kind="stable")
        rank = np.empty(len(m), np.int64)
        rank[order] = np.arange(len(m))
        by_m = np.argsort(rank[documents], kind="stable")
        documents, terms, tfs = documents[by_m], terms[by_m], tfs[by_m].astype(np.int64)
        values, first = np.unique(m[documents], return_index=True)
        ends = np.append(first[1:], len(documents))
        self.strata = [
            Stratum(int(v), documents[a:b], terms[a:b], tfs[a:b])
            for v, a, b in zip(values, first, ends, strict=True)
        ]
        held = np.concatenate([s.terms for s in self.strata]) if self.strata else np.zeros(0, np.int64)
        where = np.repeat(np.arange(len(self.strata)), [len(s.terms) for s in self.strata])
        best = np.concatenate([s.best for s in self.strata]) if self.strata else np.zeros(0, np.int64)
        order = np.argsort(held, kind="stable")
        self.where, self.best = where[order], best[order]
        self.terms, self.starts = np.unique(held[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(held))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int, order: np.ndarray):
        """Rows and scores of the best ``k`` (and what ties with the last) of at least ``least``, where
        ``order`` has the places of rows with equal scores."""
        bounds = np.zeros(len(self.strata), np.int64)
        for a, b, w in zip(*_slices(self.terms, self.starts, self.ends, terms, weights), strict=True):
            bounds[self.where[a:b]] += w * self.best[a:b]
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in np.argsort(-bounds, kind="stable"):
            if bounds[at] < max(least, 1):
                break
            stratum = self.strata[at]
            starts, ends, used = _slices(stratum.terms, stratum.starts, stratum.ends, terms, weights)
            lengths = ends - starts
            picked = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            found, which = np.unique(stratum.documents[picked], return_inverse=True)
            sums = np.zeros(len(found), np.int64)
            np.add.at(sums, which, np.repeat(used, lengths) * stratum.impacts[picked])
            enough = sums >= max(least, 1)
            rows, scores = np.concatenate([rows, found[enough]]), np.concatenate([scores, sums[enough]])
            if len(rows) >= k:
                best = np.lexsort((order[rows], -scores))[:k]
                rows, scores = rows[best], scores[best]
                least = max(least, int(scores[-1]))
        return rows, scores


def _slices(held, starts, ends, terms, weights):
    """Starts, ends and weights of those of ``terms`` that are ``held`` (sorted)."""
    at = np.minimum(np.searchsorted(held, terms), max(0, len(held) - 1))
    there = held[at] == terms if len(held) else np.zeros(len(terms), bool)
    return starts[at[there]], ends[at[there]], weights[there]


def searched(index: DataFrame, shared: Broadcast, k: int) -> DataFrame:
    """``item, id, score`` (items by number): of each shard of ``index`` each item's ``k`` best documents,
    as far as they reach the score that ``shared`` has for the item."""
    schema = StructType([
        StructField("item", IntegerType()), index.schema["id"], StructField("score", LongType())
    ])

    def best(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids = rows["id"]
        lists = [rows[c].combine_chunks() for c in ("terms", "tfs")]
        sizes = np.diff(np.asarray(lists[0].offsets))
        shard = Shard(np.asarray(rows["m"]), sizes, *(np.asarray(x.flatten()) for x in lists))
        order = np.empty(len(ids), np.int64)
        order[np.asarray(pc.sort_indices(ids, null_placement="at_end"))] = np.arange(len(ids))
        items, found, scores = [], [], []
        for item, (terms, weights, least) in enumerate(shared.value):
            got, score = shard.search(terms, weights, k, least, order)
            items.append(np.full(len(got), item, np.int32))
            found.append(got)
            scores.append(score)
        return pa.table([
            pa.array(np.concatenate(items)), ids.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(scores))
        ], schema.names)

    return index.groupBy("shard").applyInArrow(best, schema)


def the_best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    items: DataFrame,
    df: DataFrame,
    k: int = 10,
    item_col: str = "item_id",
    item_text_col: str = "text",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``item, rank, id, score``: the ``k`` documents of ``df`` with the highest scores above 0 for each of
    ``items``, ties to smaller ids (null last).

    Null texts have no terms. Items that repeat in id and text are one item; equal ids with different
    texts are items of their own under one id, and so are items without an id. Documents that repeat are
    documents of their own. Items without a known term, and empty tables, give no rows. Other columns,
    whatever their names, are not looked at.

    Each ``TERMS`` terms of items, about, are a round of their own, with one pass over the texts. What is
    broadcast is a round's terms; what moves are the postings of those terms, dealt by stratum.
    """
    long_texts(df.sparkSession)
    asked = item_terms(items, item_col, item_text_col)
    total = asked.agg(F.sum("n")).first()[0] or 0
    rounds = max(1, math.ceil(total / TERMS))
    result = None
    for number in range(rounds):
        mine = asked.where(F.pmod(F.xxhash64("item", "terms"), F.lit(rounds)) == number).collect()
        found = _round([(r["item"], list(map(bytes, r["terms"]))) for r in mine], df, k, id_col, text_col, asked.schema["item"])
        result = found if result is None else result.union(found)
    return result.select(
        F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"
    )


def _round(mine: list[tuple], df: DataFrame, k: int, id_col: str, text_col: str, item_field: StructField) -> DataFrame:
    spark = df.sparkSession
    numbers: dict[bytes, int] = {}
    for _, terms in mine:
        for term in terms:
            numbers.setdefault(term, len(numbers))
    rows = postings(df, id_col, text_col, spark.sparkContext.broadcast(numbers))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    documents, length = size["n"], size["l"] or 1
    holding = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = np.full(len(numbers), weight(documents, 0), np.int64)
    for r in holding.collect():  # at most a round's terms
        weights[r["term"]] = weight(documents, r["df"])

    held = rows.where(F.size("terms") > 0).select(
        "id", "terms", "tfs", (F.lit(10) + F.expr(f"(90L * n * {documents}L) div {length}L")).alias("m")
    )
    strata = held.groupBy("m").agg(F.ceil(F.count(F.lit(1)) / STRATUM).alias("parts"))
    shards = max(1, math.ceil(documents / SHARD))
    part = F.pmod(F.xxhash64("id", "terms", F.monotonically_increasing_id()), F.col("parts"))
    dealt = F.pmod(F.xxhash64("m", part), F.lit(shards)).cast("int")
    index = held.join(strata, "m").select("id", "terms", "tfs", "m", dealt.alias("shard"))
    if shards > 1:
        index = cut(index)

    questions = [
        (np.array([numbers[t] for t in terms]), weights[[numbers[t] for t in terms]], 0) for _, terms in mine
    ]
    ahead = math.ceil(shards / FIRST)
    found = searched(index.where(F.col("shard") < ahead), spark.sparkContext.broadcast(questions), k)
    if shards > ahead:
        first = cut(the_best(found, k))
        least = {r["item"]: r["score"] for r in first.where(F.col("rank") == k).collect()}
        raised = [(t, w, least.get(i, 0)) for i, (t, w, _) in enumerate(questions)]
        others = searched(index.where(F.col("shard") >= ahead), spark.sparkContext.broadcast(raised), k)
        found = first.drop("rank").union(others)
    names = spark.createDataFrame(
        [(i, item) for i, (item, _) in enumerate(mine)],
        StructType([StructField("number", IntegerType()), StructField("name", item_field.dataType)]),
    )
    best = the_best(found, k).join(F.broadcast(names), F.col("item") == F.col("number"))
    return best.select(F.col("name").alias("item"), "rank", "id", "score")


def search_sql(items: str, documents: str, k: int = 10) -> str:
    """``search`` by scoring every document for every item, for DuckDB."""
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lowered = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH words AS (
        SELECT row_number() OVER () AS row, doc_id,
            regexp_extract_all({lowered.format("coalesce(text, '')")}, '{pattern}') AS w FROM {documents}),
    docs AS (SELECT row, doc_id, w, len(w) AS n FROM words WHERE len(w) > 0),
    size AS (SELECT count(*) AS docs, sum(n) AS total FROM docs),
    tf AS (SELECT row, t, count(*) AS tf FROM (SELECT row, unnest(w) AS t FROM docs) GROUP BY row, t),
    weights AS (
        SELECT t, CAST(floor(1000 * ln((2 * (SELECT docs FROM size) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM tf GROUP BY t),
    items AS (
        SELECT item_id, text, unnest(list_distinct(
            regexp_extract_all({lowered.format("coalesce(text, '')")}, '{pattern}'))) AS t
        FROM (SELECT DISTINCT item_id, text FROM {items})),
    scored AS (
        SELECT i.item_id, i.text, d.row, d.doc_id,
            CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (10
                + (90 * d.n * (SELECT docs FROM size)) // (SELECT total FROM size))))) AS BIGINT) AS score
        FROM items i JOIN weights w USING (t) JOIN tf f USING (t) JOIN docs d USING (row)
        GROUP BY i.item_id, i.text, d.row, d.doc_id)
    SELECT item_id, CAST(row_number() OVER best AS INT) AS rank, doc_id, score FROM scored WHERE score > 0
    WINDOW best AS (PARTITION BY item_id, text ORDER BY score DESC, doc_id)
    QUALIFY rank <= {k}"""
