"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors are kept in shards. A shard holds its postings (dimension, vector, value) in segments by
the quantised impact of the value: how many powers of two it reaches. Segments are processed by
descending impact, for a block of queries at once, adding into partial scores. After each segment
the part still to come is bounded for each pair (the norm of what is left of the vector times the
norm of the query). It ends when that bound proves that no vector outside a short list can be
among the best k; the list is then scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a shard, queries in a block, blocks in a task. They bound a task's memory.
SHARD, BLOCK, BLOCKS = 4096, 512, 16


def floored(embedding_col: str) -> Column:
    """Components times 1024, rounded down; null if the vector or a component is no finite number."""
    usable = F.col(embedding_col).isNotNull() & F.forall(
        F.col(embedding_col),
        lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)),
    )
    values = F.transform(F.col(embedding_col), lambda x: F.floor(x.cast("double") * 1024.0))
    return F.when(usable, values)


def stacked(vectors: list[np.ndarray], dimensions: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    rows = np.zeros((len(vectors), dimensions), np.int64)
    for row, vector in zip(rows, vectors, strict=True):
        row[: len(vector)] = vector
    return rows


class Index:
    """The impact-ordered segments of one shard."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        level = np.frexp(np.abs(values).astype(float))[1]
        left = values.astype(float)
        self.norms = np.sqrt((left**2).sum(1))
        self.segments: list[tuple[np.ndarray, np.ndarray]] = []
        for impact in range(int(level.max(initial=0)), 0, -1):
            segment = np.where(level == impact, values, 0).astype(float)
            left -= segment
            self.segments.append((segment, np.sqrt((left**2).sum(1))))

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """``query, vector, score`` of the best k for each query, ties to smaller ids."""
        n = len(self.ids)
        scores = np.zeros((len(queries), n))
        asked = queries.astype(float)
        norms = np.sqrt((asked**2).sum(1))
        others = query_ids[:, None] != self.ids[None, :]
        possible = others
        rounding = 1e-12 * norms[:, None] * self.norms[None, :]
        for segment, rest in self.segments:
            scores += asked @ segment.T
            bound = norms[:, None] * rest[None, :] * (1 + 1e-12) + rounding
            if n > k:
                low = np.where(others, scores - bound, -np.inf)
                kth = np.partition(low, n - k, axis=1)[:, n - k]
                possible = others & (scores + bound >= kth[:, None])
                if possible.sum() <= len(queries) * max(2 * k, n // 64):
                    break
        for number, query in enumerate(queries):
            at = np.flatnonzero(possible[number])
            if np.abs(query).max(initial=0) * float(np.abs(self.values[at]).sum(1).max(initial=0)) >= 2.0**63:
                raise ArithmeticError("scores have to fit a long")
            exact = self.values[at] @ query
            for j in np.lexsort((self.ids[at], -exact))[:k].tolist():
                yield int(query_ids[number]), int(self.ids[at[j]]), int(exact[j])


def top_k(
    df: DataFrame,
    k: int = 10,
    every: int = 100,
    id_col: str = "vec_id",
    embedding_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every`` the k
    other rows with the highest inner products of the floored vectors.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows without
    an id, which could not be named. Rows with equal ids are candidates each for itself, and for
    other ids only; what they ask is ranked together under their id. Vectors of unequal length are filled with zeros. Empty tables give no rows;
    a table with fewer other rows gives all of them. Other columns are not looked at.

    Rows are hashed into shards of about ``SHARD`` vectors. Queries are packed into blocks which
    go to every shard, ``BLOCKS`` at a time, so that a task holds one shard and some thousand
    queries; each answers with k rows for each query, cut to k again before they are exchanged.
    """
    vectors = df.select(
        F.col(id_col).cast("long").alias("vec_id"), floored(embedding_col).alias("v")
    ).where("vec_id is not null and v is not null")
    # Equal rows have equal scores, so k of them fill every list that any number of them could.
    vectors = (
        vectors.groupBy("vec_id", "v")
        .agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("copies"))
        .select("vec_id", "v", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    )
    size = vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("vec_id") % every == 0).alias("queries"),
        F.max(F.size("v")).alias("dimensions"),
    ).first()
    shards = max(1, -(-size["n"] // SHARD))
    blocks = max(1, -(-size["queries"] // BLOCK))
    chunks = -(-blocks // BLOCKS)
    dimensions = size["dimensions"] or 0

    spread = vectors.select(
        F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards).cast("long")).alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
        "vec_id",
        "v",
    )
    number = F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(blocks).cast("long"))

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, values = rows["vec_id"].to_numpy(), stacked(rows["v"].tolist(), dimensions)
        return pd.DataFrame({"block": [key[0]], "ids": [ids.tobytes()], "values": [values.tobytes()]})

    asked = (
        vectors.where(F.col("vec_id") % every == 0)
        .groupBy(number.alias("block"))
        .applyInPandas(packed, "block long, ids binary, values binary")
        .select(
            F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")).alias("shard"),
            F.floor(F.col("block") / BLOCKS).cast("int").alias("chunk"),
            "ids",
            "values",
        )
    )

    def answered(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        if len(rows) and len(queries):
            index = Index(rows["vec_id"].to_numpy(), stacked(rows["v"].tolist(), dimensions))
            for ids, values in zip(queries["ids"], queries["values"], strict=True):
                query_ids = np.frombuffer(ids, np.int64)
                table = np.frombuffer(values, np.int64).reshape(len(query_ids), dimensions)
                found.extend(index.best(query_ids, table, k))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        spread.groupBy("shard", "chunk")
        .cogroup(asked.groupBy("shard", "chunk"))
        .applyInPandas(answered, "query_id long, vec_id long, score long")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def top_k_sql(embeddings: str, k: int = 10, every: int = 100) -> str:
    """``top_k`` by brute force, for DuckDB."""
    return f"""
    WITH vectors AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
        FROM {embeddings}
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id,
            CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
        FROM vectors q JOIN vectors c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM scored
    WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
    QUALIFY rank <= {k}"""
