"""Whitening of embeddings along principal components found by a Jacobi-Davidson search.

The covariance is never formed. It is applied to a block of vectors by a pass over the centred rows
(each partition adds up its rows' share), and everything else handles matrices with as many rows as
an embedding has entries. The search keeps a subspace; Rayleigh-Ritz on it gives the best
approximations; each one that is not exact enough yet is corrected by the solution of the
projected equation ``(I - QQ')(V - theta)(I - QQ') t = -residual``, from some steps of MINRES, all
corrections of a round in the same passes. What is exact to double precision is locked, from the
largest eigenvalue down.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from provender.llm.common import cut

#: Residuals at most this share of the largest eigenvalue count as double precision.
EXACT = 1e-13
#: Steps of MINRES for a correction; vectors sought beyond those wanted; subspace sizes between restarts.
STEPS, GUARD, KEPT, GROWN = 8, 4, 2, 5
#: Rows centred at once and MB of centred rows in a partition, which bound a task's memory.
ROWS, PART_MB = 4096, 64
#: What an entry of 0 becomes, and how many of it an entry of 1 is more.
SHIFT, SCALE = 1_000_000, 64


def whole(embedding_col: str) -> Column:
    """Entries as whole numbers ``floor(64 * c) + 1000000``; null if the vector or an entry is null or
    not finite, or an entry is so large that this is no exact long (2**53 and more)."""
    scaled = F.transform(F.col(embedding_col), lambda c: F.floor(c.cast("double") * float(SCALE)))
    fits = F.forall(
        F.col(embedding_col),
        lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double") * float(SCALE)) < float(2**53)), F.lit(False)),
    )
    return F.when(F.col(embedding_col).isNotNull() & fits, F.transform(scaled, lambda x: x + F.lit(SHIFT).cast("long")))


def _rows(column: pa.Array, dimensions: int) -> np.ndarray:
    """Lists as rows of whole numbers, filled up with entries of 0."""
    flat, ends = np.asarray(column.flatten()), np.asarray(column.offsets).astype(np.int64)
    sizes = np.diff(ends)
    if (sizes == dimensions).all():
        return flat.reshape(len(sizes), dimensions)
    rows = np.full((len(sizes), dimensions), SHIFT, np.int64)
    rows[np.arange(dimensions)[None, :] < sizes[:, None]] = flat
    return rows


class Centre:
    """The number of rows and their sums, which centre a row without rounding before the division."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def multiples(self, rows: np.ndarray) -> np.ndarray:
        """``n * x - S``, exactly."""
        largest = max(int(np.abs(rows).max(initial=0)) * self.n, max(map(abs, self.sums), default=0))
        kind = np.int64 if 2 * largest < 2**63 else object
        return rows.astype(kind) * self.n - np.array(self.sums, kind)

    def centred(self, rows: np.ndarray) -> np.ndarray:
        return (self.multiples(rows) / self.n).astype(float)

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sums of squares of ``multiples``, exactly; None beyond a long."""
        multiples = self.multiples(rows)
        if multiples.dtype == object or (multiples.astype(float) ** 2).sum(1).max(initial=0) >= 2.0**62:
            sums = (multiples.astype(object) ** 2).sum(axis=1).tolist()
            return [int(x) if x < 2**63 else None for x in sums]
        return (multiples**2).sum(1).tolist()


def sums_of(vectors: DataFrame) -> Centre:
    """Exact sums by place of ``v``, over all rows."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, int] = {}
        held: dict[int, int] = {}
        n = 0
        for batch in batches:
            column = batch.column(0)
            sizes = np.diff(np.asarray(column.offsets))
            n += len(sizes)
            for size in np.unique(sizes).tolist():
                same = _rows(column.filter(pa.array(sizes == size)), size)
                if int(np.abs(same).max(initial=0)) * len(same) >= 2**63:
                    same = same.astype(object)
                for place, total in enumerate(same.sum(axis=0).tolist()):
                    totals[place] = totals.get(place, 0) + total
                    held[place] = held.get(place, 0) + len(same)
        rows = [(-1, 0, n), *((p, t, held[p]) for p, t in totals.items())]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([Decimal(r[1]) for r in rows], pa.decimal128(38, 0)),
                pa.array([r[2] for r in rows], pa.int64()),
            ],
            ["place", "total", "n"],
        )

    partial = vectors.select("v").mapInArrow(added, "place int, total decimal(38,0), n long")
    found = partial.groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    by_place = {r["place"]: (int(r["total"]), r["n"]) for r in found}
    n = by_place.pop(-1, (0, 0))[1]
    # A vector without a place has an entry of 0 there.
    return Centre(n, [by_place[p][0] + (n - by_place[p][1]) * SHIFT for p in sorted(by_place)])


def centred_rows(vectors: DataFrame, centre: Centre) -> DataFrame:
    """The centred rows in blocks of doubles, in the checkpoint folder for the passes to come."""
    dimensions = len(centre.sums)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = _rows(batch.slice(at, ROWS).column(0), dimensions)
                yield pa.RecordBatch.from_arrays([pa.array([centre.centred(rows).tobytes()], pa.binary())], ["rows"])

    parts = max(
        vectors.sparkSession.sparkContext.defaultParallelism,
        math.ceil(centre.n * dimensions * 8 / (PART_MB << 20)),
    )
    return cut(vectors.select("v").coalesce(parts).mapInArrow(blocks, "rows binary"))


def added_up(blocks: DataFrame, dimensions: int, part: Callable[[np.ndarray], np.ndarray], shape: tuple) -> np.ndarray:
    """The sum of ``part`` over all blocks of rows. Tasks add up what they read; many tasks' sums are
    added up in groups before the driver gets them."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for block in batch.column(0):
                total += part(np.frombuffer(block.as_buffer(), float).reshape(-1, dimensions))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["rows"])

    def total_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for block in batch.column(0):
                total += np.frombuffer(block.as_buffer(), float).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["rows"])

    sums = blocks.mapInArrow(partial, "rows binary")
    tasks = blocks.rdd.getNumPartitions()
    if tasks > 256:
        sums = sums.repartition(math.isqrt(tasks)).mapInArrow(total_of, "rows binary")
    return sum((np.frombuffer(r["rows"], float).reshape(shape) for r in sums.collect()), np.zeros(shape))


def minres(apply: Callable, right: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """Approximate solutions of ``apply(x) = right`` for each column, by MINRES for symmetric maps.
    Columns share the applications and are else independent."""
    small = np.finfo(float).tiny
    beta = np.linalg.norm(right, axis=0)
    first = np.maximum(beta, small)
    v, v_old = right / first, np.zeros_like(right)
    w, w_old, x = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    c, c_old, s, s_old = (np.full(right.shape[1], a) for a in (1.0, 1.0, 0.0, 0.0))
    eta = beta.copy()
    for _ in range(steps):
        product = apply(v)
        alpha = (v * product).sum(0)
        product = product - alpha * v - beta * v_old
        following = np.linalg.norm(product, axis=0)
        delta = c * alpha - c_old * s * beta
        rho = np.maximum(np.hypot(delta, following), small)
        w, w_old = (v - s_old * beta * w_old - (s * alpha + c_old * c * beta) * w) / rho, w
        c, c_old, s, s_old = delta / rho, c, following / rho, s
        x = x + c * eta * w
        eta = -s * eta
        if (np.abs(eta) <= enough * first).all():
            break
        v, v_old, beta = product / np.maximum(following, small), v, following
        v[:, following <= small] = 0
    return x


def orthonormal(vectors: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``vectors`` add to the orthonormal ``against``."""
    lengths = np.linalg.norm(vectors, axis=0)
    vectors = vectors[:, lengths > 0] / lengths[lengths > 0]
    basis = np.zeros((len(against), 0))
    for column in vectors.T:
        held = np.hstack([against, basis])
        rest = column.copy()
        for _ in range(3):
            rest -= held @ (held.T @ rest)
        length = np.linalg.norm(rest)
        if length > 1e-10:
            rest /= length
            rest -= held @ (held.T @ rest)
            basis = np.hstack([basis, (rest / np.linalg.norm(rest))[:, None]])
    return basis


def leading(apply: Callable, dimensions: int, wanted: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a symmetric map with no
    negative ones, by Jacobi-Davidson. ``apply`` takes and gives a block of vectors."""
    wanted = min(wanted, dimensions)
    locked, values = np.zeros((dimensions, 0)), np.zeros(0)
    start = np.random.default_rng(7).standard_normal((dimensions, min(dimensions, wanted + GUARD)))
    space = orthonormal(start, locked)
    images = apply(space)
    scale = 0.0
    for _ in range(rounds):
        theta, turn = np.linalg.eigh((space.T @ images + images.T @ space) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, images = space @ turn, images @ turn
        scale = max(scale, theta[0])
        left = wanted - len(values)
        rest = images[:, :left] - space[:, :left] * theta[:left]
        rest -= locked @ (locked.T @ rest)
        exact = np.linalg.norm(rest, axis=0) <= EXACT * scale
        done = left if exact.all() else int(exact.argmin())
        if done:
            locked, values = np.hstack([locked, space[:, :done]]), np.concatenate([values, theta[:done]])
            space, images, theta, rest = space[:, done:], images[:, done:], theta[done:], rest[:, done:]
            exact = exact[done:]
        if len(values) == wanted:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        left = wanted - len(values)
        if space.shape[1] > GROWN * wanted:
            space, images = space[:, : KEPT * wanted], images[:, : KEPT * wanted]
        open_ = np.flatnonzero(~exact)
        fixed = np.hstack([locked, space[:, :left]])

        def projected(block: np.ndarray, fixed=fixed, shift=theta[:left][open_]) -> np.ndarray:
            block = block - fixed @ (fixed.T @ block)
            block = apply(block) - shift * block
            return block - fixed @ (fixed.T @ block)

        right = -(rest[:, open_] - fixed @ (fixed.T @ rest[:, open_]))
        steps = min(STEPS, dimensions - fixed.shape[1])
        corrections = minres(projected, right, steps, 1e-2) if steps else right
        more = orthonormal(corrections, np.hstack([locked, space]))
        if not more.shape[1]:
            # nothing new to be had from the corrections: go on from fresh directions
            fresh = np.random.default_rng(len(values)).standard_normal((dimensions, left))
            more = orthonormal(fresh, np.hstack([locked, space]))
        if not more.shape[1]:
            # the whole space is searched, so this is exact up to rounding; measure it anew
            images = apply(space)
            continue
        space, images = np.hstack([space, more]), np.hstack([images, apply(more)])
    raise ArithmeticError(f"no double precision after {rounds} rounds")


def whiten(
    df: DataFrame, components: int = 32, id_col: str = "vec_id", embedding_col: str = "embedding"
) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: for each row whose vector can
    be used and each of the first ``components`` principal components.

    Rows whose vector is null or holds null or non-finite entries are dropped, and those with an entry
    of 2**47 and more, which is no exact whole number. Shorter vectors are filled up with
    entries of 0. Components along which the rows do not differ (eigenvalues that are zero up to
    rounding) cannot be whitened and are left out, so an empty table, one row, and rows that are all
    equal give no rows. ``deviation`` is null where it does not fit a long. Rows with null or equal ids
    all stay; other columns, whatever their names, are not looked at.

    The fit reads all rows. The driver holds matrices of embedding size times a few ``components``.
    """
    vectors = df.select(F.col(id_col).alias("id"), whole(embedding_col).alias("v")).where("v is not null")
    schema = StructType([
        StructField(id_col, df.schema[id_col].dataType),
        StructField("component", IntegerType()),
        StructField("n", LongType()),
        StructField("deviation", LongType()),
        StructField("whitened", DoubleType()),
        StructField("explained", DoubleType()),
        StructField("identity_error", DoubleType()),
    ])
    centre = sums_of(vectors)
    n, dimensions = centre.n, len(centre.sums)
    if not n or not dimensions:
        return df.sparkSession.createDataFrame([], schema)
    blocks = centred_rows(vectors, centre)

    def product(block: np.ndarray) -> np.ndarray:
        return added_up(blocks, dimensions, lambda rows: rows.T @ (rows @ block), block.shape) / n

    trace = float(added_up(blocks, dimensions, lambda rows: (rows**2).sum(keepdims=True), (1, 1))[0, 0]) / n
    if not trace:
        return df.sparkSession.createDataFrame([], schema)
    values, axes = leading(product, dimensions, components)
    real = values > 64 * dimensions * np.finfo(float).eps * values[0]
    values, axes = values[real], axes[:, real]
    to_white = axes / np.sqrt(values)
    kept = len(values)

    def moments(rows: np.ndarray) -> np.ndarray:
        white = rows @ to_white
        return np.vstack([white.T @ white, white.sum(0)])

    second = added_up(blocks, dimensions, moments, (kept + 1, kept)) / n
    identity_error = float(np.abs(second[:-1] - np.outer(second[-1], second[-1]) - np.eye(kept)).max())
    explained = values / trace

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                held = batch.slice(at, ROWS)
                rows = _rows(held.column(1), dimensions)
                white = centre.centred(rows) @ to_white
                each = pa.array(np.repeat(np.arange(len(rows)), kept))
                columns = [
                    held.column(0).take(each),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(each), n, np.int64)),
                    pa.array(centre.deviations(rows), pa.int64()).take(each),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, len(rows))),
                    pa.array(np.full(len(each), identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return vectors.mapInArrow(whitened, schema)
