"""Numbering rows within groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provender import schema as S

#: About as many rows are sorted by one task, up to ``MAX_PIECES`` pieces.
ROWS_PER_PIECE, MAX_PIECES = 100_000, 200
#: Rows looked at for each boundary between pieces.
SAMPLED_PER_PIECE = 50


def _boundaries(df: DataFrame, names: list[str]) -> list:
    """Values that cut the ordered rows into pieces of about equal size; a bounded number."""
    pieces = min(-(-df.count() // ROWS_PER_PIECE), MAX_PIECES)
    if pieces <= 1:
        return []
    columns = [F.col(S.quoted(c)) for c in names]
    every = max(1, df.count() // (pieces * SAMPLED_PER_PIECE))
    sampled = df.select(*columns).where(F.pmod(F.xxhash64(*columns), F.lit(every)) == 0)
    rows = sampled.select(F.struct(*columns).alias("k")).distinct().orderBy("k").collect()
    step = max(1, len(rows) // pieces)
    return [row["k"] for row in rows[step::step]]


def rank_within(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``row_number`` within groups of any size. ``order`` has to be unique within a group.

    Rows are cut into pieces by boundaries on keys and order, each piece numbers its own rows, and
    a small table of sizes per piece and group gives every piece its start. A window over the
    group alone would put a whole group into one task. A row's piece depends on its values alone,
    so both branches agree whenever and wherever they are computed.

    The rows are persisted because they are read several times; they may be released at any time.
    """
    df = df.persist()
    names = [*keys, *order]
    key_columns = [F.col(S.quoted(k)) for k in keys]
    whole = F.struct(*[F.col(S.quoted(c)) for c in names])
    bounds = [
        F.struct(*[F.lit(value).cast(df.schema[c].dataType).alias(c) for c, value in zip(names, row, strict=True)])
        for row in _boundaries(df, names)
    ]
    piece = F.size(F.filter(F.array(*bounds), lambda b: b <= whole)) if bounds else F.lit(0)
    cut = df.withColumn("_part", piece)
    local = Window.partitionBy("_part", *key_columns).orderBy(*[F.col(S.quoted(c)) for c in order])
    numbered = cut.withColumn("_local", F.row_number().over(local))
    sizes = cut.groupBy("_part", *key_columns).agg(F.count(F.lit(1)).alias("_size"))
    before = (
        Window.partitionBy(*key_columns)
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.select(
        "_part",
        *key_columns,
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
    )
    return (
        numbered.join(starts, ["_part", *keys])
        .withColumn(name, F.col("_local") + F.col("_start"))
        .drop("_part", "_local", "_start")
    )
