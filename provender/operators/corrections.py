"""Token corrections from tables of any size.

Small tables are literals of the plan (``normalize.resolve_token``). Here the table stays a table:
chains of corrections are closed by pointer jumping, and names are corrected by joins that only the
tokens take part in which a Bloom filter lets through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provender.errors import RuleError
from provender.functions.expressions import strip
from provender.functions.shared import kept

#: Bits of a Bloom filter a word, and at most. Beyond it more tokens pass, and results are the same.
BITS, MAX_BITS = 12, 1 << 28
#: Bits in one bitmap of Spark's bitmap aggregation (a fixed value of Spark).
BITMAP = 32_768
HASHES = 3
#: About as many words, or places of words in the filter, are sorted by one task.
ROWS_PER_TASK = 250_000


def closed(corrections: DataFrame) -> DataFrame:
    """``raw, clean`` with every chain followed to its end, as in ``rules.ruleset.close_corrections``.

    Each round replaces the end of every chain by what that is corrected to so far, so chains double
    and a chain of n corrections takes log2(n) rounds. A cycle never ends; it is an error, as is a word
    with two corrections. An end that many chains share is joined by broadcast, and the rows of each round are dealt
    anew, so that no task gets them all. Rows with a null say nothing and are left out; repeated rows count once.
    """
    by_word = corrections.where("raw is not null and clean is not null").groupBy("raw")
    state = kept(by_word.agg(F.min("clean").alias("clean"), F.max("clean").alias("_other")))
    double = state.where("clean <> _other").first()
    if double:
        raise RuleError(f"{double['raw']!r} has two corrections")
    state = state.select("raw", "clean", F.lit(True).alias("open"))
    size = max(1, state.count())
    rounds, pieces = size.bit_length() + 1, -(-size // ROWS_PER_TASK)
    for _ in range(rounds):
        ends = state.select(F.col("raw").alias("_word"), F.col("clean").alias("_next"))
        moving = state.where("open")
        hot = _frequent(moving, "clean")
        found = ends.join(F.broadcast(hot), F.col("_word") == F.col("clean")).select("clean", "_next")
        often = moving.join(F.broadcast(hot), "clean").join(F.broadcast(found), "clean", "left")
        rest = moving.join(F.broadcast(hot), "clean", "left_anti")
        rest = rest.join(ends, F.col("clean") == F.col("_word"), "left").select("clean", "raw", "open", "_next")
        moved = often.select(*rest.columns).unionByName(rest).select(
            "raw", F.coalesce("_next", "clean").alias("clean"), F.isnotnull("_next").alias("open")
        )
        state = kept(moved.union(state.where("not open")).repartition(pieces, "raw"))
        if state.where("open").isEmpty():
            return state.select("raw", "clean")
    stuck = state.where("open").first()
    raise RuleError(f"corrections form a cycle at {stuck['clean']!r}")


def read(spark: SparkSession, rule_pack: str) -> DataFrame | None:
    """The closed corrections of a rule pack's directory, if it has any."""
    from provender.sources.readers import path_exists

    path = f"{rule_pack.rstrip('/')}/corrections.csv"
    if not path_exists(spark, path):
        return None
    table = spark.read.options(header=True, quote='"', escape='"').csv(path)
    return closed(table.select("raw", "clean"))


def _places(word: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(word, F.lit(seed)), F.lit(bits).cast("long")) for seed in range(HASHES)]


def may_hold(words: DataFrame, column: str):
    """A test for columns whether a word may be among ``words``: false is always right.

    The filter is a Bloom filter made of bitmaps that Spark aggregates, at most ``MAX_BITS`` bits, or
    32 MB, whatever the number of words.
    """
    size = max(1, words.count())
    bits = min(MAX_BITS, max(BITMAP, 1 << (BITS * size - 1).bit_length()))
    set_bits = words.select(F.explode(F.array(*_places(F.col(column), bits))).alias("place"))
    bitmaps = (
        set_bits.select("place", F.floor(F.col("place") / BITMAP).alias("bucket"))
        .repartition(-(-HASHES * size // ROWS_PER_TASK), "bucket")
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg(F.pmod("place", F.lit(BITMAP).cast("long"))).alias("bitmap"))
        .collect()
    )
    table = np.zeros(bits // 8, np.uint8)
    for r in bitmaps:
        held = np.frombuffer(r["bitmap"], np.uint8)
        table[r["bucket"] * (BITMAP // 8) :][: len(held)] = held
    shared = words.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def held_all(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        filter_bits = shared.value
        for places in batches:
            found = np.ones(len(places[0]), bool)
            for place in places:
                at = place.to_numpy()
                found &= (filter_bits[at >> 3] >> (at & 7) & 1).astype(bool)
            yield pd.Series(found)

    return lambda word: held_all(*_places(word, bits))


def _frequent(rows: DataFrame, column: str) -> DataFrame:
    """The values with more than a quarter of a partition's mean of the rows, at most four a partition."""
    hot_words = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return kept(counts.where(F.col("n") * hot_words > rows.count()).select(column))


def by_word(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` (with ``token``) that ``words`` (``raw`` unique, ``clean``) has, with ``clean``.

    A word with a large share of the rows is not left to one task: words with more than a quarter of a
    partition's mean are at most four a partition, so they are broadcast with their corrections,
    and only the others are joined by a shuffle. ``rows`` is read several times.
    """
    hot = _frequent(rows, "token")
    hot_pairs = words.join(F.broadcast(hot), F.col("raw") == F.col("token")).select("raw", "clean")
    same = F.col("token") == F.col("raw")
    often = rows.join(F.broadcast(hot_pairs), same).drop("raw")
    rest = rows.join(F.broadcast(hot), "token", "left_anti").select(*rows.columns)
    return often.unionByName(rest.join(words, same).drop("raw"))


def with_tokens(
    df: DataFrame, id_column: str, name_column: str, table: DataFrame, tokens: str = "tokens"
) -> DataFrame:
    """``df`` with ``tokens``: the name's tokens as ``normalize.split_tokens`` gives them.

    ``table`` is a closed table. A row is told by ``id_column`` and its name, so ids may repeat. A null name has
    null tokens. The plan does not grow with the table, and rows meet it only with those tokens that
    the filter lets through.
    """

    def quoted(name: str) -> Column:
        return F.col("`" + name.replace("`", "``") + "`")

    plain = F.transform(F.split(quoted(name_column), ",", -1), lambda t: strip(F.lower(t)))
    row = F.struct(quoted(id_column).alias("id"), quoted(name_column).alias("name"))
    each = df.select(row.alias("row"), F.posexplode(plain).alias("at", "token"))
    candidates = kept(each.where(may_hold(table, "raw")(F.col("token"))))
    changes = (
        by_word(candidates, table)
        .groupBy(F.col("row").alias("_row"))
        .agg(F.map_from_entries(F.collect_set(F.struct("at", "clean"))).alias("_changes"))
    )
    same = quoted(id_column).eqNullSafe(F.col("_row.id")) & (quoted(name_column) == F.col("_row.name"))
    joined = df.join(changes, same, "left")
    corrected = F.transform(plain, lambda t, i: F.coalesce(F.try_element_at(F.col("_changes"), i), t))
    resolved = F.when(F.isnull("_changes"), plain).otherwise(corrected)
    return joined.withColumn(tokens, resolved).drop("_changes", "_row")
