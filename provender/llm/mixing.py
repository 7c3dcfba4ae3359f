"""Mixing sources to target weights by Poisson replication.

A source with n rows and target share w of a mixture of ``total`` rows gets the mean repetition
rate ``total * w / n``. Each row draws its number of copies by inverting the Poisson distribution
of that mean at a point hashed from a seed and its id, is exploded by it, and the copies are dealt
over the cluster by another hash. Everything is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.llm.common import free_name

#: Rates above this are drawn as a sum of equal parts, so that exp(-rate) stays exact enough.
PART_RATE = 16
#: More terms than a distribution of mean PART_RATE can need at the resolution of the points.
TERMS = 100
#: Sources up to this number (a row of about 40 bytes each) are broadcast; beyond it, joined.
BROADCAST_SOURCES = 100_000


def hashed_point(*parts: Column | str) -> Column:
    """A point strictly between 0 and 1, a multiple of 2**-45, from the MD5 of the joined parts."""
    joined = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    number = F.conv(F.substring(F.md5(joined), 1, 11), 16, 10).cast("double")
    return (number + F.lit(0.5)) / F.lit(float(2**44))


def poisson_at(point: Column, rate: Column) -> Column:
    """The smallest k whose cumulative probability reaches ``point``."""
    start = F.struct(
        F.exp(-rate).alias("term"), F.exp(-rate).alias("reached"), F.lit(0).alias("k")
    )

    def step(state: Column, i: Column) -> Column:
        term = state["term"] * rate / i
        return F.struct(
            term.alias("term"),
            (state["reached"] + term).alias("reached"),
            (state["k"] + F.when(state["reached"] < point, 1).otherwise(0)).alias("k"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["k"])


def rates(
    df: DataFrame, source_col: str, weights: dict[str | None, float] | None, exponent: float,
    total: int | None,
) -> DataFrame:
    """``_source, _rate`` for each source. See ``mix``."""
    sizes = df.groupBy(F.col(source_col).alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        share = F.pow(F.col("_n").cast("double"), F.lit(float(exponent)))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("_source").eqNullSafe(F.lit(name)), float(weight)).otherwise(share)
    sizes = sizes.withColumn("_share", share)
    sums = sizes.agg(F.sum("_share").alias("s"), F.sum("_n").alias("n")).first()
    if not sums["n"] or not sums["s"]:
        return sizes.select("_source", F.lit(0.0).alias("_rate"))
    rate = F.lit(float(total or sums["n"])) * (F.col("_share") / float(sums["s"])) / F.col("_n")
    return sizes.select("_source", rate.alias("_rate"))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str | None, float] | None = None,
    exponent: float = 0.5,
    total: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """The columns of ``df`` with ``copy_no`` (from 1) and ``shuffle_key``, rows in mixed order.

    ``weights`` maps source to its target weight (sources not named get none); without it a
    source's weight is its size to the power ``exponent``. ``total`` is the expected number of
    rows out, by default that of ``df``. Input columns named like the two new ones are replaced;
    other names are free, and may be any.

    A null source is a source of its own, a null id hashes as the empty text, and rows with equal
    ids draw the same number and all stay. If every weight is 0 or the table is empty, the result
    is empty. The only shuffle of whole rows is the mixing itself; a hot source needs no care
    in it, since rows are dealt by hash and its rate comes from a small table.
    """
    identity = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    known = rates(df, source_col, weights, exponent, total)
    if known.count() <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    names = [c for c in df.columns if c.lower() not in ("copy_no", "shuffle_key")]
    source, rate, drawn_copies = (free_name(df, n) for n in ("_source", "_rate", "_copies"))
    known = known.toDF(source, rate)
    parts = F.greatest(F.lit(1), F.ceil(F.col(rate) / PART_RATE)).cast("int")
    drawn = F.aggregate(
        F.sequence(F.lit(1), parts),
        F.lit(0),
        lambda sum_, part: sum_
        + poisson_at(
            hashed_point(str(seed), identity, part.cast("string")),
            F.col(rate) / parts.cast("double"),
        ),
    )
    joined = df.select(*names).join(known, F.col(source_col).eqNullSafe(F.col(source)))
    copies = joined.withColumn(drawn_copies, drawn).where(F.col(drawn_copies) > 0)
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}"), identity, F.col("copy_no").cast("string"), F.lit("order")))
    return (
        copies.select(*names, F.explode(F.sequence(F.lit(1), F.col(drawn_copies))).alias("copy_no"))
        .withColumn("shuffle_key", key)
        .repartition(F.col("shuffle_key"))
        .sortWithinPartitions("shuffle_key")
    )


def mix_sql(documents: str, columns: list[str], seed: int = 42) -> str:
    """``mix`` with its default weights, for DuckDB."""
    kept = ", ".join(f"d.{c}" for c in columns)
    identity = "coalesce(CAST(doc_id AS VARCHAR), '')"
    return f"""
    WITH docs AS (SELECT * FROM {documents}),
    sizes AS (SELECT source, count(*) AS n FROM docs GROUP BY source),
    rated AS (
        SELECT source, (SELECT sum(n) FROM sizes) * (sqrt(n) / (SELECT sum(sqrt(n)) FROM sizes)) / n AS rate
        FROM sizes),
    parted AS (SELECT source, greatest(1, CAST(ceil(rate / {PART_RATE}) AS INT)) AS parts,
        rate / greatest(1, CAST(ceil(rate / {PART_RATE}) AS INT)) AS mean FROM rated),
    terms AS (
        SELECT source, mean, k, exp(k * ln(mean) - mean - lgamma(k + 1)) AS term
        FROM parted, generate_series(0, {TERMS - 1}) AS g(k)),
    reached AS (
        SELECT source, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS upto FROM terms),
    steps AS (SELECT source, list(upto ORDER BY k) AS upto FROM reached GROUP BY source),
    ids AS (SELECT DISTINCT {identity} AS id, source FROM docs),
    points AS (
        SELECT id, i.source, unnest(generate_series(1, p.parts)) AS part
        FROM ids i JOIN parted p ON i.source IS NOT DISTINCT FROM p.source),
    drawn AS (
        SELECT id, p.source, len(list_filter(s.upto, lambda x: x <
            (CAST('0x' || substr(md5('{seed}:' || id || ':' || part), 1, 11) AS BIGINT) + 0.5) / {2**44}.0)) AS k
        FROM points p JOIN steps s ON p.source IS NOT DISTINCT FROM s.source),
    copies AS (SELECT id, source, CAST(sum(k) AS INT) AS n FROM drawn GROUP BY ALL),
    out AS (
        SELECT {kept}, CAST(unnest(generate_series(1, c.n)) AS INT) AS copy_no
        FROM docs d JOIN copies c
        ON coalesce(CAST(d.doc_id AS VARCHAR), '') = c.id AND d.source IS NOT DISTINCT FROM c.source
        WHERE c.n > 0)
    SELECT *, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy_no || ':order') AS shuffle_key
    FROM out"""
