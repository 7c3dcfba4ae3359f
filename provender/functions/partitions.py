"""Using all cores on inputs that arrive in few pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan that has fewer partitions than the cluster has cores.

    Normalization costs far more than reading, and a small file is one partition. On inputs with
    enough partitions, which is every large one, this changes nothing. Call it on a plain scan:
    the partitions of a joined table are only known once it has run. Streams stay as they are.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, keys: list[str], rows: int, rows_per_task: int = 250_000) -> DataFrame:
    """``df``, of about ``rows`` rows, in as many partitions as keep each to ``rows_per_task``, by hash of ``keys``.

    Scans and joins make partitions by bytes, and keys are few bytes a row where the columns worked out from them
    are many. What a task sorts or caches of them is bounded here, so that it does not grow with the table.
    Keys together have to tell rows apart. A table for one task is left as it is.
    """
    pieces = -(-rows // rows_per_task)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(pieces, cores), *keys) if pieces > 1 else df
