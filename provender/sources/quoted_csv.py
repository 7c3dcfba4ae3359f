"""CSV whose quoted fields may hold line breaks, read by many tasks a file.

Whether a line break ends a record depends on everything before it in the file. Spark's line reader
cuts a file into blocks that start at a line, and at a line start there are only two states: a record
begins, or a quoted field goes on. So a first pass finds for each block, from either state, the state it
ends in and how many records begin in it. Composing these over the blocks of a file gives each
block's true state and the number of records before it, which is also the ordinal of its first
record. A second pass cuts every block into records on its own. Parts of a record that lies across
blocks carry its ordinal and are put together by it. Fields are then taken apart by Spark.

The table of blocks has a row for each task of the scan, a list that the driver holds in any case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provender.errors import DataError

#: How fields are quoted, as options of Spark's reader and parser.
OPTIONS = {
    "multiLine": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
MIN_SPLITS = "spark.sql.files.minPartitionNum"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open after ``line``, given whether one was before it.

    A quote opens a field only as its first character. Two quotes inside are one character, any other
    quote closes the field, and what follows up to the next comma belongs to it.
    """
    at = 0
    if not inside:
        if '"' not in line:
            return False
        if line[0] == '"':
            at, inside = 1, True
    while True:
        if inside:
            quote = line.find('"', at)
            if quote < 0:
                return True
            if line.startswith('"', quote + 1):
                at = quote + 2
                continue
            comma = line.find(",", quote + 1)
            if comma < 0:
                return False
            at, inside = comma + 1, line.startswith('"', comma + 1)
            at += inside
        else:
            opening = line.find(',"', at)
            if opening < 0:
                return False
            at, inside = opening + 2, True


@dataclass(frozen=True)
class Block:
    """A block of a file and what it does to either state: (record begins, field goes on)."""

    file: str
    start: int
    ends: tuple[bool, bool]
    begun: tuple[int, int]
    #: Of the records begun, lines that are a carriage return only.
    returns: tuple[int, int] = (0, 0)
    #: Whether the block's first line ends with a carriage return.
    crlf: bool = False


@dataclass(frozen=True)
class Start:
    """Where a block starts: whether a quoted field is open, the ordinal of the record it belongs to, the
    ordinal of the next record, whether a header comes before that, and whether the file's lines end
    with a carriage return too, which is how its first line ends."""

    inside: bool
    current: int
    following: int
    header: bool
    crlf: bool = False


#: The ordinal of headers, which are no rows.
HEADER = -1


def compose(blocks: list[Block]) -> tuple[dict[tuple[str, int], Start], bool]:
    """Where each block (file, start) starts, files in order of their paths, and whether any record
    goes on beyond its block. The first record of every file is its header; an open field ends with
    its file."""
    found: dict[tuple[str, int], Start] = {}
    across, file, following = False, None, 0
    inside, current, header, crlf = False, HEADER, True, False
    for block in sorted(blocks, key=lambda b: (b.file, b.start)):
        if block.file != file:
            file, inside, current, header, crlf = block.file, False, HEADER, True, block.crlf
        found[file, block.start] = Start(inside, current, following, header, crlf)
        begun = block.begun[inside] - crlf * block.returns[inside]
        if begun:
            following += begun - header
            current = HEADER if header and begun == 1 else following - 1
            header = False
        inside = block.ends[inside]
        across |= inside
    return found, across


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, value``. Files have to be cut alike in both passes, so the number of pieces no
    longer follows the executors that happen to be there."""
    if spark.conf.get(MIN_SPLITS, None) is None:
        spark.conf.set(MIN_SPLITS, str(spark.sparkContext.defaultParallelism))
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """Runs of lines of one block. Blocks come one after the other, each perhaps in several runs."""
    for batch in batches:
        starts = batch.column(1).to_pylist()
        files = batch.column(0).to_pylist()
        values = batch.column(2).to_pylist()
        at = 0
        for i in range(1, len(starts) + 1):
            if i == len(starts) or starts[i] != starts[at] or files[i] != files[at]:
                yield files[at], starts[at], values[at:i]
                at = i


def blocks_of(lines: DataFrame) -> list[Block]:
    """What each block of ``lines`` does, in one pass."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[tuple[str, int], list] = {}
        for file, start, values in _by_block(batches):
            state = table.setdefault((file, start), [False, True, 0, 0, 0, 0, values[0].endswith("\r")])
            for line in values:
                if line:
                    state[2] += not state[0]
                    state[3] += not state[1]
                    if line == "\r":
                        state[4] += not state[0]
                        state[5] += not state[1]
                if '"' in line:
                    same = state[0] == state[1]
                    state[0] = ends_inside(line, state[0])
                    state[1] = state[0] if same else ends_inside(line, state[1])
        rows = [(*key, *state) for key, state in table.items()]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(names, row, strict=True)) for row in rows], schema=pa.schema(list(zip(names, kinds, strict=True)))
        )

    names = ["file", "block", "end_n", "end_q", "begun_n", "begun_q", "returns_n", "returns_q", "crlf"]
    kinds = [pa.string(), pa.int64(), *[pa.bool_()] * 2, *[pa.int64()] * 4, pa.bool_()]
    ddl = "file string, block long, end_n boolean, end_q boolean, begun_n long, begun_q long, returns_n long, returns_q long, crlf boolean"
    return [
        Block(r[0], r[1], (r[2], r[3]), (r[4], r[5]), (r[6], r[7]), r[8])
        for r in lines.mapInArrow(summed, ddl).collect()
    ]


def _cut(lines: DataFrame, shared: Broadcast, whole: bool) -> DataFrame:
    """``ordinal, block, text``: the records of ``lines`` that lie in one block, or else the parts of the
    others."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        key: tuple[str, int] | None = None
        held: list[str] = []
        out: list[tuple[int, int, str]] = []
        inside = here = header = crlf = False
        current = following = HEADER

        def put(ended: bool) -> None:
            if held and current != HEADER and (ended and here) == whole:
                out.append((current, key[1], "\n".join(held)))
            held.clear()

        for file, start, values in _by_block(batches):
            if (file, start) != key:
                put(False)
                key = (file, start)
                if key not in table:
                    raise DataError(f"{file} was cut otherwise, or changed, while it was read")
                at = table[key]
                inside, current, following, header, crlf = at.inside, at.current, at.following, at.header, at.crlf
                here = False
            for line in values:
                if crlf and line.endswith("\r"):
                    line = line[:-1]
                if not inside:
                    if not line:
                        continue
                    here = True
                    current, following = (HEADER, following) if header else (following, following + 1)
                    header = False
                held.append(line)
                if '"' in line:
                    inside = ends_inside(line, inside)
                if not inside:
                    put(True)
            if len(out) >= 10_000:
                yield _batch(out)
                out.clear()
        put(False)
        yield _batch(out)

    return lines.mapInArrow(records, "ordinal long, block long, text string")


def _batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["ordinal", "block", "text"]
    )


def read(spark: SparkSession, path: str, ordinal: str | None = None) -> DataFrame:
    """The rows of the CSV files at ``path``, every column a string, as Spark's reader gives them with
    ``multiLine``: names from the header, short rows filled with nulls, blank lines left out.

    ``ordinal`` names a column with the rows' numbers, from 0 without gaps, files in order of their
    paths. Lines end with a line feed, or with a carriage return and one if a file's first line does; then
    the line breaks inside its fields lose theirs too, and a line feed alone ends a record all the same. A
    quoted field that is never closed ends with its file.
    """
    plain = spark.read.options(header=True, inferSchema=False, **OPTIONS).csv(path)
    if not plain.columns:
        return plain if ordinal is None else plain.withColumn(ordinal, F.lit(0).cast("long"))
    lines = _lines(spark, path)
    starts, across = compose(blocks_of(lines))
    shared = spark.sparkContext.broadcast(starts)
    records = _cut(lines, shared, whole=True).select("ordinal", "text")
    if across:
        parts = F.array_sort(F.collect_list(F.struct("block", "text")))
        joined = F.concat_ws("\n", F.transform(parts, lambda p: p["text"]))
        records = records.union(_cut(lines, shared, whole=False).groupBy("ordinal").agg(joined.alias("text")))
    ddl = ", ".join("`" + name.replace("`", "``") + "` string" for name in plain.columns)
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in OPTIONS.items()}
    fields = records.select("ordinal", F.from_csv("text", ddl, {**options, "lineSep": "\n"}).alias("fields"))
    numbered = [F.col("ordinal").alias(ordinal)] if ordinal else []
    return fields.select(*[F.col("fields").getField(c).alias(c) for c in plain.columns], *numbered)
