"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provender import schema as S

# Fixed value: the characters Python's str.strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# A dimension table up to this many rows may be broadcast.
MAX_BROADCAST_ROWS = 200_000

# Fixed value: bytes of a method that the JVM still compiles. Larger ones are interpreted, ten times slower.
COMPILED_BYTES = 8000


def compile_wide_rows(spark: SparkSession) -> None:
    """Have Spark cut up the code of wide projections that would be one method too large for the JVM to compile.

    Spark's own setting lets such a method pass up to 65,535 bytes. It holds for the session, and changes no result."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED_BYTES)


def strip(column: Column) -> Column:
    """Remove white space, Unicode kinds included, from both ends.

    Text that begins and ends with a printing ASCII character, told by cheap comparisons, is left as it is.
    ``column`` is read several times."""
    last = F.substring(column, -1, 1)
    plain = (column >= "!") & (column < "\x7f") & (last >= "!") & (last < "\x7f")
    return either(plain, column, F.btrim(column, F.lit(WHITESPACE)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``, inside one expression.

    An ``aggregate`` over nothing: the start value goes straight to the last step. (A one-element
    ``transform`` would do too, but copies its result, which adds up when steps are nested.)
    """
    nothing = F.array().cast("array<int>")
    return F.aggregate(nothing, value, lambda kept, _: kept, body)


def either(condition: Column, value: Column, other: Column | None = None) -> Column:
    """``value`` where the condition holds, else ``other`` or null.

    Inside lambdas, which Spark does not compile, ``F.when`` finds its branches by walking a list, for every row anew."""
    return F.call_function("if", condition, value, F.lit(None) if other is None else other)


def constant(value, ddl: str) -> Column:
    """A literal of any nested type. The JSON text is folded to a literal at planning time."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), ddl)


def is_any(column: Column, words: Iterable[str]) -> Column:
    """Membership in a fixed list; null counts as not a member."""
    words = list(words)
    return F.coalesce(column.isin(words), F.lit(False)) if words else F.lit(False)


def lookup(key: Column, table: dict, value_ddl: str) -> Column:
    """Value of ``key`` in a fixed table, null when absent.

    A map literal is searched from end to end, so the table is cut into buckets by the CRC-32 of
    its keys and only the key's own bucket, an entry or two, is searched. The whole table is one
    literal in the plan, whatever its size.
    """
    if not table:
        return F.lit(None).cast(value_ddl)
    buckets: list[dict] = [{} for _ in range(2 * len(table))]
    for word, value in table.items():
        buckets[zlib.crc32(word.encode()) % len(buckets)][word] = value
    place = (F.crc32(key.cast("binary")) % len(buckets)).cast("int")
    bucket = F.get(constant(buckets, f"array<map<string,{value_ddl}>>"), place)
    return F.try_element_at(bucket, key)


def list_text(column: Column) -> Column:
    """An array of strings in list notation, such as ``['a', 'b']``."""

    def item(x: Column) -> Column:
        escaped = F.replace(x, F.lit("\\"), F.lit("\\\\"))
        single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
        double = F.concat(F.lit('"'), escaped, F.lit('"'))
        return F.when(F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"')), double).otherwise(
            single
        )

    return F.concat(F.lit("["), F.array_join(F.transform(column, item), ", "), F.lit("]"))


def packed(columns: Iterable[str]) -> Column:
    """Columns of text or lists of text as one value, the same for equal rows only. A place for each of many columns,
    most of them null, takes more room in a shuffle than what they hold."""
    return F.to_json(F.struct(*[F.col(S.quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)]))


def unpacked(df: DataFrame, column: str, kinds: dict[str, str]) -> DataFrame:
    """``df`` with the columns that :func:`packed` put into ``column``, of the given types, in its place."""
    fields = ", ".join(f"c{i} {kind}" for i, kind in enumerate(kinds.values()))
    opened = F.from_json(column, fields, {"mode": "FAILFAST", "maxStringLen": str(2**31 - 1)})
    rest = [F.col(S.quoted(c)) for c in df.columns if c != column]
    # ``inline`` takes a row apart once, not once for each column.
    rows = df.select(*rest, F.inline(F.array(opened.alias(column))))
    return rows.select(*rest, *[F.col(f"c{i}").alias(c) for i, c in enumerate(kinds)])


def broadcast_if_small(table: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark a dimension table for broadcasting when it is proven small.

    A larger one is returned unmarked, and the join is left to shuffle. The check counts at most
    ``max_rows + 1`` rows; persist a derived table first so that it is not computed twice.
    """
    size = table.limit(max_rows + 1).count()
    return F.broadcast(table) if size <= max_rows else table
