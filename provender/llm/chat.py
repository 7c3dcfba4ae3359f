"""Multi-party perspective rotation of dialogues.

For every participant of a dialogue a rendering in which that one is the assistant and the others
are named users. System turns keep their role in all of them. With each rendering go the spans
(code points, from and to) that the participant said, which are those to train on.

Marks inside a text or name are no marks: each ``<|`` there is written ``< |``, so that a text cannot
end its turn or forge another; line breaks in names are written as spaces.

A dialogue of any length is rendered in parts of at most ``PART`` turns; the parts of a
participant, joined in order, are the whole rendering. So no task holds a whole long dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provender.llm.common import cut

#: Turns in a part.
PART = 64
# The marks of the rendering.
OPEN, NAME, BODY, CLOSE = "<|im_start|>", " name=", "\n", "<|im_end|>\n"
#: How marks start, and how that is written inside texts and names.
MARK, WRITTEN = "<|", "< |"
#: The role that is nobody's and the name of those who have none.
SYSTEM, NAMELESS = "system", "unknown"


def unmarked(text: Column) -> Column:
    """``text`` with nothing in it that reads as a mark."""
    return F.replace(text, F.lit(MARK), F.lit(WRITTEN))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` (conv, turn, role, body) with the position of each turn in its dialogue, from 0.

    Turns are in order of number, role and text, nulls first. Rows are ranged over the cluster by
    that order and numbered from the sizes of the pieces before, so a dialogue that holds a third
    of all rows lies in many tasks. The ranged rows are written once, because both readers have
    to see the same pieces.
    """
    order = ["conv", "turn", "role", "body"]
    ranged = cut(df.repartitionByRange(*order).withColumn("_piece", F.spark_partition_id()))
    inside = Window.partitionBy("_piece", "conv").orderBy("turn", "role", "body")
    sizes = ranged.groupBy("_piece", "conv").agg(F.count(F.lit(1)).alias("_n"))
    # A dialogue has a row here for each piece that it reaches into, not for each turn.
    before = Window.partitionBy("conv").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("_piece").alias("_p"),
        F.col("conv").alias("_c"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("conv")).alias("n_turns"),
    )
    same = (F.col("_piece") == F.col("_p")) & F.col("conv").eqNullSafe(F.col("_c"))
    return (
        ranged.withColumn("_at", F.row_number().over(inside) - 1)
        .join(starts, same)
        .withColumn("position", F.col("_at") + F.col("_before"))
        .select("conv", "turn", "role", "body", "position", "n_turns")
    )


def rotate(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv_id, participant, part, n_parts, n_turns, text, train_spans, n_train_chars``.

    Null texts are empty turns; a null role is a participant named "unknown"; rows without a
    conversation id form one conversation; repeated rows are repeated turns; turns that tie are
    ordered by role and text. A dialogue with system turns only has no participant and gives no
    row. Control marks in texts and names are written so that they are none; ``participant`` is the name
    as it stands. Other columns are not looked at. Spans are written "from-to", comma-joined.
    """
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(NAMELESS))
    read = df.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"),
    )
    parts = (
        numbered(read)
        .withColumn("body", unmarked(F.col("body")))
        .withColumn("part", F.floor(F.col("position") / PART).cast("int"))
        .groupBy("conv", "part", "n_turns")
        .agg(F.sort_array(F.collect_list(F.struct("position", "role", "body"))).alias("turns"))
    )
    people = read.where(F.col("role") != SYSTEM).select(
        F.col("conv").alias("_c"), F.col("role").alias("participant")
    ).distinct()
    own = F.col("participant")

    def said(turn: Column) -> Column:
        return turn["role"] == own

    def head(turn: Column) -> Column:
        return F.concat(
            F.lit(OPEN),
            F.when(said(turn), F.lit("assistant"))
            .when(turn["role"] == SYSTEM, F.lit(SYSTEM))
            .otherwise(F.concat(F.lit("user" + NAME), F.translate(unmarked(turn["role"]), "\n", " "))),
            F.lit(BODY),
        )

    pieces = F.transform("turns", lambda t: F.concat(head(t), t["body"], F.lit(CLOSE)))
    ends = F.transform(
        F.sequence(F.lit(1), F.size("_lengths")),
        lambda i: F.aggregate(F.slice("_lengths", F.lit(1), i), F.lit(0), lambda a, b: a + b),
    )
    spans = F.transform(
        F.filter(F.arrays_zip("turns", "_ends", "_lengths"), lambda x: said(x["turns"])),
        lambda x: F.struct(
            (x["_ends"] - x["_lengths"] + F.length(head(x["turns"]))).alias("begin"),
            x["_ends"].alias("end"),
        ),
    )
    return (
        parts.join(people, F.col("conv").eqNullSafe(F.col("_c")))
        .withColumn("_pieces", pieces)
        .withColumn("_lengths", F.transform("_pieces", lambda p: F.length(p)))
        .withColumn("_ends", ends)
        .withColumn("_spans", spans)
        .select(
            F.col("conv").alias("conv_id"),
            "participant",
            "part",
            F.ceil(F.col("n_turns") / PART).cast("int").alias("n_parts"),
            "n_turns",
            F.array_join("_pieces", "").alias("text"),
            F.array_join(
                F.transform("_spans", lambda s: F.concat_ws("-", s["begin"], s["end"])), ","
            ).alias("train_spans"),
            F.aggregate(
                "_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"]
            ).alias("n_train_chars"),
        )
    )


def rotate_sql(conversations: str) -> str:
    """``rotate`` for DuckDB."""
    return f"""
    WITH turns AS (
        SELECT conv_id, coalesce(role, '{NAMELESS}') AS role,
            replace(coalesce(text, ''), '{MARK}', '{WRITTEN}') AS body,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '{NAMELESS}'),
                coalesce(text, '')) - 1 AS position,
            count(*) OVER (PARTITION BY conv_id) AS n_turns
        FROM {conversations}),
    people AS (SELECT DISTINCT conv_id, role AS participant FROM turns WHERE role <> '{SYSTEM}'),
    said AS (
        SELECT t.*, CAST(position // {PART} AS INT) AS part, participant, role = participant AS own,
            '{OPEN}' || CASE WHEN role = participant THEN 'assistant' WHEN role = '{SYSTEM}' THEN '{SYSTEM}'
                ELSE 'user{NAME}' || replace(replace(role, '{MARK}', '{WRITTEN}'), chr(10), ' ') END || chr(10) AS head
        FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
    placed AS (
        SELECT *, head || body || '<|im_end|>' || chr(10) AS piece,
            sum(length(head || body) + {len(CLOSE)}) OVER (
                PARTITION BY conv_id, participant, part ORDER BY position) AS upto
        FROM said)
    SELECT conv_id, participant, part, CAST(ceil(any_value(n_turns) / {PART}) AS INT) AS n_parts,
        any_value(n_turns) AS n_turns,
        string_agg(piece, '' ORDER BY position) AS text,
        coalesce(string_agg((upto - length(body) - {len(CLOSE)}) || '-' || upto, ',' ORDER BY position)
            FILTER (WHERE own), '') AS train_spans,
        CAST(coalesce(sum(length(body) + {len(CLOSE)}) FILTER (WHERE own), 0) AS BIGINT) AS n_train_chars
    FROM placed GROUP BY conv_id, participant, part"""
