"""Multi-party conversations rendered from each participant's side."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import save, table

END = "<|end|>\n"
#: Turns a part or a piece of it holds at most; a longer conversation is rendered in parts that follow each other.
PART_TURNS = 1024


def header(role: Column, speaker: Column, system_role: str) -> Column:
    """The marker line before a turn: the speaker's own turns are the assistant's, others are users with their names."""
    return (
        F.when(role == system_role, F.lit("<|system|>\n"))
        .when(role == speaker, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))
    )


def in_pieces(rows: DataFrame, part_turns: int) -> DataFrame:
    """Distinct rows of (conv_id, part, turn, role, text) with piece and n: how many copies of a row its part's piece holds.

    A row's rank in its part is a sum of counts: of what comes before its role and the first digits of its text's MD5,
    and of what comes before it among those. No task gathers the texts of a part, nor the copies of a text.
    """
    key, digits = ["conv_id", "part", "turn", "role"], F.substring(F.md5(F.col("text").cast("binary")), 1, 3)
    each = save(rows.groupBy(*key, "text").agg(F.count("*").alias("copies")).withColumn("digits", digits), "copies")
    first = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "digits").rowsBetween(Window.unboundedPreceding, -1)
    groups = each.groupBy(*key, "digits").agg(F.sum("copies").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(first), F.lit(0))).drop("held")
    among = Window.partitionBy(*key, "digits").orderBy(F.md5(F.col("text").cast("binary")), "text").rowsBetween(Window.unboundedPreceding, -1)
    ranked = each.withColumn("inside", F.coalesce(F.sum("copies").over(among), F.lit(0))).alias("e")
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"g.{c}")) for c in (*key, "digits")]
    placed = ranked.join(groups.alias("g"), reduce(and_, same)).select("e.*", (F.col("before") + F.col("inside")).alias("begin"))
    size, end = F.lit(part_turns), F.col("begin") + F.col("copies")
    pieces = placed.withColumn("piece", F.explode(F.sequence(F.floor(F.col("begin") / size), F.floor((end - 1) / size))))
    n = F.least(end, (F.col("piece") + 1) * size) - F.greatest(F.col("begin"), F.col("piece") * size)
    return pieces.select("conv_id", "turn", "role", "text", "part", "piece", n.alias("n"))


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system_role: str = "system", part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, speaker, part, piece, n_turns, text, masks, n_masked): one row for each participant and piece of a conversation.

    text holds all turns of the piece in order of turn, role, MD5 of the text and text; masks are (begin, end) offsets in
    characters of what the speaker says, its end marker included, and n_masked is their total length. Every distinct
    role but system_role is a participant; a conversation without one has no row. Part p holds the turns numbered from
    p * part_turns; turns without a number come first, in part -1. A part of more than part_turns turns, as numbers
    repeat or are missing, is cut into pieces of that many, so no row grows with a conversation; texts of a
    conversation's parts and pieces, put together in order, are its rendering, with masks counted from each one's start.
    A null role is the participant "unknown", a null text empty, a null conv_id a conversation like any other. Repeated
    rows are repeated turns. Empty tables give no rows; other columns are ignored.
    """
    src = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("part", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)))
    full = save(src.groupBy("conv_id", "part").agg(F.count("*").alias("n")).where(F.col("n") > part_turns).select("conv_id", "part"), "full")
    whole, cut = src.withColumns({"piece": F.lit(0).cast("long"), "n": F.lit(1).cast("long")}), None
    if full.limit(1).count():
        same = src.conv_id.eqNullSafe(full.conv_id) & (src.part == full.part)
        cut = in_pieces(src.join(full, same, "left_semi"), part_turns)
        whole = whole.join(full, whole.conv_id.eqNullSafe(full.conv_id) & (whole.part == full.part), "left_anti").unionByName(cut)
    sorted_turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.md5(F.col("text").cast("binary")).alias("md5"), "text", "n")))
    repeated = F.flatten(F.transform(sorted_turns, lambda t: F.array_repeat(F.struct(t.turn.alias("turn"), t.role.alias("role"), t.text.alias("text")), t.n.cast("int"))))
    parts = whole.groupBy("conv_id", "part", "piece").agg(repeated.alias("turns"))
    speakers = src.where(F.col("role") != system_role).select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    both = parts.join(speakers, parts.conv_id.eqNullSafe(speakers.of)).drop("of")
    speaker = F.col("speaker")
    pieces = both.withColumn(
        "pieces",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(header(t.role, speaker, system_role), t.text, F.lit(END)).alias("all"),
                F.length(header(t.role, speaker, system_role)).alias("head"),
                (t.role == speaker).alias("own"),
            ),
        ),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("masks"))

    def step(acc: Column, p: Column) -> Column:
        after = acc.at + F.length(p["all"])
        mask = F.array(F.struct((acc.at + p["head"]).alias("begin"), after.alias("end")))
        return F.struct(after.alias("at"), F.when(p["own"], F.concat(acc.masks, mask)).otherwise(acc.masks).alias("masks"))

    return pieces.select(
        "conv_id",
        "speaker",
        "part",
        "piece",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: p["all"]), "").alias("text"),
        F.aggregate("pieces", zero, step, lambda acc: acc.masks).alias("masks"),
    ).withColumn("n_masked", F.aggregate("masks", F.lit(0).cast("long"), lambda a, m: a + m["end"] - m["begin"]))


def op6_chat_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m.begin.cast("string"), m.end.cast("string"))), ",")
    return views.select("conv_id", "speaker", "part", "piece", "n_turns", "text", spans.alias("mask_spans"), "n_masked")


OP6_SQL = """
WITH u AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    CAST(coalesce(floor(turn / 1024.0), -1) AS BIGINT) AS part FROM conversations
), t AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn, role, md5(text), text) - 1) // 1024 AS piece FROM u
), s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
r AS (
  SELECT t.conv_id, s.speaker, t.part, t.piece, t.turn, t.role, t.text,
    CASE WHEN t.role = 'system' THEN '<|system|>' || chr(10) WHEN t.role = s.speaker THEN '<|assistant|>' || chr(10)
      ELSE '<|user name=' || t.role || '|>' || chr(10) END AS head
  FROM t JOIN s ON s.conv_id = t.conv_id
), p AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS said FROM r
), o AS (
  SELECT *, CAST(sum(length(said)) OVER (PARTITION BY conv_id, speaker, part, piece ORDER BY turn, role, md5(text), text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ends FROM p
)
SELECT conv_id, speaker, part, piece, count(*) AS n_turns, string_agg(said, '' ORDER BY turn, role, md5(text), text) AS text,
  coalesce(string_agg(CASE WHEN role = speaker THEN CAST(ends - length(said) + length(head) AS VARCHAR) || '-' || CAST(ends AS VARCHAR) END, ',' ORDER BY turn, role, md5(text), text), '') AS mask_spans,
  CAST(sum(CASE WHEN role = speaker THEN length(said) - length(head) ELSE 0 END) AS BIGINT) AS n_masked
FROM o GROUP BY conv_id, speaker, part, piece
"""
