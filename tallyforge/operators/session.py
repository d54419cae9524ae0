"""Study sessions in closed form: no queue is simulated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def initial_order(cards: DataFrame, seed: int = 0, shuffled: bool = True) -> DataFrame:
    """adds initial_pos from 1 in each deck: a seeded shuffle or the order of numbers."""
    by = [F.pmod((F.col("card_id") * 7919 + seed * 104729) * 31, F.lit(1000003)), F.col("card_id")] if shuffled else [F.col("number"), F.col("card_id")]
    return cards.withColumn("initial_pos", F.row_number().over(Window.partitionBy("deck_id").orderBy(*by)).cast("long"))


def presentations(cards: DataFrame, anti_guess: bool = True) -> DataFrame:
    """(deck_id, card_id, attempt_no, version, pos) for cards with misses, n_alts and initial_pos.

    A missed card goes to the back, so pass k holds all cards with k attempts or more in their first order: the place
    of a presentation is its rank by (attempt_no, initial_pos). Every earlier attempt was a miss, so versions rotate by it.
    """
    rows = cards.withColumn("attempt_no", F.explode(F.sequence(F.lit(1), F.col("misses").cast("int") + 1)))
    version = (F.col("attempt_no") - 1) % (F.col("n_alts") + 1) if anti_guess else F.lit(0)
    pos = F.row_number().over(Window.partitionBy("deck_id").orderBy("attempt_no", "initial_pos"))
    return rows.select("deck_id", "card_id", F.col("attempt_no").cast("long").alias("attempt_no"), version.cast("long").alias("version"), pos.cast("long").alias("pos"))


def report(shown: DataFrame, cards: DataFrame) -> DataFrame:
    """(deck_id, card_id, number, version, question, answer, tries) as of each card's last attempt; no answer is '—'."""
    last = shown.groupBy("deck_id", "card_id").agg(F.max("attempt_no").alias("n"), F.max_by("version", "attempt_no").alias("version"))
    alt = lambda f: F.get(F.col("alts"), (F.col("version") - 1).cast("int"))[f]
    pick = lambda f: F.when(F.col("version") == 0, F.col(f)).otherwise(alt(f))
    return last.join(cards, ["deck_id", "card_id"]).select(
        "deck_id", "card_id", "number", "version", pick("question").alias("shown_question"), F.coalesce(F.nullif(pick("answer"), F.lit("")), F.lit("—")).alias("shown_answer"),
        F.concat_ws(" ", F.col("n").cast("string"), F.when(F.col("n") == 1, "try").otherwise("tries")).alias("tries"),
    )


def summary(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, attempts, retried, perfect, seconds) of answers (keys, card_id, ts, correct)."""
    per = answers.groupBy(*keys, "card_id").agg(F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("misses"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    out = per.groupBy(*keys).agg(F.count("*").alias("total"), F.sum("n").alias("attempts"), F.count_if(F.col("misses") > 0).alias("retried"), F.min("a").alias("a"), F.max("z").alias("z"))
    seconds = F.timestamp_diff("SECOND", "a", "z") if hasattr(F, "timestamp_diff") else F.expr("timestampdiff(SECOND, a, z)")
    return out.select(*keys, "total", "attempts", "retried", (F.col("retried") == 0).alias("perfect"), seconds.alias("seconds"))


def report_lines(rows: DataFrame) -> DataFrame:
    """(deck_id, text): the report of each deck as numbered lines, one string a deck."""
    line = F.format_string("%d. %s\n   Answer: %s (%s)", F.col("number").cast("int"), F.col("shown_question"), F.col("shown_answer"), F.col("tries"))
    return rows.groupBy("deck_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("number"), F.col("card_id"), line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
