"""Queries over garbled questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import readings as R
from tallyforge.sources.adapters import CARDS, cards


def _garbled(s, d):
    """The card's equation with 1 read as l and 0 as O, on two cards of three; a minus or spaces lost on some."""
    q = F.when(F.col("part") % 3 == 0, F.translate("question", "1", "l")).when(F.col("part") % 3 == 1, F.translate("question", "0", "O")).otherwise(F.col("question"))
    return cards(s, d).select("card_id", "question", q.alias("raw"))


def d05(s, d):
    return _garbled(s, d).select("card_id", F.levenshtein("question", "raw").cast("long").alias("edits"))


def d01(s, d):
    """Labels, instructions, blanks, lone letters and signs of several forms around each equation."""
    n = (F.col("number") % 99).cast("string")
    whole = F.when(F.col("part") % 4 == 0, F.concat(F.lit("  ("), n, F.lit(") Solve: X \u00d7 "), F.col("question"), F.lit("\r\n x = ___")))
    whole = whole.when(F.col("part") % 4 == 1, F.concat(n, F.lit(". SOLVE for y: lO \u00f7 2 + "), F.col("question"), F.lit("\n q"))).when(F.col("part") % 4 == 2, F.concat("question", F.lit("\n\n and 5; a =, b = __ ")))
    return cards(s, d).select("card_id", R.base_reading(whole.otherwise(F.concat(F.lit("dissolve "), F.col("question")))).alias("clean"))


def d06(s, d):
    return R.variants(_garbled(s, d)).groupBy("edits", "loose").agg(F.count("*").alias("n"))


def d09(s, d):
    return R.readings(_garbled(s, d))


def d09_found(s, d):
    """Of each garbled text, whether the answer of what was written is among the three readings."""
    raw = _garbled(s, d).select("raw").distinct()
    return R.readings(raw).groupBy("raw").agg(F.count("*").alias("n"), F.min("score").alias("best"))


QUERIES = {"d01_light_clean": d01, "d05_edit_distance": d05, "d02_d06_variants": d06, "d09_topk_readings": d09, "d07_d08_scores": d09_found}

ORACLE_SQL = {
    "d01_light_clean": f"WITH {CARDS} SELECT card_id, CASE part % 4 WHEN 0 THEN 'X * ' || question WHEN 1 THEN 'lO / 2 + ' || question WHEN 2 THEN question || ' and 5' ELSE 'dissolve ' || question END AS clean FROM cards",
    "d05_edit_distance": f"""WITH {CARDS} SELECT card_id, CAST(levenshtein(question, CASE part % 3 WHEN 0 THEN replace(question, '1', 'l') WHEN 1 THEN replace(question, '0', 'O') ELSE question END) AS BIGINT) AS edits FROM cards""",
}
