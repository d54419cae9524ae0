"""Spaced repetition: a fold over review histories, and deck statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: due is at most this many days ahead, so that it stays a date however often a card is passed.
MAX_DAYS = 1e6
STATE = "struct<ease:double,interval:double,reps:int,lapses:int,due:timestamp_ntz,last:timestamp_ntz>"


def fresh(now: Column | None = None) -> Column:
    """The state of a card that was never reviewed, due now."""
    due = F.lit(None) if now is None else now
    return F.struct(
        F.lit(2.5).alias("ease"), F.lit(0.0).alias("interval"), F.lit(0).alias("reps"), F.lit(0).alias("lapses"), due.cast("timestamp_ntz").alias("due"), F.lit(None).cast("timestamp_ntz").alias("last")
    )


def step(s: Column, grade: Column, ts: Column) -> Column:
    """The state after a review. Below 3 it lapses; else the interval grows by the ease it had before."""
    lapsed = F.struct(
        F.greatest(F.lit(1.3), s["ease"] - F.lit(0.2)).alias("ease"), F.lit(0.0).alias("interval"), F.lit(0).alias("reps"), (s["lapses"] + 1).alias("lapses"), (ts + F.expr("interval 60 seconds")).alias("due"), ts.alias("last")
    )
    base = F.when(s["reps"] == 0, F.lit(1.0)).when(s["reps"] == 1, F.lit(3.0)).otherwise(F.floor(s["interval"] * s["ease"] + 0.5).cast("double"))
    days = F.when(grade == 3, F.greatest(F.lit(1.0), F.floor(base * 0.7 + 0.5).cast("double"))).otherwise(base)
    change = F.when(grade == 3, F.lit(-0.15)).when(grade >= 5, F.lit(0.15)).otherwise(F.lit(0.0))
    passed = F.struct(
        F.greatest(F.lit(1.3), s["ease"] + change).alias("ease"), days.alias("interval"), (s["reps"] + 1).alias("reps"), s["lapses"].alias("lapses"),
        (ts + F.make_dt_interval(F.least(days, F.lit(MAX_DAYS)).cast("int"))).alias("due"), ts.alias("last"),
    )
    return F.when(grade < 3, lapsed).otherwise(passed)


def fold(reviews: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_reviews, srs) from reviews (keys, ts, seq, grade), in order of ts and seq, in one aggregate."""
    history = F.array_sort(F.collect_list(F.struct("ts", "seq", "grade")))
    rows = reviews.where("grade is not null and ts is not null").groupBy(*keys).agg(history.alias("h"))
    state = F.aggregate("h", fresh().cast(STATE), lambda s, r: step(s, r["grade"], r["ts"]).cast(STATE))
    return rows.select(*keys, F.size("h").cast("long").alias("n_reviews"), state.alias("srs"))


def deck_stats(cards: DataFrame, now: Column, deck: str = "deck_id") -> DataFrame:
    """(deck, total, due, mastered, percent) of cards (deck, srs); a card without state is fresh and due."""
    due = F.col("srs").isNull() | (F.col("srs.due") <= now)
    out = cards.groupBy(deck).agg(F.count("*").alias("total"), F.count_if(due).alias("due"), F.count_if(F.coalesce(F.col("srs.interval") >= 7, F.lit(False))).alias("mastered"))
    return out.withColumn("percent", F.floor(F.col("mastered") * 100 / F.col("total") + 0.5).cast("long"))
