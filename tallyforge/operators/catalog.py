"""Relational reads and writes over teachers, decks, cards and runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sources import scratch


def teachers_with_counts(teachers: DataFrame, decks: DataFrame) -> DataFrame:
    """Teachers with their number of decks, 0 where they have none."""
    n = decks.groupBy(F.col("owner_id").alias("teacher_id")).agg(F.count("*").alias("deck_count"))
    return teachers.join(n, "teacher_id", "left").withColumn("deck_count", F.coalesce("deck_count", F.lit(0).cast("long")))


def with_owner(decks: DataFrame, teachers: DataFrame, default: str) -> DataFrame:
    """Decks with owner_name, default where the owner is not known."""
    names = teachers.select(F.col("teacher_id").alias("owner_id"), F.col("name").alias("owner_name"))
    return decks.join(names, "owner_id", "left").withColumn("owner_name", F.coalesce("owner_name", F.lit(default)))


def students_per_deck(runs: DataFrame) -> DataFrame:
    """(deck_id, students): distinct students with any run."""
    return runs.groupBy("deck_id").agg(F.countDistinct("student_id").alias("students"))


def listing(decks: DataFrame, cards: DataFrame, runs: DataFrame, owner: Column | None = None) -> DataFrame:
    """Decks of an owner (all for None) with card_count, alt_versions and students."""
    seen = decks if owner is None else decks.where(F.col("owner_id") == owner)
    per = cards.groupBy("deck_id").agg(F.count("*").alias("card_count"), F.max("n_alts").alias("alt_versions"))
    out = seen.join(per, "deck_id", "left").join(students_per_deck(runs), "deck_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("card_count", "alt_versions", "students")})


def visible(decks: DataFrame, role: str | None, viewer_id: int | None = None, disabled: bool = False) -> DataFrame:
    """The decks that a viewer may read and change: all for an owner of the site, a teacher's own for a teacher, none for a disabled account or any other role."""
    if disabled or role not in ("owner", "teacher"):
        return decks.limit(0)
    return decks if role == "owner" else decks.where(F.coalesce(F.col("owner_id") == F.lit(viewer_id), F.lit(False)))


def visible_to_each(decks: DataFrame, teachers: DataFrame) -> DataFrame:
    """(teacher_id, deck_id) of the decks that each teacher may read: their own, none while the account is disabled; decks of accounts that are not there are nobody's."""
    active = teachers.where(~F.coalesce("disabled", F.lit(False))).select(F.col("teacher_id"))
    return decks.join(active, F.col("owner_id") == F.col("teacher_id")).select("teacher_id", "deck_id")


def deck_by_id(decks: DataFrame, deck_id: int, owner_id: int | None = None) -> DataFrame:
    """The deck if it is there and, with owner_id, theirs; else no row."""
    found = decks.where(F.col("deck_id") == deck_id)
    return found if owner_id is None else found.where(F.col("owner_id") == owner_id)


def published(decks: DataFrame, teachers: DataFrame) -> DataFrame:
    """The catalogue of published decks, with needs_code."""
    rows = with_owner(decks.where("published"), teachers, "Teacher")
    return rows.withColumn("needs_code", F.coalesce(F.col("class_code") != "", F.lit(False)))


def for_student(decks: DataFrame, code: str | None) -> DataFrame:
    """Published decks that a student with this code may open."""
    return decks.where(F.col("published") & ((F.coalesce("class_code", F.lit("")) == "") | (F.col("class_code") == F.lit(code))))


def latest_runs(runs: DataFrame) -> DataFrame:
    """Each student's latest run of each deck; ties go to the larger run_id. One partial aggregate, no window."""
    rest = [c for c in runs.columns if c not in ("student_id", "deck_id")]
    best = runs.groupBy("student_id", "deck_id").agg(F.max(F.struct("finished_at", "run_id", *[c for c in rest if c not in ("finished_at", "run_id")])).alias("r"))
    return best.select("student_id", "deck_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def run_totals(runs: DataFrame) -> DataFrame:
    """The upsert of runs as a view of the facts: how many, and the last one's figures."""
    return runs.groupBy("student_id", "deck_id").agg(
        F.count("*").alias("runs"), F.max("finished_at").alias("finished_at"), F.max_by("seconds", F.struct("finished_at", "run_id")).alias("seconds")
    )


def save_deck(new: DataFrame, old: DataFrame) -> DataFrame:
    """Cards of a saved deck: blank questions go; a number is the given, the old or the position; alternates the given or the old."""
    n = new.where(F.trim(F.coalesce("question", F.lit(""))) != "").alias("n")
    o = old.select("deck_id", "card_id", F.col("number").alias("old_number"), F.col("n_alts").alias("old_alts"))
    joined = n.join(o, ["deck_id", "card_id"], "left")
    return joined.select("deck_id", "card_id", F.coalesce("number", "old_number", "pos").alias("number"), "question", F.coalesce("n_alts", "old_alts", F.lit(0).cast("long")).alias("n_alts"))


def set_published(decks: DataFrame, ids: DataFrame, value: bool) -> DataFrame:
    """Decks with published set where their id is listed."""
    marked = decks.join(ids.select("deck_id", F.lit(True).alias("_hit")).distinct(), "deck_id", "left")
    return marked.withColumn("published", F.when(F.col("_hit"), F.lit(value)).otherwise(F.col("published"))).drop("_hit")


def attach_alternates(cards: DataFrame, alternates: DataFrame) -> DataFrame:
    """Cards with the last alternate of their number appended to alts, and paired."""
    last = alternates.groupBy("deck_id", "number").agg(F.max_by(F.struct("question", "answer"), "seq").alias("_alt"))
    joined = cards.join(last, ["deck_id", "number"], "left")
    return joined.withColumns({"alts": F.when(F.col("_alt").isNull(), F.col("alts")).otherwise(F.concat("alts", F.array("_alt"))), "paired": F.col("_alt").isNotNull()}).drop("_alt")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among gone."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def delete_teacher(teachers: DataFrame, decks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Teachers without those gone; their decks stay but are no longer published."""
    theirs = decks.join(gone.select(F.col("teacher_id").alias("owner_id")).distinct(), "owner_id", "left_semi").select("deck_id")
    return without(teachers, gone, "teacher_id"), set_published(decks, theirs, False)


def taken(names: DataFrame, teachers: DataFrame) -> DataFrame:
    """Those of names (username) that a teacher has already, whatever their case."""
    return names.join(teachers.select(F.lower("username").alias("_u")).distinct(), F.lower("username") == F.col("_u"), "left_semi")


def next_numbers(cards: DataFrame) -> DataFrame:
    """(deck_id, next_number)."""
    return cards.groupBy("deck_id").agg((F.max("number") + 1).alias("next_number"))


def answered(cards: DataFrame) -> DataFrame:
    """(deck_id, with_answers)."""
    return cards.groupBy("deck_id").agg(F.count_if(F.trim(F.coalesce("answer", F.lit(""))) != "").alias("with_answers"))


def _running(rows: DataFrame, name: str, value: Column, of=F.max, back: bool = False, strict: bool = False) -> DataFrame:
    """rows (_k, _part, _i, ...) with name: of(value) over the rows of _k up to this one, or from it on (back); strict leaves itself out.

    Each part is run through by itself, and the parts of a key, which are few, carry their totals on. Backward is forward in
    falling order, as Spark computes a frame up to the last row anew for each row.
    """
    whole, own = Window.unboundedPreceding, -1 if strict else 0
    order = F.desc if back else F.asc
    per = rows.groupBy("_k", "_part").agg(of(value).alias("_v"))
    per = per.select("_k", "_part", of("_v").over(Window.partitionBy("_k").orderBy(order("_part")).rowsBetween(whole, -1)).alias("_carry"))
    local = of(value).over(Window.partitionBy("_k", "_part").orderBy(order("_i")).rowsBetween(whole, own))
    pick = F.greatest if of is F.max else F.least
    return rows.join(per, ["_k", "_part"]).withColumn("_local", local).withColumn(name, pick("_local", "_carry")).drop("_local", "_carry")


def _in_parts(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows written in ranges of _k and order, with _part, the range, and _i, the place in it among the rows of _k."""
    ranged = rows.repartitionByRange("_k", *order).withColumn("_part", F.spark_partition_id())
    return scratch.keep(ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_k", "_part").orderBy(*order)).cast("long")), name)


def _exits(links: pd.DataFrame) -> pd.DataFrame:
    """(_k, pos, exit) of one part's links: the first place outside the part that a place's pointers lead to. Pointers lead on, so one pass from the end does."""
    out: dict[int, int | None] = {}
    for pos, to in sorted(zip(links["pos"], links["next"], strict=True), reverse=True):
        to = None if pd.isna(to) else int(to)
        out[pos] = out.get(to, to)
    return pd.DataFrame({"_k": links["_k"].iloc[0], "pos": list(out), "exit": pd.array(list(out.values()), dtype="Int64")})


def _walked(links: pd.DataFrame) -> pd.DataFrame:
    """(_k, pos) of one part's places that its entered ones lead to, themselves included."""
    out: set[int] = set()
    for pos, to, entered in sorted(zip(links["pos"], links["next"], links["entered"], strict=True)):
        if entered or pos in out:
            out.add(pos)
            if not pd.isna(to):
                out.add(int(to))
    return pd.DataFrame({"_k": links["_k"].iloc[0], "pos": sorted(out & set(links["pos"]))})


def throttle(logins: DataFrame, limit: int = 6, block_seconds: int = 60) -> DataFrame:
    """Logins (ip, ts, seq, ok) with blocked: true inside the minute that follows an address's sixth failure in a row.

    Failures inside a block are not counted, and a success clears them; a null ok is a failure, a null ts comes first,
    neither blocks nor is blocked, and null addresses are one address. Attempts that could begin a block (six failures in
    a row end there) point to the one that would begin the next. Attempts are cut into ranges of address and time, so that
    one address spreads over tasks; each range is passed through in a task, and only the places where one is left for
    another are reached from an address's first one by doubling the pointers.
    """
    key = F.when(F.col("ip").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("ip").cast("string")))
    read = _in_parts(logins.select("ip", "ts", "seq", F.coalesce("ok", F.lit(False)).alias("ok"), key.alias("_k")), ["ts", "seq", "ok"], "logins")
    sizes = read.groupBy("_k", "_part").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    rows = read.join(sizes.select("_k", "_part", F.coalesce(ahead, F.lit(0)).alias("_ahead")), ["_k", "_part"]).withColumn("pos", F.col("_ahead") + F.col("_i")).drop("_ahead")
    rows = _running(rows, "cleared", F.when(F.col("ok"), F.col("pos")))
    full = F.col("pos") - F.coalesce("cleared", F.lit(0)) >= limit
    rows = scratch.keep(_running(rows.withColumn("full", full), "next_full", F.when(F.col("full"), F.col("pos")), F.min, back=True).drop("cleared"), "places")
    scratch.drop(read)

    until = (F.col("ts") + F.make_dt_interval(secs=F.lit(block_seconds))).alias("until")
    full_rows = rows.where("full").select("_k", "_part", "pos", "ts", until)
    # the first attempt at or after a block's end: ends and attempts in one order, ends before attempts of the same time
    ends = full_rows.where("until is not null").select("_k", F.col("until").alias("at"), F.lit(0).alias("kind"), "pos")
    tries = rows.where("ts is not null").select("_k", F.col("ts").alias("at"), F.lit(1).alias("kind"), "pos")
    merged = _in_parts(ends.unionByName(tries), ["at", "kind", "pos"], "ends")
    opens = _running(merged, "open", F.when(F.col("kind") == 1, F.col("pos")), F.min, back=True).where("kind = 0").select("_k", "pos", "open")
    # a block without an end time shuts nobody out: counting goes on at the next attempt
    starts = full_rows.join(opens, ["_k", "pos"], "left").withColumn("open", F.when(F.col("until").isNull(), F.col("pos") + 1).otherwise(F.col("open")))
    reach = rows.select("_k", F.col("pos").alias("_at"), F.col("next_full").alias("next"))
    whole = scratch.keep(starts.withColumn("_at", F.col("open") + (limit - 1)).join(reach, ["_k", "_at"], "left").select("_k", "_part", "pos", "next"), "whole")
    hops = scratch.keep(whole.groupBy("_k", "_part").applyInPandas(_exits, "_k string, pos long, exit long"), "hops")
    first = whole.groupBy("_k").agg(F.min("pos").alias("pos")).withColumn("begins", F.lit(True))
    entries = hops.where("exit is not null").select("_k", F.col("exit").alias("pos"), F.lit(False).alias("begins")).unionByName(first).groupBy("_k", "pos").agg(F.max("begins").alias("begins"))
    links = scratch.keep(entries.join(hops, ["_k", "pos"]).select("_k", "pos", F.col("exit").alias("next"), "begins"), "links")
    scratch.drop(hops)
    scratch.drop(merged)
    while links.where("begins and next is not null").limit(1).count():
        hit = links.where("begins and next is not null").select("_k", F.col("next").alias("pos"), F.lit(True).alias("_hit"))
        far = links.select("_k", F.col("pos").alias("next"), F.col("next").alias("_far"))
        twice = links.join(far, ["_k", "next"], "left").join(hit, ["_k", "pos"], "left")
        after = scratch.keep(twice.select("_k", "pos", F.col("_far").alias("next"), (F.col("begins") | F.col("_hit").isNotNull()).alias("begins")), "links")
        scratch.drop(links)
        links = after
    entered = whole.join(links.where("begins").select("_k", "pos", F.lit(True).alias("_in")), ["_k", "pos"], "left").withColumn("entered", F.col("_in").isNotNull()).drop("_in")
    blocks = scratch.keep(entered.groupBy("_k", "_part").applyInPandas(_walked, "_k string, pos long"), "blocks").withColumn("_begins", F.lit(True))
    timed = rows.join(blocks, ["_k", "pos"], "left")
    shut = _running(timed, "_until", F.when(F.col("_begins"), until), strict=True)
    return shut.select("ip", "ts", "seq", F.coalesce(F.col("ts") < F.col("_until"), F.lit(False)).alias("blocked"))
