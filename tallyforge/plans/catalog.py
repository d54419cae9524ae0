"""Queries over teachers, decks and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import catalog as C
from tallyforge.sources.adapters import CARDS, DECKS, RUNS, TEACHERS, cards, decks, runs, table, teachers


def g01(s, d):
    return C.teachers_with_counts(teachers(s, d), decks(s, d)).select("teacher_id", "name", "deck_count")


def g02(s, d):
    return C.with_owner(decks(s, d), teachers(s, d), "—").select("deck_id", "owner_name")


def _sums(s, d):
    return cards(s, d).select("deck_id", "n_alts")


def g03(s, d):
    return C.listing(decks(s, d), _sums(s, d), runs(s, d), F.lit(7)).select("deck_id", "card_count", "alt_versions", "students")


def g20(s, d):
    return C.listing(decks(s, d), _sums(s, d), runs(s, d)).select("deck_id", "card_count", "alt_versions", "students")


def g20_roles(s, d):
    """What an owner, each teacher and a disabled account may list."""
    deck, people = decks(s, d), teachers(s, d)
    each = people.join(C.visible_to_each(deck, people), "teacher_id", "left").groupBy("teacher_id", "disabled").agg(F.count("deck_id").alias("n_decks"))
    owner = C.visible(deck, "owner").agg(F.count("*").alias("n_decks")).select(F.lit(-1).cast("long").alias("teacher_id"), F.lit(False).alias("disabled"), "n_decks")
    closed = C.visible(deck, "teacher", 7, disabled=True).agg(F.count("*").alias("n_decks")).select(F.lit(-2).cast("long").alias("teacher_id"), F.lit(True).alias("disabled"), "n_decks")
    return each.unionByName(owner).unionByName(closed)


LISTING = f"""WITH {CARDS}, {DECKS}, {RUNS},
n AS (SELECT deck_id, count(*) AS card_count, max(n_alts) AS alt_versions FROM cards GROUP BY deck_id),
r AS (SELECT deck_id, count(DISTINCT student_id) AS students FROM runs GROUP BY deck_id)
SELECT d.deck_id, coalesce(card_count, 0) AS card_count, coalesce(alt_versions, 0) AS alt_versions, coalesce(students, 0) AS students
FROM decks d LEFT JOIN n ON n.deck_id = d.deck_id LEFT JOIN r ON r.deck_id = d.deck_id"""


def g04(s, d):
    return C.students_per_deck(runs(s, d))


def g05(s, d):
    return C.deck_by_id(decks(s, d), 32).select("deck_id", "name", "published")


def g06(s, d):
    return C.published(decks(s, d), teachers(s, d)).select("deck_id", "name", "owner_name", "needs_code")


def g07(s, d):
    return C.for_student(decks(s, d), "C3").select("deck_id", "class_code")


def g08(s, d):
    return C.latest_runs(runs(s, d)).select("student_id", "deck_id", "run_id", "finished_at", "seconds")


def g09(s, d):
    return C.run_totals(runs(s, d))


def g10(s, d):
    old = cards(s, d)
    rows = old.where("part % 5 <> 0").select(
        "deck_id", "card_id", F.when(F.col("part") % 4 == 0, F.col("number") + 100).alias("number"), F.col("a").alias("pos"), F.when(F.col("part") % 7 == 0, " ").otherwise(F.col("question")).alias("question"),
        F.when(F.col("part") % 2 == 0, F.col("n_alts") + 5).alias("n_alts"),
    )
    return C.save_deck(rows, old.where("part % 3 <> 0"))


def g11(s, d):
    ids = table(s, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("deck_id"))
    return C.set_published(decks(s, d), ids, True).select("deck_id", "published")


def g12(s, d):
    deck = cards(s, d).withColumns({"alts": F.array().cast("array<struct<question:string,answer:string>>")})
    other = cards(s, d).where("flag = 'R'").select("deck_id", (F.col("a")).alias("number"), F.concat(F.lit("alt "), F.col("question")).alias("question"), F.lit("").alias("answer"), F.col("number").alias("seq"))
    done = C.attach_alternates(deck, other)
    return done.select("deck_id", "card_id", "paired", F.size("alts").cast("long").alias("n_alts"), F.get(F.col("alts"), F.lit(0))["question"].alias("alt_question"))


def g13(s, d):
    gone = decks(s, d).where("deck_id % 5 = 0").select("deck_id")
    left = C.without(decks(s, d), gone, "deck_id").select("deck_id", F.lit("deck").alias("what"))
    return left.unionByName(C.without(runs(s, d), gone, "deck_id").select("deck_id", F.lit("run").alias("what"))).groupBy("what").agg(F.count("*").alias("n"), F.sum("deck_id").alias("sum_id"))


def g14(s, d):
    kept, after = C.delete_teacher(teachers(s, d), decks(s, d), teachers(s, d).where("disabled"))
    return after.groupBy("published").agg(F.count("*").alias("n"), F.sum("deck_id").alias("sum_id")).crossJoin(kept.agg(F.count("*").alias("teachers")))


def g15(s, d):
    names = table(s, d, "customer").select(F.upper("c_name").alias("username"), "c_custkey")
    return C.taken(names, teachers(s, d)).select("username", "c_custkey")


def g16(s, d):
    return C.next_numbers(cards(s, d))


def g17(s, d):
    return C.answered(cards(s, d).withColumn("answer", F.when(F.col("flag") == "R", "x").when(F.col("flag") == "A", "  ")))


def g19(s, d):
    logins = table(s, d, "events").select((F.col("user_id") % 5).alias("ip"), "ts", F.col("event_id").alias("seq"), F.col("event_type").isin("purchase").alias("ok"))
    return C.throttle(logins, 4, 3600)


QUERIES = {
    "g01_teachers_with_counts": g01, "g02_deck_owners": g02, "g03_owner_listing": g03, "g04_students_per_deck": g04, "g05_deck_by_id": g05, "g06_published": g06, "g07_deck_for_student": g07, "g08_latest_run": g08,
    "g09_run_totals": g09, "g10_save_deck": g10, "g11_publish": g11, "g12_attach_alternates": g12, "g13_delete_deck": g13, "g14_delete_teacher": g14, "g15_username_taken": g15, "g16_next_number": g16, "g17_with_answers": g17,
    "g19_login_throttle": g19, "g20_all_listing": g20, "g20_role_gating": g20_roles,
}

ORACLE_SQL = {
    "g01_teachers_with_counts": f"""WITH {DECKS}, {TEACHERS} SELECT t.teacher_id, t.name, count(d.deck_id) AS deck_count FROM teachers t LEFT JOIN decks d ON d.owner_id = t.teacher_id GROUP BY t.teacher_id, t.name""",
    "g02_deck_owners": f"""WITH {DECKS}, {TEACHERS} SELECT d.deck_id, coalesce(t.name, '—') AS owner_name FROM decks d LEFT JOIN teachers t ON d.owner_id = t.teacher_id""",
    "g03_owner_listing": LISTING + " WHERE d.owner_id = 7",
    "g04_students_per_deck": f"WITH {RUNS} SELECT deck_id, count(DISTINCT student_id) AS students FROM runs GROUP BY deck_id",
    "g05_deck_by_id": f"WITH {DECKS} SELECT deck_id, name, published FROM decks WHERE deck_id = 32",
    "g06_published": f"""WITH {DECKS}, {TEACHERS} SELECT d.deck_id, d.name, coalesce(t.name, 'Teacher') AS owner_name, d.class_code <> '' AS needs_code
      FROM decks d LEFT JOIN teachers t ON d.owner_id = t.teacher_id WHERE d.published""",
    "g07_deck_for_student": f"WITH {DECKS} SELECT deck_id, class_code FROM decks WHERE published AND (class_code = '' OR class_code = 'C3')",
    "g08_latest_run": f"""WITH {RUNS} SELECT student_id, deck_id, run_id, finished_at, seconds FROM
      (SELECT *, row_number() OVER (PARTITION BY student_id, deck_id ORDER BY finished_at DESC, run_id DESC) AS k FROM runs) WHERE k = 1""",
    "g09_run_totals": f"""WITH {RUNS} SELECT student_id, deck_id, n AS runs, finished_at, seconds FROM
      (SELECT *, count(*) OVER (PARTITION BY student_id, deck_id) AS n, row_number() OVER (PARTITION BY student_id, deck_id ORDER BY finished_at DESC, run_id DESC) AS k FROM runs) WHERE k = 1""",
    "g10_save_deck": f"""WITH {CARDS} SELECT n.deck_id, n.card_id, coalesce(CASE WHEN n.part % 4 = 0 THEN n.number + 100 END, o.number, n.a) AS number, n.question,
      coalesce(CASE WHEN n.part % 2 = 0 THEN n.n_alts + 5 END, o.n_alts, 0) AS n_alts
      FROM cards n LEFT JOIN (SELECT * FROM cards WHERE part % 3 <> 0) o ON o.card_id = n.card_id AND o.deck_id = n.deck_id WHERE n.part % 5 <> 0 AND n.part % 7 <> 0""",
    "g11_publish": f"WITH {DECKS} SELECT deck_id, published OR deck_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AS published FROM decks",
    "g12_attach_alternates": f"""WITH {CARDS}, alt AS (SELECT deck_id, a AS number, max_by('alt ' || question, number) AS q FROM cards WHERE flag = 'R' GROUP BY deck_id, a)
      SELECT c.deck_id, c.card_id, alt.q IS NOT NULL AS paired, CAST(CASE WHEN alt.q IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_alts, alt.q AS alt_question
      FROM cards c LEFT JOIN alt ON alt.deck_id = c.deck_id AND alt.number = c.number""",
    "g13_delete_deck": f"""WITH {DECKS}, {RUNS}, gone AS (SELECT deck_id FROM decks WHERE deck_id % 5 = 0), x AS (
      SELECT 'deck' AS what, deck_id FROM decks WHERE deck_id % 5 <> 0 UNION ALL SELECT 'run', deck_id FROM runs WHERE deck_id NOT IN (SELECT deck_id FROM gone))
      SELECT what, count(*) AS n, CAST(sum(deck_id) AS BIGINT) AS sum_id FROM x GROUP BY what""",
    "g14_delete_teacher": f"""WITH {DECKS}, {TEACHERS}, x AS (SELECT deck_id, published AND owner_id NOT IN (SELECT teacher_id FROM teachers WHERE disabled) AS published FROM decks)
      SELECT published, count(*) AS n, CAST(sum(deck_id) AS BIGINT) AS sum_id, (SELECT count(*) FROM teachers WHERE NOT disabled) AS teachers FROM x GROUP BY published""",
    "g15_username_taken": f"WITH {TEACHERS} SELECT upper(c_name) AS username, c_custkey FROM customer WHERE lower(c_name) IN (SELECT lower(username) FROM teachers)",
    "g16_next_number": f"WITH {CARDS} SELECT deck_id, max(number) + 1 AS next_number FROM cards GROUP BY deck_id",
    "g17_with_answers": f"WITH {CARDS} SELECT deck_id, count(*) FILTER (WHERE flag = 'R') AS with_answers FROM cards GROUP BY deck_id",
    "g19_login_throttle": """WITH RECURSIVE e AS (SELECT user_id % 5 AS ip, ts, event_id AS seq, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id, event_type = 'purchase') AS pos FROM events),
      f AS (SELECT ip, pos, ts, seq, false AS blocked, CASE WHEN ok THEN 0 ELSE 1 END AS n, CAST(NULL AS TIMESTAMP) AS until FROM e WHERE pos = 1
        UNION ALL SELECT x.ip, x.pos, x.ts, x.seq, x.shut, CASE WHEN x.shut THEN x.n WHEN x.ok OR x.n >= 3 THEN 0 ELSE x.n + 1 END, CASE WHEN NOT x.shut AND NOT x.ok AND x.n >= 3 THEN x.ts + INTERVAL 1 HOUR ELSE x.until END
        FROM (SELECT e.*, f.n, f.until, coalesce(e.ts < f.until, false) AS shut FROM f JOIN e ON e.ip = f.ip AND e.pos = f.pos + 1) x)
      SELECT ip, ts, seq, blocked FROM f""",
    "g20_all_listing": LISTING,
    "g20_role_gating": f"""WITH {DECKS}, {TEACHERS} SELECT t.teacher_id, t.disabled, CASE WHEN t.disabled THEN 0 ELSE count(d.deck_id) END AS n_decks FROM teachers t LEFT JOIN decks d ON d.owner_id = t.teacher_id GROUP BY t.teacher_id, t.disabled
      UNION ALL SELECT -1, false, count(*) FROM decks UNION ALL SELECT -2, true, 0""",
}
