"""Queries of spaced repetition and study sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators import session as S
from tallyforge.operators import srs
from tallyforge.sources.adapters import CARDS, REVIEWS, cards, reviews, table

NOW = "2024-02-01 00:00:00"


def e01(s, d):
    state = srs.fresh(F.lit(NOW))
    return table(s, d, "customer").select(F.col("c_custkey").alias("card_id"), state.alias("z")).select("card_id", "z.ease", "z.interval", "z.reps", "z.lapses", "z.due")


def e02(s, d):
    out = srs.fold(reviews(s, d), ["student_id", "card_id"])
    return out.select("student_id", "card_id", "n_reviews", F.round("srs.ease", 6).alias("ease"), "srs.interval", "srs.reps", "srs.lapses", F.col("srs.due").alias("due_at"))


FOLD = f"""WITH RECURSIVE {REVIEWS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY student_id, card_id ORDER BY ts, seq) AS k, count(*) OVER (PARTITION BY student_id, card_id) AS n FROM reviews
), f AS (
  SELECT student_id, card_id, CAST(0 AS BIGINT) AS k, CAST(2.5 AS DOUBLE) AS ease, CAST(0 AS DOUBLE) AS days, 0 AS reps, 0 AS lapses, CAST(NULL AS TIMESTAMP) AS due FROM r WHERE k = 1
  UNION ALL
  SELECT r.student_id, r.card_id, r.k,
    greatest(CAST(1.3 AS DOUBLE), f.ease + CASE WHEN r.grade < 3 THEN CAST(-0.2 AS DOUBLE) WHEN r.grade = 3 THEN CAST(-0.15 AS DOUBLE) WHEN r.grade >= 5 THEN CAST(0.15 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END),
    b.days, CASE WHEN r.grade < 3 THEN 0 ELSE f.reps + 1 END, CASE WHEN r.grade < 3 THEN f.lapses + 1 ELSE f.lapses END,
    CASE WHEN r.grade < 3 THEN r.ts + INTERVAL 60 SECOND ELSE r.ts + to_days(CAST(least(b.days, CAST(1000000 AS DOUBLE)) AS INTEGER)) END
  FROM f JOIN r ON r.student_id = f.student_id AND r.card_id = f.card_id AND r.k = f.k + 1,
  LATERAL (SELECT CASE WHEN f.reps = 0 THEN CAST(1 AS DOUBLE) WHEN f.reps = 1 THEN CAST(3 AS DOUBLE) ELSE floor(f.days * f.ease + CAST(0.5 AS DOUBLE)) END AS base) a,
  LATERAL (SELECT CASE WHEN r.grade < 3 THEN CAST(0 AS DOUBLE) WHEN r.grade = 3 THEN greatest(CAST(1 AS DOUBLE), floor(a.base * CAST(0.7 AS DOUBLE) + CAST(0.5 AS DOUBLE))) ELSE a.base END AS days) b
), srs AS (
  SELECT f.student_id, f.card_id, f.k AS n_reviews, round(f.ease, 6) AS ease, f.days AS "interval", f.reps, f.lapses, f.due AS due_at
  FROM f JOIN (SELECT student_id, card_id, max(k) AS k FROM r GROUP BY student_id, card_id) m ON m.student_id = f.student_id AND m.card_id = f.card_id AND m.k = f.k
)"""


def e03(s, d):
    state = srs.fold(reviews(s, d), ["student_id", "card_id"]).select("student_id", "card_id", "srs")
    every = reviews(s, d).select("student_id").distinct().crossJoin(F.broadcast(s.range(9).select(F.col("id").alias("card_id"))))
    return srs.deck_stats(every.join(state, ["student_id", "card_id"], "left"), F.lit(NOW).cast("timestamp_ntz"), "student_id")


def f01(s, d):
    return S.initial_order(cards(s, d), 3).select("deck_id", "card_id", "initial_pos")


def f01b(s, d):
    return S.initial_order(cards(s, d), shuffled=False).select("deck_id", "card_id", "initial_pos")


SHUFFLED = f"""WITH {CARDS}, o AS (
  SELECT *, row_number() OVER (PARTITION BY deck_id ORDER BY ((card_id * 7919 + 3 * 104729) * 31) % 1000003, card_id) AS initial_pos FROM cards
), p AS (
  SELECT o.*, k.generate_series AS attempt_no FROM o, generate_series(1, 4) k WHERE k.generate_series <= o.misses + 1
), shown AS (
  SELECT deck_id, card_id, attempt_no, (attempt_no - 1) % (n_alts + 1) AS version, row_number() OVER (PARTITION BY deck_id ORDER BY attempt_no, initial_pos) AS pos FROM p
)"""


def f02(s, d):
    return S.presentations(S.initial_order(cards(s, d), 3))


def _answers(s, d):
    seen = S.presentations(S.initial_order(cards(s, d), 3))
    last = F.max("attempt_no").over(Window.partitionBy("deck_id", "card_id"))
    ts = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("pos") * 20)
    return seen.select("deck_id", "card_id", ts.alias("ts"), (F.col("attempt_no") == last).alias("correct"))


def f04(s, d):
    return S.summary(_answers(s, d), ["deck_id"])


def _report(s, d):
    deck = cards(s, d)
    alts = F.transform(F.filter(F.sequence(F.lit(1), F.lit(2)), lambda i: i <= F.col("n_alts")), lambda i: F.struct(F.concat(F.lit("v"), i.cast("string"), F.lit(": "), F.col("question")).alias("question"), F.lit("").alias("answer")))
    rows = deck.select("deck_id", "card_id", "number", "question", F.when(F.col("flag") == "R", F.col("c").cast("string")).otherwise("").alias("answer"), alts.alias("alts"))
    return S.report(f02(s, d), rows)


def f05(s, d):
    return _report(s, d)


def h11(s, d):
    return S.report_lines(_report(s, d))


REPORT = (
    SHUFFLED
    + """, last AS (SELECT deck_id, card_id, max(attempt_no) AS n, max_by(version, attempt_no) AS version FROM shown GROUP BY deck_id, card_id),
rep AS (SELECT c.deck_id, c.card_id, c.number, l.version, CASE WHEN l.version = 0 THEN c.question ELSE 'v' || CAST(l.version AS VARCHAR) || ': ' || c.question END AS shown_question,
  CASE WHEN l.version = 0 AND c.flag = 'R' THEN CAST(c.c AS VARCHAR) ELSE '—' END AS shown_answer, CAST(l.n AS VARCHAR) || CASE WHEN l.n = 1 THEN ' try' ELSE ' tries' END AS tries
  FROM last l JOIN cards c ON c.deck_id = l.deck_id AND c.card_id = l.card_id)"""
)

QUERIES = {
    "e01_fresh_state": e01, "e02_srs_fold": e02, "e03_deck_stats": e03, "f01_shuffled_order": f01, "f01_number_order": f01b, "f02_f03_presentations": f02, "f04_session_summary": f04, "f05_report": f05, "h11_report_text": h11,
}

ORACLE_SQL = {
    "e01_fresh_state": f"SELECT c_custkey AS card_id, CAST(2.5 AS DOUBLE) AS ease, CAST(0 AS DOUBLE) AS \"interval\", 0 AS reps, 0 AS lapses, TIMESTAMP '{NOW}' AS due FROM customer",
    "e02_srs_fold": FOLD + " SELECT * FROM srs",
    "e03_deck_stats": FOLD
    + f""", e AS (SELECT student_id, range AS card_id FROM (SELECT DISTINCT student_id FROM reviews), range(0, 9))
      SELECT e.student_id, count(*) AS total, count(*) FILTER (WHERE s.due_at IS NULL OR s.due_at <= TIMESTAMP '{NOW}') AS due, count(*) FILTER (WHERE s."interval" >= 7) AS mastered,
        CAST(floor(count(*) FILTER (WHERE s."interval" >= 7) * 100.0 / count(*) + 0.5) AS BIGINT) AS percent
      FROM e LEFT JOIN srs s ON s.student_id = e.student_id AND s.card_id = e.card_id GROUP BY e.student_id""",
    "f01_shuffled_order": SHUFFLED + " SELECT deck_id, card_id, initial_pos FROM o",
    "f01_number_order": f"WITH {CARDS} SELECT deck_id, card_id, row_number() OVER (PARTITION BY deck_id ORDER BY number, card_id) AS initial_pos FROM cards",
    "f02_f03_presentations": SHUFFLED + " SELECT * FROM shown",
    "f04_session_summary": SHUFFLED
    + """ SELECT c.deck_id, count(*) AS total, CAST(sum(misses + 1) AS BIGINT) AS attempts, count(*) FILTER (WHERE misses > 0) AS retried, count(*) FILTER (WHERE misses > 0) = 0 AS perfect,
      CAST((sum(misses + 1) - 1) * 20 AS BIGINT) AS seconds FROM cards c GROUP BY c.deck_id""",
    "f05_report": REPORT + " SELECT * FROM rep",
    "h11_report_text": REPORT
    + """ SELECT deck_id, string_agg(CAST(number AS VARCHAR) || '. ' || shown_question || chr(10) || '   Answer: ' || shown_answer || ' (' || tries || ')', chr(10) ORDER BY number, card_id) AS text FROM rep GROUP BY deck_id""",
}
