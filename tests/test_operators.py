import math
import random
from collections import deque
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions.classify import classify
from tallyforge.operators import catalog, extract, layout, session, srs


def test_srs_fold_matches_plain_steps(spark):
    rng = random.Random(1)
    t0 = datetime(2024, 1, 1)
    rows = [(c, s, t0 + timedelta(hours=s), rng.choice([0, 3, 4, 5])) for c in range(40) for s in range(rng.randint(1, 12))]
    df = spark.createDataFrame([(c, s, t, g) for c, s, t, g in rows], "card_id long, seq long, ts timestamp_ntz, grade int")
    want = {}
    for c, s, t, g in sorted(rows):
        ease, days, reps, lapses, _ = want.get(c, (2.5, 0.0, 0, 0, None))
        if g < 3:
            ease, days, reps, lapses, due = max(1.3, ease - 0.2), 0.0, 0, lapses + 1, t + timedelta(seconds=60)
        else:
            days = 1.0 if reps == 0 else 3.0 if reps == 1 else float(math.floor(days * ease + 0.5))
            ease = max(1.3, ease + {3: -0.15, 4: 0.0, 5: 0.15}[g])
            days = max(1.0, float(math.floor(days * 0.7 + 0.5))) if g == 3 else days
            reps, due = reps + 1, t + timedelta(days=days)
        want[c] = (ease, days, reps, lapses, due)
    got = {r.card_id: (r.srs.ease, r.srs.interval, r.srs.reps, r.srs.lapses, r.srs.due) for r in srs.fold(df, ["card_id"]).collect()}
    assert got == want


def test_presentations_match_a_queue(spark):
    rng = random.Random(2)
    rows = [(d, c, rng.randint(0, 4), rng.randint(0, 3), c + 1) for d in range(15) for c in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "deck_id long, card_id long, misses long, n_alts long, initial_pos long")
    want = []
    for d in range(15):
        queue = deque([(c, m, a, 1) for dd, c, m, a, _ in rows if dd == d])
        pos = 0
        while queue:
            c, m, a, n = queue.popleft()
            pos += 1
            want.append((d, c, n, (n - 1) % (a + 1), pos))
            if n <= m:
                queue.append((c, m, a, n + 1))
    assert sorted(tuple(r) for r in session.presentations(df).collect()) == sorted(want)


def test_throttle_matches_plain_form(spark):
    rng = random.Random(3)
    t0, rows = datetime(2024, 1, 1), []
    for ip, n_rows in ((0, 60), (1, 60), (2, 60), (3, 400), (None, 40), (5, 1), (6, 30)):  # one address has most of the rows
        t = t0
        for s in range(n_rows):
            t += timedelta(seconds=rng.choice([0, 1, 5, 30]))
            at = None if ip == 6 and s < 8 else t
            rows.append((ip, at, s, rng.choice([True, None, False, False, False, False, False, False, False, False])))
    want = []
    for ip in {r[0] for r in rows}:
        n, until = 0, None
        for _, t, s, ok in [r for r in rows if r[0] == ip]:
            blocked = until is not None and t is not None and t < until
            if not blocked:
                n = 0 if ok else n + 1
                if n >= 6:
                    n, until = 0, None if t is None else t + timedelta(seconds=60)
            want.append((str(ip), s, blocked))
    df = spark.createDataFrame(rows, "ip long, ts timestamp_ntz, seq long, ok boolean")
    for coalesce in ("true", "false"):  # one part, or addresses cut into several
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        got = sorted((str(r.ip), r.seq, r.blocked) for r in catalog.throttle(df.repartition(5)).collect())
        assert got == sorted(want) and any(r[2] for r in got)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert catalog.throttle(df.limit(0)).count() == 0


def test_mark_scan_swallows_an_empty_problem(spark):
    df = spark.createDataFrame([(1, "1)\n2) y = 3\n3) z = 1"), (2, "no marks\n\nbut two paragraphs"), (3, None), (4, "")], "doc_id long, text string")
    got = [(r.doc_id, r.number, r.body) for r in extract.split_pages(df, ["doc_id"]).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 1, "2) y = 3"), (1, 3, "z = 1"), (2, 1, "no marks"), (2, 2, "but two paragraphs")]


def test_problems_take_key_then_inline_answers(spark):
    text = "1) x + 1 = 3 {2}\n2) x + 2 = 5 {x = 3}\n3) find all {see key}\nAnswer Key\n2) three  3) none"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = [(r.number, r.question, r.answer, r.answer_source) for r in extract.problems(df, ["doc_id"]).orderBy("number").collect()]
    assert got == [(1, "x + 1 = 3", "2", "inline"), (2, "x + 2 = 5", "three", "key"), (3, "find all", "none", "key")]


def test_blocks_answers_and_keys(spark):
    blocks = {
        "solve this one please\nk\nx^2": "solve this one please", "solve this one please\n7\nx^2": "solve this one please\n7\nx^2", "short\nk\nx^2": "short\nk\nx^2", "x = 3\nUnit Two: Equations (A)": "x = 3",
        "x = 3\nUnit 2 # 1 + 1 + 1": "x = 3\nUnit 2 # 1 + 1 + 1", "x = 3\nscore 5 of 6": "x = 3", "\r\n a \n\n b": "a\nb", "Chapter Seven Review": "Chapter Seven Review",
    }
    ends = {"x {  3 ,  5 }": ("3 , 5", "x"), "x {see}": ("", "x"), "x ALL real\n numbers.": ("all real numbers", "x"), "x = { 5": (None, "x = { 5"), "real numbers": (None, "real numbers"), "x no solutions": ("no solution", "x"), "x {1} y": (None, "x {1} y"), "": (None, "")}
    df = spark.createDataFrame([(k, None) for k in blocks] + [(None, k) for k in ends], "b string, e string")
    for r in df.select("b", "e", T.clean_block(F.col("b")).alias("x"), T.inline_answer(F.col("e")).alias("y"), T.without_inline_answer(F.col("e")).alias("z")).collect():
        assert r.x == blocks[r.b] if r.b is not None else (r.y, r.z) == ends[r.e]
    keys = {
        "1) a\nAnswer Key: 1) 5 2) 6\n3) y": {1: "5", 2: "6", 3: "y"}, "1) a\nAnswer key\n1) 5   2) 6   101) z": {1: "5", 2: "6   101) z".replace("   ", " ")}, "q\nSolutions\n4) no  way": {4: "no way"}, "q\nanswers1) 5": {},
        "the answers are here": {}, "x\nAnswers.\n1) 2\n1) 3": {1: "3"}, "Answer Key\n1) " + "w" * 41 + " 2) v": {1: "w" * 41 + " 2) v", 2: "v"},
    }
    df = spark.createDataFrame([(k,) for k in keys], "text string")
    got = {}
    for r in extract.answer_key(df, ["text"]).collect():
        got.setdefault(r.text, {})[r.number] = r.value
    assert got == {k: v for k, v in keys.items() if v}


def test_key_lines_take_numbers_of_two_digits_on_every_line(spark):
    """The first line after a heading too, and never three digits, however far down a line stands."""
    df = spark.createDataFrame([(1, "12) a b", ""), (2, "\n12) K5\n3) K6\n4. \n5) five\n123) no\n07) x", "")], "id long, key_text string, text string")
    got = sorted(tuple(r) for r in extract.key_lines(df, ["id"]).collect())
    assert got == [(1, "12", "a b", 1), (2, "07", "x", 4), (2, "12", "K5", 4), (2, "3", "K6", 4), (2, "5", "five", 4)]


def test_problems_find_two_digit_numbers_in_their_key(spark):
    df = spark.createDataFrame([(1, "9) 2x = 4\n10) 3x = 6\n11) 4x = 8\nAnswer Key\n10) a\n11) b"), (2, "1) 2x = 4\n12) 3x = 6\nAnswer Key\n12) c\n123) d")], "id long, text string")
    got = sorted((r.id, r.number, r.answer, r.answer_source) for r in extract.problems(df, ["id"]).collect())
    assert got == [(1, 9, "", ""), (1, 10, "a", "key"), (1, 11, "b", "key"), (2, 1, "", ""), (2, 12, "c", "key")]
    key = extract.key_lines(extract.split_key(df), ["id"]).where("id = 1").orderBy("number")
    assert [(r.number, r.value, r.n_numbers) for r in key.collect()] == [("10", "a", 2), ("11", "b", 2)]


def test_a_key_page_may_have_many_lines(spark):
    df = spark.createDataFrame([(1, 2, 0, 5, "q\n" + "\n".join(map(str, range(3000))))], "doc_id long, page_index int, pos int, number int, body string")
    assert extract.key_page_answers(df).head().value == " ".join(map(str, range(3000)))

def glyph(seq, x, y, s, w=10.0, scale=12.0, doc=1):
    return (doc, 1, seq, float(x), float(y), float(w), float(scale), s)


def test_page_assembly(spark):
    g = [glyph(1, 10, 700, "1)"), glyph(2, 30, 700, "x"), glyph(3, 41, 706, "2", 5, 7), glyph(4, 50, 700, "= 9", 20), glyph(5, 10, 650, "2)"), glyph(6, 30, 650, "abc", 30), glyph(7, 38, 640, "4", 8),
         glyph(8, 10, 600, "{1,"), glyph(9, 24, 600, "2}"), glyph(10, 10, 560, "- 3 -"), glyph(11, 10, 550, "  "), glyph(12, 10, 500, "3) x"), glyph(13, 30, 500, "+ 1 = 2", 40)]
    df = spark.createDataFrame(g, "doc_id long, page_index int, glyph_seq long, x double, y double, w double, scale double, s string")
    lines = [r.text for r in layout.assemble(df).orderBy("line_no").collect()]
    assert lines == ["1) x^2 = 9", "2)", "(abc)/(4)", "{1,2}", "3) x + 1 = 2"] or lines == ["1) x^2 = 9", "2) (abc)/(4)", "{1,2}", "3) x + 1 = 2"]
    texts = layout.page_texts(layout.assemble(df)).collect()
    assert len(texts) == 1 and texts[0].text.startswith("1) x^2 = 9\n")
    assert layout.assemble(df.limit(0)).count() == 0


def test_text_functions(spark):
    row = spark.range(1).select(
        T.clean_equation(F.lit("3) Solve: 2X − 3 = 7 Show your work.")).alias("a"), T.fraction_text(F.lit(-6), F.lit(-4)).alias("b"), T.fraction_text(F.lit(1), F.lit(0)).alias("c"), T.gcd(F.lit(0), F.lit(5)).alias("d"),
        T.scanned(F.lit("  ")).alias("e"), T.top_slash(F.lit("(a/b)/c")).alias("f"), T.inline_answer(F.lit("x {maybe}")).alias("g"), T.clean_block(F.lit(None).cast("string")).alias("h"),
    ).head()
    assert (row.a, row.b, row.c, row.d, row.e, tuple(row.f), row.g, row.h) == ("2x - 3 = 7", "3/2", None, 5, True, ("(a/b)", "c"), "", "")


def test_visible_decks_by_role(spark):
    decks = spark.createDataFrame([(1, 7), (2, 8), (3, None), (4, 7)], "deck_id long, owner_id long")
    ids = lambda df: sorted(r.deck_id for r in df.collect())
    assert ids(catalog.visible(decks, "owner")) == [1, 2, 3, 4] and ids(catalog.visible(decks, "teacher", 7)) == [1, 4] and ids(catalog.visible(decks, "teacher", None)) == []
    assert ids(catalog.visible(decks, "owner", 7, disabled=True)) == ids(catalog.visible(decks, None, 7)) == ids(catalog.visible(decks, "student", 7)) == []
    people = spark.createDataFrame([(7, False), (8, True), (9, None)], "teacher_id long, disabled boolean")
    assert sorted(tuple(r) for r in catalog.visible_to_each(decks, people).collect()) == [(7, 1), (7, 4)]


def test_column_cuts_match_points(spark):
    """A03 against counting the inked rows of every point."""
    import math
    import random

    rng = random.Random(5)
    rows = []
    for page in range(12):
        lanes = rng.sample([40, 200, 360, 520], rng.randrange(1, 4))
        for k in range(rng.choice([3, 9, 40, 80])):
            rows.append((1, page, k, rng.choice(lanes) + rng.random() * 30, float(700 - 12 * (k % 25)), rng.random() * rng.choice([5, 60, 140]), 12.0, "x"))
    df = spark.createDataFrame(rows, "doc_id long, page_index int, glyph_seq int, x double, y double, w double, scale double, s string")
    want = []
    for page in range(12):
        mine = [r for r in rows if r[1] == page]
        low, high = min(r[4] for r in mine), max(r[4] for r in mine)
        mine = [r for r in mine if r[4] <= high - (high - low) * 0.12]
        if len(mine) < 8:
            continue
        a, z = math.floor(min(r[3] for r in mine)), math.ceil(max(r[3] + r[5] for r in mine))
        lines = {r[4] for r in mine}
        if z - a < 100:
            continue
        inked = {px: len({r[4] for r in mine if math.floor(r[3]) <= px <= math.ceil(r[3] + r[5])}) for px in range(a, z + 1)}
        px = a
        while px <= z:
            end = px
            while end <= z and inked[end] < len(lines) * 0.06:
                end += 1
            n, span = end - px, z - a
            if n >= 8 and n >= span * 0.035 and px - a > span * 0.12 and z - (end - 1) > span * 0.08:
                want.append((page, (px + end - 1) / 2))
            px = max(end, px + 1)
    got = sorted((r.page_index, r.cut) for r in layout.column_cuts(df).collect())
    assert got == sorted(want) and got


def test_rows_by_first_fit_not_by_chains(spark):
    ys = [100.0, 98.4, 96.6, 94.0, 50.2, None]
    df = spark.createDataFrame([(1, 1, i, 0.0, y, 5.0, 10.0, "a") for i, y in enumerate(ys)], "doc_id long, page_index int, glyph_seq long, x double, y double, w double, scale double, s string")
    got = [r.row_no for r in layout.with_rows(df).orderBy("glyph_seq").collect()]
    assert got == [1, 1, 1, 2, 3, None]
    assert layout.with_rows(df.limit(0)).count() == 0


def atom(s, x, y, w=5.0, scale=10.0):
    return {"s": s, "x": x, "y": y, "w": w, "scale": scale}


def test_proportions_take_their_label():
    quarters = [atom("x", 30, 107), atom("4", 30, 93), atom("5", 50, 107), atom("2", 50, 93)]
    got = layout._proportions([atom("7)", 5, 101), *quarters, atom("=", 40, 100)], 10.0)
    assert [g["s"] for g in got] == ["7) (x)/(4) = (5)/(2)"]
    got = layout._proportions([*quarters, atom("=", 40, 100), atom("8)", 70, 100)], 10.0)
    assert sorted(g["s"] for g in got) == ["(x)/(4) = (5)/(2)", "8)"]
    three = [*quarters[:3], atom("=", 40, 100)]
    assert layout._proportions(three, 10.0) == three


def test_empty_numbers_take_the_neighbours_that_fit():
    def lines(*texts):
        return layout._lines([atom(t, 0, 500 - 12 * i) for i, t in enumerate(texts)])

    assert lines("x+1", "3)", "2y") == ["3) (x+1)/(2y)"]
    assert lines("Solve for the unknown below", "3)", "2y") == ["Solve for the unknown below", "3) 2y"]
    assert lines("2y", "3)", "Solve for the unknown below") == ["3) 2y", "Solve for the unknown below"]
    assert lines("3)", "4)", "5y") == ["3)", "4) 5y"]
    assert lines("3)") == ["3)"] and lines() == []


def test_denominators_may_stand_in_brackets(spark):
    rows = [(1, 0, "3x = 9", 10.0, 60.0), (1, 1, "(x + 2)", 12.0, 50.0), (2, 0, "3x", 10.0, 60.0), (2, 1, "(see the next page below)", 12.0, 50.0)]
    df = spark.createDataFrame([(d, 1, 0, n, t, a, z) for d, n, t, a, z in rows], "doc_id long, page_index int, col int, line_no long, text string, x0 double, x1 double")
    got = [(r.doc_id, r.text) for r in layout.merge_stacked(df).orderBy("doc_id", "line_no").collect()]
    assert got == [(1, "(3x)/(x + 2) = 9"), (2, "3x"), (2, "(see the next page below)")]


def test_sources_of_many_lines_are_written_in_files_that_are_read(spark, sf_dir, monkeypatch):
    """A bucket with more bytes than a source may have is read whole."""
    from tallyforge.plans import worksheets
    from tallyforge.sources import files

    read = files.read_sources
    monkeypatch.setattr(files, "read_sources", lambda s, path, patterns, max_bytes=6_000: read(s, path, patterns, max_bytes))
    monkeypatch.setattr(worksheets, "SOURCE_LINES", 200, raising=False)
    got = worksheets.h01(spark, sf_dir).agg(F.sum("bytes"), F.sum("content_bytes")).first()
    want = worksheets.cards(spark, sf_dir).agg(F.sum(F.length("question") + 1)).first()[0]
    assert tuple(got) == (want, want)


def test_throttle_over_many_parts(spark):
    """Every address in several ranges, and no frame that Spark would compute anew for each row."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        test_throttle_matches_plain_form(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = spark.range(9).select(F.lit("k").alias("_k"), (F.col("id") % 3).alias("_part"), F.col("id").alias("_i"))
    got = catalog._running(rows, "ahead", F.col("_i"), F.min, back=True, strict=True)
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    assert {r._i: r.ahead for r in got.collect()} == {0: 1, 3: 1, 6: 1, 1: 2, 4: 2, 7: 2, 2: 5, 5: 8, 8: None}
    links = pd.DataFrame({"_k": "k", "pos": [1, 3, 5, 8], "next": [5, 8, 11, None]})
    assert [None if pd.isna(x) else x for x in catalog._exits(links).sort_values("pos")["exit"]] == [11, None, 11, None]
    assert list(catalog._walked(links.assign(entered=[True, False, False, False]))["pos"]) == [1, 5]


def test_a_type_reads_its_text_once(spark):
    """The words of a text are made once, however many terms are looked for in them."""
    typed = spark.createDataFrame([("Give y2 - 4 = 0",), ("a² = 9",), ("Find the ROOT of x2+5",), (None,)], "q string").select(classify(F.col("q")).alias("t"))
    assert typed._jdf.queryExecution().analyzed().toString().count("[^a-z0-9]+") == 1
    assert [r.t for r in typed.collect()] == ["quadratic", "quadratic", "quadratic", "general"]
