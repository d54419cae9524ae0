"""Queries from worksheet texts to problem records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions.classify import HINTS, LABELS, classify, hint_at, hints, label
from tallyforge.operators import extract as X
from tallyforge.sources import files, pdf, scratch
from tallyforge.sources.adapters import CARDS, SHEETS, TASK_ROWS, cards, sheets, table, worksheets


def b01(s, d):
    return cards(s, d).select("card_id", T.plain_space(F.when(F.col("part") % 2 == 0, F.translate("question", " ", " "))).alias("text"))


def b02(s, d):
    cut = X.split_key(worksheets(s, d))
    return cut.select("deck_id", F.length("body").cast("long").alias("body_chars"), F.length("key_text").cast("long").alias("key_chars"))


def b03(s, d):
    return X.key_lines(X.split_key(worksheets(s, d)), ["deck_id"]).where("n_numbers >= 2").select("deck_id", F.col("number").cast("long").alias("number"), "value")


def b04(s, d):
    """Keys of four forms: all answers on a line, one answer, two lines, and numbers written with a zero first."""
    card = cards(s, d).select("card_id", F.col("part") % 4, "a", "b", "c").toDF("card_id", "form", "a", "b", "c")
    n, v = F.concat(F.col("a").cast("string"), F.lit(") ")), F.concat(F.lit("K"), F.col("c").cast("string"))
    one = F.when(F.col("form") == 0, F.concat(F.lit("Answers: "), n, v, F.lit("  81) K0 and more   82. 5"))).when(F.col("form") == 1, F.concat(F.lit("Solution\n"), n, v))
    text = one.when(F.col("form") == 2, F.concat(F.lit("ANSWER  KEY\n"), n, v, F.lit("\n 81 . two  words 82) 7\n82) 1/2"))).otherwise(F.concat(F.lit("answers \n07) x\n"), n, v, F.lit("\n08) y")))
    key = X.answer_key(card.select("card_id", F.concat(F.lit("1) body\n"), text).alias("text")), ["card_id"])
    return key.select("card_id", F.col("number").cast("long").alias("number"), "value")


def b05(s, d):
    body = X.split_key(worksheets(s, d)).select("deck_id", F.col("body").alias("text"))
    return X.split_pages(body, ["deck_id"]).select("deck_id", F.col("number").cast("long").alias("number"), "body", "marked")


def b07(s, d):
    """Blocks that end in a title, a form line, crumbs, numbers that are no crumbs, a lone crumb, or a title that is none."""
    ends = ["Chapter Seven Review", "Name: ____", "7\n8", "m^-1\n p ^ (3)", "and more\nx", "So y = 2x + 1 here", "q\nDate 5\nScore"]
    end = F.get(F.array(*[F.lit(x) for x in ends]), (F.col("part") % len(ends)).cast("int"))
    return cards(s, d).select("card_id", T.clean_block(F.concat(F.lit("Work out  "), F.col("question"), F.lit("\n\n  and check it by hand\n"), end)).alias("block"))


#: Ends of problems with the answer in them, and whether the end leaves the question.
ENDINGS = [
    (" { 36 }", "36", True), (" No solution.", "no solution", True), (" {see text}", "", True), ("", None, False), (" no   solutions", "no solution", True), (" {  X  =  − 5 }", "X =-5", True), (" Infinitely many solutions ", "infinitely many solutions", True),
    (" {none} of them", None, False), (" {}", "", True), (" { and so on, word by word, until there are too many of them }", None, False), (" ALL real numbers", "all real numbers", True),
]


def b08(s, d):
    end = F.get(F.array(*[F.lit(x) for x, _, _ in ENDINGS]), (F.col("part") % len(ENDINGS)).cast("int"))
    text = F.concat("question", end)
    return cards(s, d).select("card_id", T.inline_answer(text).alias("answer"), T.without_inline_answer(text).alias("question"))


def b09(s, d):
    return X.problems(worksheets(s, d), ["deck_id"]).select("deck_id", F.col("number").cast("long").alias("number"), "question", "answer", "answer_source")


#: Prompts and the types they have.
PROMPTS = [
    ("Solve the system by substitution", "system"), ("Factor x^2 - 9", "factor"), ("x^2 * x^3", "exponents"), ("Simplify 3x + 2x", "simplify"), ("Find the slope through both points", "slope"),
    ("Find the midpoint", "midpoint"), ("What is the distance between A and B?", "distance"), ("The area of a right triangle", "pythagorean"), ("The perimeter of a square", "area"), ("The volume of a box", "volume"),
    ("The angles are complementary", "angles"), ("Are the figures similar?", "congruence"), ("Find the value of 3a", "evaluate"), ("x^2 + 3x = 4", "quadratic"), ("3x + 1 = 7", "linear"), ("How many apples are left?", "general"),
    ("Two equations", "system"), ("The square has a root", "general"), ("Give the power of a power", "exponents"), ("Use positive exponents: x^2 = y", "exponents"), ("y-intercept and y = mx + b", "slope"),
    ("The length of segment AB", "distance"), ("The surface area of a cube", "area"), ("Does SSS hold?", "congruence"), ("When x = 3, what is y?", "evaluate"), ("The roots of x2 + 5", "quadratic"), ("x*2 = zero", "linear"),
    ("3 = 4", "general"), ("an arealike shape", "general"), ("x^2 - 1 = 0", "quadratic"), ("Distribute 2(x + 1) = 4", "simplify"), ("Solve for the unknown number", "linear"), ("4y² = 16", "quadratic"), ("A similarity of sorts", "general"),
]


def _prompts(s, d):
    texts = F.array(*[F.lit(p) for p, _ in PROMPTS])
    return cards(s, d).select("card_id", "misses", F.get(texts, (F.col("part") % len(PROMPTS)).cast("int")).alias("question"))


def b10(s, d):
    return _prompts(s, d).select("card_id", classify(F.col("question")).alias("type_label")).withColumn("label", label(F.col("type_label")))


def b11(s, d):
    rows = _prompts(s, d).withColumn("type_label", classify(F.col("question"))).join(F.broadcast(hints(s)), "type_label")
    level = (F.col("misses") + 1).cast("int")
    return rows.select("card_id", F.size("hints").cast("long").alias("n_hints"), hint_at(F.col("hints"), level).alias("hint"))


def f08(s, d):
    """a card's own hint at level 1, then those of its type."""
    rows = _prompts(s, d).withColumn("type_label", classify(F.col("question"))).join(F.broadcast(hints(s)), "type_label")
    own = F.when(F.col("card_id") % 2 == 0, F.lit("own"))
    level = (F.col("misses") + 1).cast("int")
    shown = F.when(own.isNotNull() & (level == 1), own).otherwise(hint_at(F.col("hints"), F.when(own.isNotNull(), level - 1).otherwise(level)))
    return rows.select("card_id", shown.alias("hint"))


def _pages(s, d):
    """Three pages a sheet: the problems, their key (numbers again) and an unrelated page."""
    deck = sheets(cards(s, d))
    texts = deck.groupBy("deck_id").agg(F.sort_array(F.collect_list(F.struct("number", "question", "c"))).alias("q"))
    one = F.array_join(F.transform("q", lambda x: F.concat(x["number"].cast("string"), F.lit(") "), x["question"])), "\n")
    two = F.array_join(F.transform("q", lambda x: F.concat(x["number"].cast("string"), F.lit(") "), x["question"], F.lit("\nK"), x["c"].cast("string"))), "\n")
    pages = F.array(one, two, F.lit("no numbers here\n51) x\n52) y\n53) z"))
    return texts.select(F.col("deck_id").alias("doc_id"), F.posexplode(pages).alias("page_index", "text")).withColumn("page_index", F.col("page_index") + 1)


def b12(s, d):
    return X.key_pages(_pages(s, d)).select("doc_id", F.col("page_index").cast("long").alias("page_index"))


def b13(s, d):
    keys = _pages(s, d).join(X.key_pages(_pages(s, d)), ["doc_id", "page_index"], "left_semi")
    return X.key_page_answers(X.split_pages(keys, ["doc_id", "page_index"])).select("doc_id", F.col("number").cast("long").alias("number"), "value")


def b14(s, d):
    rows = X.answers(cards(s, d).select("card_id", "question", "flag", "part", "c"))
    answer, source = X.waterfall([("key", F.when(F.col("flag") == "R", F.col("c").cast("string"))), ("key page", F.when(F.col("part") % 5 == 0, F.lit("page"))), ("solved", F.when(F.col("part") % 7 != 0, F.col("auto")))])
    return rows.select("card_id", answer.alias("answer"), source.alias("answer_source"))


def b15(s, d):
    from pyspark.sql import Window

    rows = cards(s, d).select("deck_id", "card_id", F.when(F.col("part") % 4 != 0, F.col("a")).alias("number"), (F.col("part") % 3).alias("page_index"), F.col("card_id").alias("pos"))
    return rows.select("deck_id", "card_id", F.row_number().over(Window.partitionBy("deck_id").orderBy(*X.order_columns())).cast("long").alias("place"))


def b16(s, d):
    asked = sheets(cards(s, d)).select(F.col("deck_id").alias("doc_id"), "card_id", F.when(F.col("part") % 3 == 0, F.lit("51) x no numbers")).otherwise(F.col("question")).alias("question"))
    return X.guess_page(asked, _pages(s, d)).select("card_id", F.col("page_index").cast("long").alias("page_index"))


def b17(s, d):
    q = F.when(F.col("part") % 5 == 0, F.lit(" ")).when(F.col("part") % 5 == 1, F.concat("question", F.lit(" is to be solved\n7\nab"))).otherwise(F.concat("question", F.lit("\n and so on")))
    rows = cards(s, d).select("deck_id", "card_id", F.col("card_id").alias("pos"), F.when(F.col("part") % 2 == 0, F.col("number").cast("int")).alias("number"), q.alias("question"))
    return X.tidy_deck(rows).select("card_id", F.col("number").cast("long").alias("number"), "question")


def f06(s, d):
    """blank answers filled by the solver, and how many of a deck's were."""
    rows = X.answers(cards(s, d).select("deck_id", "card_id", "question", F.when(F.col("flag") == "R", F.col("c").cast("string")).otherwise("").alias("answer")))
    filled = (F.col("answer") == "") & F.col("auto").isNotNull()
    return rows.groupBy("deck_id").agg(F.count("*").alias("total"), F.count_if(filled).alias("filled"))


def h02(s, d):
    item = table(s, d, "lineitem")
    angle = F.when(F.col("l_linenumber") == 1, F.array(*[F.lit(0.0)] * 6)).otherwise(F.array(F.lit(1.0), F.lit(0.0), F.lit(3.0), F.lit(4.0), F.col("l_quantity"), F.col("l_tax")))
    runs = item.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_index"), F.col("l_partkey").alias("glyph_seq"), angle.alias("transform"), F.col("l_discount").alias("width"), F.when(F.col("l_returnflag") == "A", "  ").otherwise(F.col("l_returnflag")).alias("text"))
    return files.glyphs(runs).select("doc_id", "glyph_seq", "x", "y", "w", "scale", "s")


def _pdf_files(s, d):
    """A PDF file for each sheet, put together by column functions: a page, and a line of text for each problem.

    Files are far dearer to read than their rows are large, so their partitions follow the rows and are not merged by size.
    """
    head = "%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n"
    page = "3 0 obj\n<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /F1 4 0 R >> >> >>\nendobj\n"
    font = "4 0 obj\n<< /Type /Font /Subtype /Type1 /BaseFont /Courier /FirstChar 32 /LastChar 126 /Widths [" + "600 " * 95 + "] >>\nendobj\n"
    starts = [head.index("1 0 obj"), head.index("2 0 obj"), len(head), len(head + page), len(head + page + font)]
    line = F.concat(F.lit("1 0 0 1 "), (F.col("number") % 3 * 150 + 40).cast("string"), F.lit(" "), (F.lit(900) - F.col("number") * 8).cast("string"), F.lit(" Tm ("), F.col("number").cast("string"), F.lit("\\) "), F.col("question"), F.lit(") Tj"))
    n = max(int(s.conf.get("spark.sql.shuffle.partitions")), -(-table(s, d, "lineitem").count() // TASK_ROWS))
    lines = sheets(cards(s, d)).select("deck_id", "number", line.alias("line")).repartition(n, "deck_id")
    sheet = lines.groupBy("deck_id").agg(F.sort_array(F.collect_list(F.struct("number", "line"))).alias("lines"))
    shown = F.concat(F.lit("BT /F1 12 Tf\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\nET"))
    body = F.concat(F.lit(head + page + font + "5 0 obj\n<< /Length "), F.length("shown").cast("string"), F.lit(" >>\nstream\n"), F.col("shown"), F.lit("\nendstream\nendobj\n"))
    places = "xref\n0 6\n0000000000 65535 f \n" + "".join(f"{at:010d} 00000 n \n" for at in starts) + "trailer\n<< /Root 1 0 R /Size 6 >>\nstartxref\n"
    made = sheet.withColumn("shown", shown).withColumn("body", body)
    return made.select(F.col("deck_id").alias("doc_id"), F.encode(F.concat("body", F.lit(places), F.length("body").cast("string"), F.lit("\n%%EOF")), "ISO-8859-1").alias("content"))


def h01_pdf(s, d):
    """The glyph rows of PDF files."""
    runs = pdf.pdf_runs(_pdf_files(s, d), "doc_id")
    return files.glyphs(runs).select("doc_id", F.col("page_index").cast("long").alias("page_index"), "glyph_seq", "x", "y", F.round("w", 6).alias("w"), "scale", "s")


def h04(s, d):
    return table(s, d, "documents").select("doc_id", T.scanned(F.col("text")).alias("needs_ocr"))


#: Lines of a source file; one is a few dozen bytes at most, so that files stay far below files.MAX_BYTES.
SOURCE_LINES = 250_000


def h01(s, d):
    """Sources of two kinds written to the shared folder and read as bytes; unknown kinds and large files are left out.

    A bucket is written in files of so many lines that none is large.
    """
    path = scratch.path(s, "sources")
    rows = cards(s, d).select((F.col("part") % 4).alias("bucket"), "question")
    write = rows.write.option("maxRecordsPerFile", SOURCE_LINES).partitionBy("bucket")
    write.text(path)
    write.json(f"{path}-more")
    found = files.read_sources(s, path, "*.{txt,pdf}").unionByName(files.read_sources(s, f"{path}-more", "*.{txt,pdf}"))
    large = files.read_sources(s, path, "*.txt", max_bytes=0).agg(F.count("*").alias("n_allowed"))
    return found.groupBy("bucket", "extension").agg(F.sum("length").alias("bytes"), F.sum(F.octet_length("content")).alias("content_bytes")).join(large, how="cross").select(F.col("bucket").cast("long").alias("bucket"), "extension", "bytes", "content_bytes", "n_allowed")


def h09(s, d):
    """Decks written as a JSON collection and read again with their schema."""
    rows = cards(s, d).select("deck_id", "card_id", "question")
    path = scratch.path(s, "collection")
    files.write_collection(rows, path)
    return files.read_collection(s, path, "deck_id bigint, card_id bigint, question string")


def h13(s, d):
    reply = F.concat(F.lit("```json\n[{\"number\": "), F.col("a").cast("string"), F.lit(", \"question\": \""), F.col("question"), F.lit("\"}]\n```"))
    reply = F.when(F.col("part") % 4 == 0, F.lit("sorry, no cards")).otherwise(reply)
    return files.parse_cards(cards(s, d).select(F.col("card_id").alias("page"), reply.alias("reply"))).select("page", F.col("number").cast("long").alias("number"), "question", "answer")


QUERIES = {
    "b01_plain_space": b01, "b02_answer_key_region": b02, "b03_key_lines": b03, "b04_inline_key": b04, "b05_b06_problem_split": b05, "b07_clean_block": b07, "b08_inline_answer": b08, "b09_problem_records": b09, "b10_classify": b10,
    "b11_hint_level": b11, "b12_key_pages": b12, "b13_key_page_answers": b13, "b14_answer_waterfall": b14, "b15_problem_order": b15, "b16_guess_page": b16, "b17_tidy_deck": b17, "f06_f07_fill_blanks": f06, "f08_hint_escalation": f08,
    "h01_h03_h10_h14_sources": h01, "h01_pdf_runs": h01_pdf, "h02_glyphs": h02, "h04_needs_ocr": h04, "h08_h09_json_collection": h09, "h13_parse_cards": h13,
}

LINES = f"""WITH {CARDS}, {SHEETS}, w AS (SELECT *, CAST(number AS VARCHAR) || ') ' || question AS line, CASE WHEN flag = 'R' THEN CAST(number AS VARCHAR) || ') K' || CAST(c AS VARCHAR) END AS key_line,
  count(*) OVER (PARTITION BY deck_id) AS n, count(*) FILTER (WHERE flag = 'R') OVER (PARTITION BY deck_id) AS n_keys FROM sheets)"""
TYPE_VALUES = ", ".join(f"({i}, '{t}')" for i, (_, t) in enumerate(PROMPTS))
HINT_VALUES = ", ".join(f"('{t}', {i + 1}, '{h}')" for t, all_hints in HINTS.items() for i, h in enumerate(all_hints))
LABEL_VALUES = ", ".join(f"('{t}', '{x}')" for t, x in LABELS.items())
ENDING_VALUES = ", ".join(f"({i}, '{e}', {'NULL' if a is None else repr(a)}, {cut})" for i, (e, a, cut) in enumerate(ENDINGS))
PAGES = f"""WITH {CARDS}, {SHEETS}, n AS (SELECT deck_id AS doc_id, count(*) AS n FROM sheets GROUP BY deck_id)"""

ORACLE_SQL = {
    "h01_pdf_runs": f"""WITH {CARDS}, {SHEETS}, l AS (SELECT deck_id, number, CAST(number AS VARCHAR) || ') ' || question AS s FROM sheets)
      SELECT deck_id AS doc_id, CAST(1 AS BIGINT) AS page_index, row_number() OVER (PARTITION BY deck_id ORDER BY number) AS glyph_seq, CAST(number % 3 * 150 + 40 AS DOUBLE) AS x, CAST(900 - number * 8 AS DOUBLE) AS y,
        round(CAST(length(s) AS DOUBLE) * 7.2, 6) AS w, CAST(12 AS DOUBLE) AS scale, s FROM l""",
    "b01_plain_space": f"WITH {CARDS} SELECT card_id, CASE WHEN part % 2 = 0 THEN question ELSE '' END AS text FROM cards",
    "b02_answer_key_region": LINES + """ SELECT deck_id, length(string_agg(line, chr(10))) + 1 AS body_chars, CAST(1 + coalesce(length(string_agg(key_line, chr(10))), 0) AS BIGINT) AS key_chars FROM w GROUP BY deck_id""",
    "b03_key_lines": LINES + " SELECT deck_id, number, 'K' || CAST(c AS VARCHAR) AS value FROM w WHERE flag = 'R' AND n_keys >= 2",
    "b04_inline_key": f"""WITH {CARDS}, k AS (SELECT card_id, part % 4 AS form, a, 'K' || CAST(c AS VARCHAR) AS v FROM cards)
      SELECT card_id, a AS number, v AS value FROM k
      UNION ALL SELECT card_id, n AS number, v AS value FROM (SELECT card_id FROM k WHERE form = 0), (VALUES (81, 'K0 and more'), (82, '5')) AS t(n, v)
      UNION ALL SELECT card_id, n AS number, v AS value FROM (SELECT card_id FROM k WHERE form = 2), (VALUES (81, 'two words 82) 7'), (82, '1/2')) AS t(n, v)""",
    "b05_b06_problem_split": LINES + " SELECT deck_id, number, CASE WHEN n >= 2 THEN question ELSE line END AS body, n >= 2 AS marked FROM w",
    "b07_clean_block": f"""WITH {CARDS} SELECT card_id, 'Work out  ' || question || chr(10) || 'and check it by hand' ||
      CASE part % 7 WHEN 2 THEN chr(10) || '7' || chr(10) || '8' WHEN 3 THEN CASE WHEN length(replace('Workout' || question, ' ', '')) < 14 THEN chr(10) || 'm^-1' || chr(10) || 'p ^ (3)' ELSE '' END WHEN 4 THEN chr(10) || 'and more' || chr(10) || 'x' WHEN 5 THEN chr(10) || 'So y = 2x + 1 here' WHEN 6 THEN chr(10) || 'q' || chr(10) || 'Date 5' ELSE '' END AS block FROM cards""",
    "b08_inline_answer": f"""WITH {CARDS}, e(i, ending, answer, cut) AS (VALUES {ENDING_VALUES})
      SELECT card_id, answer, CASE WHEN cut THEN question ELSE trim(question || ending) END AS question FROM cards JOIN e ON e.i = part % {len(ENDINGS)}""",
    "b09_problem_records": LINES + """ SELECT deck_id, number, CASE WHEN n >= 2 THEN question ELSE line END AS question, CASE WHEN n >= 2 AND flag = 'R' THEN 'K' || CAST(c AS VARCHAR) ELSE '' END AS answer,
      CASE WHEN n >= 2 AND flag = 'R' THEN 'key' ELSE '' END AS answer_source FROM w""",
    "b10_classify": f"WITH {CARDS}, t(i, type_label) AS (VALUES {TYPE_VALUES}) SELECT card_id, type_label, label FROM cards JOIN t ON t.i = part % {len(PROMPTS)} JOIN (VALUES {LABEL_VALUES}) AS l(name, label) ON l.name = type_label",
    "b11_hint_level": f"""WITH {CARDS}, t(i, type_label) AS (VALUES {TYPE_VALUES}), h(name, level, hint) AS (VALUES {HINT_VALUES}), k AS (SELECT name, max(level) AS k FROM h GROUP BY name)
      SELECT card_id, CAST(k AS BIGINT) AS n_hints, hint FROM cards JOIN t ON t.i = part % {len(PROMPTS)} JOIN k ON k.name = type_label JOIN h ON h.name = type_label AND h.level = least(misses + 1, k)""",
    "f08_hint_escalation": f"""WITH {CARDS}, t(i, type_label) AS (VALUES {TYPE_VALUES}), h(name, level, hint) AS (VALUES {HINT_VALUES}), k AS (SELECT name, max(level) AS k FROM h GROUP BY name)
      SELECT card_id, CASE WHEN card_id % 2 = 0 AND misses = 0 THEN 'own' ELSE hint END AS hint FROM cards JOIN t ON t.i = part % {len(PROMPTS)} JOIN k ON k.name = type_label
      JOIN h ON h.name = type_label AND h.level = greatest(1, least(misses + CASE WHEN card_id % 2 = 0 THEN 0 ELSE 1 END, k))""",
    "b12_key_pages": PAGES + " SELECT doc_id, CAST(2 AS BIGINT) AS page_index FROM n WHERE n >= 3",
    "b13_key_page_answers": PAGES + " SELECT c.deck_id AS doc_id, c.number, 'K' || CAST(c.c AS VARCHAR) AS value FROM sheets c JOIN n ON n.doc_id = c.deck_id WHERE n.n >= 3",
    "b14_answer_waterfall": f"""WITH {CARDS} SELECT card_id, CASE WHEN flag = 'R' THEN CAST(c AS VARCHAR) WHEN part % 5 = 0 THEN 'page' WHEN part % 7 <> 0 THEN solved ELSE '' END AS answer,
      CASE WHEN flag = 'R' THEN 'key' WHEN part % 5 = 0 THEN 'key page' WHEN part % 7 <> 0 THEN 'solved' ELSE '' END AS answer_source FROM cards""",
    "b15_problem_order": f"""WITH {CARDS} SELECT deck_id, card_id, row_number() OVER (PARTITION BY deck_id ORDER BY CASE WHEN part % 4 <> 0 THEN a ELSE 1000000 END, part % 3, card_id) AS place FROM cards""",
    "b16_guess_page": f"""WITH {CARDS}, {SHEETS}, k AS (SELECT *, lower(regexp_replace(question, '[^A-Za-z0-9]', '', 'g')) AS probe FROM sheets),
      p AS (SELECT deck_id, lower(regexp_replace(string_agg(CAST(number AS VARCHAR) || ') ' || question, '' ORDER BY number), '[^A-Za-z0-9]', '', 'g')) AS one,
        lower(regexp_replace(string_agg(CAST(number AS VARCHAR) || ') ' || question || 'K' || CAST(c AS VARCHAR), '' ORDER BY number), '[^A-Za-z0-9]', '', 'g')) AS two FROM sheets GROUP BY deck_id)
      SELECT k.card_id, CAST(1 AS BIGINT) AS page_index FROM k JOIN p ON p.deck_id = k.deck_id""",
    "b17_tidy_deck": f"""WITH {CARDS}, k AS (SELECT *, row_number() OVER (PARTITION BY deck_id ORDER BY card_id) AS place FROM cards WHERE part % 5 <> 0)
      SELECT card_id, CASE WHEN part % 2 = 0 THEN number ELSE place END AS number, question || CASE WHEN part % 5 = 1 THEN ' is to be solved' ELSE CASE WHEN length(question) >= 12 AND length('and so on') <= 8 THEN '' ELSE ' and so on' END END AS question FROM k""",
    "f06_f07_fill_blanks": f"WITH {CARDS} SELECT deck_id, count(*) AS total, count(*) FILTER (WHERE flag <> 'R') AS filled FROM cards GROUP BY deck_id",
    "h01_h03_h10_h14_sources": f"""WITH {CARDS} SELECT part % 4 AS bucket, 'txt' AS extension, CAST(sum(length(question) + 1) AS BIGINT) AS bytes, CAST(sum(length(question) + 1) AS BIGINT) AS content_bytes, CAST(0 AS BIGINT) AS n_allowed FROM cards GROUP BY 1""",
    "h02_glyphs": """SELECT l_orderkey AS doc_id, l_partkey AS glyph_seq, CASE WHEN l_linenumber = 1 THEN CAST(0 AS DOUBLE) ELSE l_quantity END AS x, CASE WHEN l_linenumber = 1 THEN CAST(0 AS DOUBLE) ELSE l_tax END AS y, l_discount AS w,
      CAST(CASE WHEN l_linenumber = 1 THEN 12 ELSE 5 END AS DOUBLE) AS scale, l_returnflag AS s FROM lineitem WHERE l_returnflag <> 'A'""",
    "h04_needs_ocr": "SELECT doc_id, length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) < 40 AS needs_ocr FROM documents",
    "h08_h09_json_collection": f"WITH {CARDS} SELECT deck_id, card_id, question FROM cards",
    "h13_parse_cards": f"WITH {CARDS} SELECT card_id AS page, a AS number, question, CAST(NULL AS VARCHAR) AS answer FROM cards WHERE part % 4 <> 0",
}
