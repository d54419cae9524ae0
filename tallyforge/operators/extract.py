"""Pages and worksheet texts to problem records, answers and their sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import monomials, polynomials
from tallyforge.functions import text as T
from tallyforge.functions.linear import linear_answer
from tallyforge.functions.text import bound
from tallyforge.functions.udfs import auto_answer, solve

#: Words that head a key when they stand alone or before its first number.
HEADINGS = ["answer", "answers", "solution", "solutions"]
#: Characters of an answer among several of a line at most.
INLINE = 40


def _behind_heading(line: Column) -> Column:
    """What follows the heading of a key in its line; null for lines that are none. 'Answer key' heads one wherever it stands."""
    first = F.regexp_extract(F.lower(line), r"^\s*([a-z]+)", 1)
    rest = F.regexp_replace(line, r"^\s*[A-Za-z]+[:.]?", "")
    alone = (F.trim(rest, F.lit(T.BLANKS)) == "") | rest.rlike(r"^\s+[0-9]")
    named = F.get(F.split(line, r"(?i)answer\s*key", 2), F.lit(1))
    # most lines hold none of the words, which is cheap to see
    told = reduce(lambda a, b: a | b, [F.lower(line).contains(w) for w in ("answer", "solution")])
    return F.when(told, F.coalesce(named, F.when(first.isin(*HEADINGS) & alone, rest)))


def split_key(pages: DataFrame) -> DataFrame:
    """Adds body and key_text, the text before and after the heading of the answer key; without one all is body."""
    lines = F.split(T.plain_space(F.col("text")), "\n")
    behind = F.transform(lines, _behind_heading)
    at = F.coalesce(F.array_position(F.transform(behind, lambda b: b.isNotNull()), F.lit(True)), F.lit(0)).cast("int")
    cut = pages.withColumns({"_lines": lines, "_behind": behind, "_at": at})
    head = F.get(F.split(F.get("_lines", F.col("_at") - 1), r"(?i)answer\s*key", 2), F.lit(0))
    head = F.when(F.get("_lines", F.col("_at") - 1).rlike(r"(?i)answer\s*key"), head).otherwise("")
    body = F.array_join(F.concat(F.slice("_lines", 1, F.greatest(F.col("_at") - 1, F.lit(0))), F.array(head)), "\n")
    key = F.array_join(F.concat(F.array(F.get("_behind", F.col("_at") - 1)), F.slice("_lines", F.col("_at") + 1, F.size("_lines"))), "\n")
    found = F.col("_at") > 0
    return cut.withColumns({"body": F.when(found, body).otherwise(F.array_join("_lines", "\n")), "key_text": F.when(found, key).otherwise("")}).drop("_lines", "_behind", "_at")


def line_entries(key_text: Column) -> Column:
    """Array of (number, value) of the lines 'N) value'; number is text."""
    found = F.arrays_zip(F.regexp_extract_all(key_text, F.lit(T.ENTRY), F.lit(1)).alias("number"), F.regexp_extract_all(key_text, F.lit(T.ENTRY), F.lit(2)).alias("value"))
    return F.transform(found, lambda m: F.struct(m["number"].alias("number"), F.trim(F.regexp_replace(m["value"], r"\s+", " ")).alias("value")))


def _entries_of(line: Column) -> Column:
    tokens = F.filter(F.split(line, r"\s+"), lambda t: t != "")
    is_mark = lambda t: F.length(t).between(2, 3) & F.substring(t, -1, 1).isin(".", ")") & (F.ltrim(F.substring(t, F.lit(1), F.length(t) - 1), F.lit("0123456789")) == "")
    places = lambda made: F.filter(F.transform(made, lambda t, i: F.when(is_mark(t), i + 1)), lambda i: i.isNotNull())

    def items(pair: Column) -> Column:
        at, words = pair["at"], pair["tokens"]
        upto = lambda k: F.coalesce(F.get(at, k + 1), F.size(words) + 1)
        return F.transform(at, lambda p, k: F.struct(F.substring_index(F.substring_index(F.get(words, p - 1), ")", 1), ".", 1).alias("number"), F.array_join(F.slice(words, p + 1, upto(k) - p - 1), " ").alias("value")))

    return bound(F.struct(tokens.alias("tokens"), places(tokens).alias("at")), items)


def inline_entries(key_text: Column) -> Column:
    """Array of (number, value) of answers 'N) value' that follow each other in a line, values of at most 40 characters."""
    every = F.flatten(F.transform(F.split(key_text, "\n"), _entries_of))
    return F.filter(every, lambda e: F.length(e["value"]).between(1, INLINE))


def _last_values(entries: Column) -> Column:
    """Number to value, the last one of a number; numbers have two digits, so there are a hundred and ten at most."""

    def last(pair: Column) -> Column:
        every, numbers = pair["entries"], pair["numbers"]
        repeated = F.map_from_arrays(numbers, F.transform(numbers, lambda n: F.element_at(F.filter(every, lambda e: e["number"] == n), -1)["value"]))
        return F.when(F.size(numbers) == F.size(every), F.map_from_entries(every)).otherwise(repeated)

    return bound(entries, lambda e: bound(F.struct(e.alias("entries"), F.array_distinct(F.transform(e, lambda x: x["number"])).alias("numbers")), last))


def key_map(key_text: Column) -> Column:
    """Number (as it is written) to value: of lines if they have two numbers or more; else of answers that follow each other, and of lines where those have none."""

    def chosen(e: Column) -> Column:
        by_line, by_inline = e["line"], e["inline"]
        missing = F.map_filter(by_line, lambda n, v: ~F.map_contains_key(by_inline, n))
        return F.map_concat(by_inline, missing)

    inline = lambda m: bound(F.struct(m.alias("line"), _last_values(inline_entries(key_text)).alias("inline")), chosen)
    return bound(_last_values(line_entries(key_text)), lambda m: F.when(F.size(m) >= 2, m).otherwise(inline(m)))


def key_lines(pages: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, number, value, n_numbers) of lines 'N) value', the last one of a number; number is text, n_numbers counts those of the ids."""
    found = pages.select(*ids, _last_values(line_entries(F.col("key_text"))).alias("key"))
    return found.select(*ids, F.explode("key").alias("number", "value"), F.size("key").alias("n_numbers"))


def answer_key(pages: DataFrame, ids: list[str]) -> DataFrame:
    """One value for each number of a page's key; a row of pages is a page, read once.

    Numbers are compared as they are written, so one with a leading zero answers no problem.
    """
    rows = split_key(pages).select(*ids, F.explode(key_map(F.col("key_text"))).alias("number", "value"))
    plain = F.col("number").cast("int")
    return rows.where(plain.cast("string") == F.col("number")).withColumn("number", plain)


def split_pages(pages: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, pos, number, body, marked): a row for each problem; texts without two marks are split at blank lines and numbered from 1."""
    marked = pages.select(*ids, "text", T.split_problems(F.col("text")).alias("parts"))
    plain = F.transform(T.paragraphs(F.col("text")), lambda p, i: F.struct((i + 1).alias("number"), p.alias("body")))
    both = marked.select(*ids, (F.size("parts") > 0).alias("marked"), F.when(F.size("parts") > 0, F.col("parts")).otherwise(plain).alias("parts"))
    return both.select(*ids, "marked", F.posexplode("parts").alias("pos", "part")).select(*ids, "pos", "part.number", "part.body", "marked")


def problems(pages: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, pos, number, question, answer, answer_source); the key goes before an answer in the text, none is ''.

    A page's problems are looked up in its own key, so there is one pass and no shuffle. Paragraphs of texts without marks
    are questions as they stand.
    """
    cut = split_key(pages).select(*ids, "body", T.split_problems(F.col("body")).alias("parts"), key_map(F.col("key_text")).alias("key"))
    marked = F.size("parts") > 0
    plain = F.transform(T.paragraphs(F.col("body")), lambda p, i: F.struct((i + 1).alias("number"), p.alias("body")))
    parts = F.transform(F.when(marked, F.col("parts")).otherwise(plain), lambda p: F.struct(p["number"].alias("number"), p["body"].alias("body"), F.try_element_at("key", p["number"].cast("string")).alias("value")))
    rows = cut.select(*ids, marked.alias("marked"), F.posexplode(parts).alias("pos", "part")).select(*ids, "pos", "part.*", "marked")
    rows = rows.withColumn("block", F.when(F.col("marked"), T.clean_block(F.col("body"))).otherwise(F.col("body")))
    inline = F.when(F.col("marked"), F.nullif(T.inline_answer(F.col("block")), F.lit("")))
    rows = rows.withColumns({"inline": inline, "question": F.when(F.col("marked"), T.without_inline_answer(F.col("block"))).otherwise(F.col("block"))}).where(F.length("question") >= 2)
    value = F.when(F.col("marked"), F.nullif(F.col("value"), F.lit("")))
    return rows.select(
        *ids, "pos", "number", "question", F.coalesce(value, "inline", F.lit("")).alias("answer"), F.when(value.isNotNull(), "key").when(F.col("inline").isNotNull(), "inline").otherwise("").alias("answer_source")
    )


def key_pages(pages: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """(doc_id, page_index) of pages that answer an earlier one: at least three line-start numbers, over 60 % of them on that page.

    Numbers are exploded and joined on (doc, number), so pages meet only where they share one.
    """
    found = F.array_distinct(F.transform(F.expr(r"regexp_extract_all(text, r'(?m)^[ \t]*(\d{1,3})[.)]', 1)"), lambda x: x.cast("int")))
    nums = pages.select("doc_id", "page_index", found.alias("nums")).where(F.size("nums") >= least)
    each = pages.select("doc_id", F.col("page_index").alias("earlier"), F.explode(found).alias("number"))
    mine = nums.select("doc_id", "page_index", F.size("nums").alias("n"), F.explode("nums").alias("number"))
    both = mine.join(each, ["doc_id", "number"]).where("earlier < page_index").groupBy("doc_id", "page_index", "earlier").agg((F.count("*") / F.first("n")).alias("overlap"))
    return both.where(F.col("overlap") > share).select("doc_id", "page_index").distinct()


def key_page_answers(blocks: DataFrame) -> DataFrame:
    """(doc_id, number, value): the lines after a block's first, of the last key page that has the number."""
    lines = F.split("body", "\n")
    rest = F.array_join(F.slice(lines, 2, F.size(lines)), " ")
    return blocks.withColumn("value", F.trim(rest)).where("value <> ''").groupBy("doc_id", "number").agg(F.max_by("value", F.struct("page_index", "pos")).alias("value"))


def answers(rows: DataFrame, question: str = "question") -> DataFrame:
    """Adds auto and auto_kind: the solution, else the simplified form. Each distinct question is solved once and joined back.

    Columns solve all but odd texts (functions.polynomials, functions.monomials), which the parser gets.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = rows.select(F.col(question).alias("_q")).where(F.col("_q").isNotNull()).distinct().repartition(parts).withColumn("_t", T.clean_equation(F.col("_q")))
    asked = _by_columns(asked, "_t").withColumn("_m", F.when(F.col("_answer").isNull(), monomials.simplify("_t")))
    asked = asked.withColumn("_s", auto_answer(F.when(F.col("_answer").isNull() & (F.col("_odd") | F.col("_m.odd")), F.col("_t"))))
    solved = asked.select("_q", F.coalesce("_answer", "_s.answer", "_m.form").alias("auto"), F.coalesce("_kind", "_s.kind", F.when(F.col("_m.form").isNotNull(), "monomial")).alias("auto_kind"))
    return rows.join(solved, F.col(question) == F.col("_q"), "left").drop("_q")


def _by_columns(rows: DataFrame, text: str) -> DataFrame:
    """Adds _answer, _kind and _odd of a cleaned text: plain linear equations by their form, others by their tokens."""
    plain = rows.withColumn("_n", linear_answer(text))
    whole = plain.withColumn("_p", F.when(F.col("_n").isNull(), polynomials.solve(text)))
    return whole.withColumns({"_answer": F.coalesce("_n", "_p.answer"), "_kind": F.when(F.col("_n").isNotNull(), "linear").otherwise(F.col("_p.kind")), "_odd": F.coalesce("_p.odd", F.lit(False))}).drop("_n", "_p")


def solutions(rows: DataFrame, question: str) -> DataFrame:
    """(question, answer, kind) of distinct texts: by columns, odd ones by the parser."""
    asked = _by_columns(rows.withColumn("_t", T.clean_equation(F.col(question))), "_t").withColumn("_s", solve(F.when(F.col("_odd"), F.col("_t"))))
    return asked.select(question, F.coalesce("_answer", "_s.answer").alias("answer"), F.coalesce("_kind", "_s.kind").alias("kind"))


def verify_key(mine: DataFrame, key: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, mine, key, my_form, key_form, verdict) of all numbers of either side; ids are unique on each.

    A text's form is its canonical monomial, else its solution, else itself without white space. The verdict is match,
    differ, or which side is missing; an empty or null text has no form and matches nothing.
    """

    def form(text: Column) -> Column:
        bare = F.nullif(F.regexp_replace(text, r"\s", ""), F.lit(""))
        return F.coalesce(monomials.canonical(text)["form"], polynomials.solve(T.clean_equation(text))["answer"], bare)

    left = mine.select(*ids, F.col("expression").alias("mine"), form(F.col("expression")).alias("my_form"), F.lit(True).alias("_l"))
    right = key.select(*ids, F.col("expression").alias("key"), form(F.col("expression")).alias("key_form"), F.lit(True).alias("_r"))
    verdict = F.when(F.col("_r").isNull(), "no key").when(F.col("_l").isNull(), "no answer").when(F.col("my_form") == F.col("key_form"), "match").otherwise("differ")
    return left.join(right, ids, "full_outer").select(*ids, "mine", "key", "my_form", "key_form", verdict.alias("verdict"))


def waterfall(columns: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(answer, source): the first that is neither null nor '', and its name."""
    given = [(n, F.nullif(c, F.lit(""))) for n, c in columns]
    source = F.lit("")
    for name, c in reversed(given):
        source = F.when(c.isNotNull(), name).otherwise(source)
    return F.coalesce(*[c for _, c in given], F.lit("")), source


def order_columns() -> list[Column]:
    """By number, missing ones last, then page and position."""
    return [F.coalesce(F.col("number"), F.lit(1_000_000)), F.col("page_index"), F.col("pos")]


def guess_page(cards: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds page_index: the first page of the document that holds the question's first 24 letters and digits (six at least), else its first page."""
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    probe = F.substring(norm(F.col("question")), 1, 24)
    texts = pages.select("doc_id", F.col("page_index").alias("_p"), norm(F.col("text")).alias("_t"))
    joined = cards.withColumn("_probe", probe).join(texts, "doc_id", "left")
    hit = F.min(F.when((F.length("_probe") >= 6) & F.col("_t").contains(F.col("_probe")), F.col("_p")))
    return joined.groupBy(*cards.columns).agg(F.coalesce(hit, F.min("_p")).alias("page_index"))


def tidy_deck(cards: DataFrame) -> DataFrame:
    """Without empty questions, on one line, without short last lines after a first line of 12 characters; a missing number is the position."""
    lines = F.filter(F.split("question", "\n"), lambda x: F.trim(x) != "")
    solid = F.aggregate(F.transform(lines, lambda x, i: F.when((F.length(F.trim(x)) > 8) | x.contains("="), i + 1).otherwise(F.lit(0))), F.lit(1), lambda a, b: F.greatest(a, b))
    kept = F.when((F.size(lines) > 1) & (F.length(F.get(lines, F.lit(0))) >= 12), F.slice(lines, 1, solid)).otherwise(lines)
    rows = cards.where(F.trim(F.coalesce("question", F.lit(""))) != "")
    place = F.row_number().over(Window.partitionBy("deck_id").orderBy("pos"))
    return rows.withColumns({"question": F.array_join(F.transform(kept, lambda x: F.trim(x)), " "), "number": F.coalesce("number", place)})
