"""Native column functions for problem texts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns, in order: words of instructions, other forms of operators, answer blanks.
INSTRUCTIONS = r"(?i)\b(?:solve(?: for [a-z])?|find [a-z]|simplify|evaluate|factor|work out)\b:?\s*"
SIGNS = [("[−–—]", "-"), ("[×·]", "*"), ("÷", "/"), ("√", "sqrt"), ("²", "^2"), ("³", "^3"), ("π", "pi")]
BLANK = r"[a-z]?\s*=?\s*_{2,}\s*$"
LABEL = r"^\s*(?:\(\d{1,3}\)|\d{1,3}(?:\)|\.(?!\d)))\s*"
#: White space inside a line.
BLANKS = " \t\f\u000b\r"
#: A numbered line up to its text, with white space, or nothing, behind the point or bracket; whole and its number. Lines end at "\n" alone.
MARK = r"(?md)^[ \t\f\x0B\r]*+(([0-9]{1,2})[ \t\f\x0B\r]*+[.)](?:[ \t\f\x0B\r]++|(?=\n|\z)))"
#: A numbered line with text; its number and that text.
ENTRY = r"(?md)^[ \t\f\x0B\r]*+([0-9]{1,2})[ \t\f\x0B\r]*+[.)][ \t\f\x0B\r]*+([^\n]++)"
#: First words of lines to be filled in.
FORM_WORDS = ["name", "date", "period", "class", "score", "teacher"]
#: Phrases that are an answer at the end of a problem, and the answers.
CLOSINGS = {"no solution": "no solution", "no solutions": "no solution", "all real numbers": "all real numbers", "infinitely many solutions": "infinitely many solutions"}
#: Characters of an answer in braces at most.
BRACED = 48


def bound(value: Column, made: Callable[[Column], Column]) -> Column:
    """made of a value that is computed once, however often made uses it and wherever the optimizer moves the whole."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def by_name(made: Callable[[Column], Column]) -> Callable[[Column | str], Column]:
    """A column function of very many nodes that also takes a column's name, and is then built once a process: building takes longer than planning."""
    held: dict[tuple[int, str], Column] = {}

    @wraps(made)
    def build(column: Column | str) -> Column:
        if isinstance(column, Column):
            return made(column)
        key = (id(SparkContext._gateway), column)
        if key not in held:
            held[key] = made(F.col(column))
        return held[key]

    return build


def replace_all(column: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, *p), pairs, column)


def plain_space(column: Column) -> Column:
    """No-break spaces as spaces, null as ''."""
    return F.translate(F.coalesce(column, F.lit("")), " ", " ")


def light_clean(column: Column) -> Column:
    """Without label, instruction and answer blank; capitals stay."""
    c = replace_all(plain_space(column), [(LABEL, ""), (INSTRUCTIONS, ""), (BLANK, "")])
    return F.trim(c)


def clean_equation(column: Column) -> Column:
    """light_clean with operators in ASCII, X and Y lower-cased, and prose after the last equation cut."""
    c = replace_all(light_clean(column), [*SIGNS, (r"\s+[A-Za-z]{3,}(?:\s+[A-Za-z]{2,})*[.!?]?\s*$", "")])
    return F.trim(F.translate(c, "XY", "xy"))


def tidy_expression(column: Column) -> Column:
    """Operators in ASCII, one space around + and -, none around other signs."""
    c = replace_all(plain_space(column), [*SIGNS, (r"\s+", " "), (r"\s*([*/^()])\s*", "$1"), (r"(?<=[A-Za-z0-9)])\s*([+-])\s*", " $1 ")])
    return F.trim(c)


def quotient(a: Column, b: Column) -> Column:
    """a / b of bigints without its fraction, exact."""
    return F.call_function("div", a, b)


def gcd(a: Column, b: Column) -> Column:
    """The greatest common divisor of two bigints, by Euclid in a fold of as many steps as the smaller one can need."""
    start = F.struct(F.abs(a).alias("a"), F.abs(b).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    # each two steps at least halve the remainder
    most = lambda e: F.when(F.least(e["a"], e["b"]) <= 1, F.lit(2)).otherwise(F.ceil(F.log2(F.least(e["a"], e["b"]).cast("double")) * 1.45).cast("int") + 3)
    return bound(start, lambda e: F.aggregate(F.sequence(F.lit(1), F.coalesce(most(e), F.lit(1))), e, step, lambda s: s["a"]))


def fraction_text(n: Column, d: Column) -> Column:
    """n/d in lowest terms with the sign above, an integer where it is one; null for d = 0."""
    g = F.greatest(gcd(n, d), F.lit(1))
    sign = F.when(d < 0, -1).otherwise(1)
    top, bottom = quotient((sign * n).cast("bigint"), g), quotient(F.abs(d), g)
    return F.when(d == 0, None).when(bottom == 1, top.cast("string")).otherwise(F.concat_ws("/", top.cast("string"), bottom.cast("string")))


def scanned(column: Column) -> Column:
    """Fewer than 40 characters that are not white space."""
    return F.length(F.regexp_replace(plain_space(column), r"\s", "")) < 40


def numbered(line: Column, most: int = 2) -> Column:
    """(number, mark, rest) of a line that begins with a number of so many digits and a point or bracket; null for other lines.

    number is what stands there, mark all up to the text behind the white space that follows, rest that text.
    """
    def parted(clear: Column) -> Column:
        tail = F.ltrim(clear, F.lit("0123456789"))
        digits = F.length(clear) - F.length(tail)
        sign = F.ltrim(tail, F.lit(BLANKS))
        rest = F.ltrim(F.substring(sign, F.lit(2), F.length(sign)), F.lit(BLANKS))
        made = F.struct(F.substring(clear, F.lit(1), digits).alias("number"), F.substring(clear, F.lit(1), F.length(clear) - F.length(rest)).alias("mark"), rest.alias("rest"))
        return F.when(digits.between(1, most) & F.substring(sign, 1, 1).isin(".", ")"), made)

    return bound(F.ltrim(line, F.lit(BLANKS)), parted)


def split_problems(column: Column) -> Column:
    """Array of (number, body) between the marks of a text's lines; fewer than two marks give an empty array.

    A mark is a numbered line with white space, or nothing, behind the mark. One with nothing behind it takes what follows
    as its body, even if that looks like the next mark.
    """
    shown = F.regexp_replace(plain_space(column), MARK, "\u0001$2\u0002$1\u0003")
    taken = F.regexp_replace(shown, "\u0001(\\d+)\u0002[^\u0003]*\u0003\\s*\u0001\\d+\u0002([^\u0003]*)\u0003", "\u0001$1\u0002\u0003$2")
    none = F.array().cast("array<struct<number:int,body:string>>")

    def parts(cut: Column) -> Column:
        each = lambda p: F.struct(F.substring_index(p, "\u0002", 1).cast("int").alias("number"), F.trim(F.substring_index(p, "\u0003", -1), F.lit(" \n\t")).alias("body"))
        return F.when(F.size(cut) >= 3, F.transform(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(1))), each)).otherwise(none)

    return bound(F.split(taken, "\u0001"), parts)


def paragraphs(column: Column) -> Column:
    """Cleaned paragraphs of more than four characters."""
    return F.filter(F.transform(F.split(plain_space(column), r"\n\s*\n"), clean_block), lambda p: F.length(p) > 4)


def is_title(line: Column) -> Column:
    """A capital first, 13 characters or more, no equals sign, and three quarters letters and spaces."""
    letters = F.length(F.regexp_replace(line, "[^A-Za-z ]", ""))
    return F.substring(line, 1, 1).between("A", "Z") & (F.length(line) >= 13) & ~line.contains("=") & (letters * 4 >= F.length(line) * 3)


def is_form(line: Column) -> Column:
    """The first word is one of a form."""
    return F.regexp_extract(F.lower(line), "^[a-z]+", 0).isin(*FORM_WORDS)


def is_crumb(bare: Column) -> Column:
    """A line without white space that is one letter, with or without a whole power."""
    left = F.translate(bare, "^()-0123456789", "")
    return (F.length(left) == 1) & left.rlike("[A-Za-z]") & bare.startswith(left) & ((F.length(bare) == 1) | (F.substring(bare, 2, 1) == "^"))


def clean_block(column: Column) -> Column:
    """Trimmed lines without empty ones, without a title or form line at the end and without a run of crumbs.

    A run of crumbs is two or more last lines that are crumbs, in a block of three lines or more whose first has 14
    characters that are not white space; a number is no crumb, as it may be a denominator. A block of one line has
    nothing to lose but its white space.
    """
    whole = F.translate(plain_space(column), "\r", "")
    lines = F.filter(F.transform(F.split(whole, "\n"), lambda x: F.trim(x, F.lit(BLANKS))), lambda x: x != "")
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(""))

    def without(goes: Callable[[Column], Column], then: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda a: bound(F.when((F.size(a) > 1) & bound(last(a), goes), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a), then)

    def uncrumbed(a: Column) -> Column:
        bare = F.transform(a, lambda x: F.regexp_replace(x, r"\s", ""))
        # the number of the last line that is no crumb, 0 if all are
        solid = F.aggregate(F.transform(bare, lambda x, i: F.when(is_crumb(x), 0).otherwise(i + 1)), F.lit(0), lambda x, y: F.greatest(x, y))
        first = F.length(F.regexp_replace(F.get(a, F.lit(0)), r"\s", ""))
        kept = bound(solid, lambda n: F.when((F.size(a) >= 3) & (first >= 14) & (F.size(a) - n >= 2), F.slice(a, 1, F.greatest(n, F.lit(1)))).otherwise(a))
        return F.array_join(kept, "\n")

    return F.when(whole.contains("\n"), bound(lines, without(is_title, without(is_form, uncrumbed)))).otherwise(F.trim(whole, F.lit(BLANKS)))


def _braced(column: Column) -> Column:
    """What stands between the last opening brace and a closing one at the end; null if there are none or too much is between."""
    def between(inner: Column) -> Column:
        held = F.substring(inner, F.lit(1), F.length(inner) - 1)
        return F.when(inner.endswith("}") & ~held.contains("}") & (F.length(F.trim(held, F.lit(BLANKS + "\n"))) <= BRACED), held)

    text = F.rtrim(column, F.lit(BLANKS + "\n"))
    return F.when(text.contains("{"), bound(F.substring_index(text, "{", -1), between))


def _closing(column: Column) -> Column:
    """The phrase at the end of a text, in lower case with single spaces; null if it ends otherwise."""
    def phrase(words: Column) -> Column:
        ends = [F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), F.lit(n)), " ") for n in (2, 3)]
        return F.coalesce(*[F.when(e.isin(*CLOSINGS), e) for e in ends])

    text = F.lower(F.rtrim(column, F.lit(BLANKS + "\n.")))
    ends = reduce(lambda a, b: a | b, [text.endswith(w) for w in sorted({p.split(" ")[-1] for p in CLOSINGS})])
    return F.when(ends, bound(F.split(text, r"\s+"), phrase))


def inline_answer(column: Column) -> Column:
    """What stands in braces at the end, if it has a digit or begins with x, no or all (else ''); without braces the answer that a closing phrase is; else null."""
    inner = F.trim(F.regexp_replace(F.regexp_replace(_braced(column), r"\s*−\s*", "-"), r"\s+", " "))
    answers = F.create_map(*[F.lit(x) for pair in CLOSINGS.items() for x in pair])
    told = lambda t: t.rlike("[0-9]") | F.exists(F.array(*[F.lit(w) for w in ("x", "no", "all")]), lambda w: F.startswith(F.lower(t), w))
    return bound(inner, lambda t: F.when(t.isNotNull(), F.when(told(t), t).otherwise("")).otherwise(F.try_element_at(answers, _closing(column))))


def without_inline_answer(column: Column) -> Column:
    """The question before an answer of inline_answer; braces go even where they hold no answer."""
    text = F.rtrim(column, F.lit(BLANKS + "\n"))
    words = F.split(F.rtrim(column, F.lit(BLANKS + "\n.")), r"(?=\s\S)")

    def cut(found: Column) -> Column:
        before = F.substring(text, F.lit(1), F.length(text) - F.length(found["braced"]) - 2)
        n = F.size(F.split(found["closing"], " "))
        spoken = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - n, F.lit(0))), "")
        return F.trim(F.when(found["braced"].isNotNull(), before).when(found["closing"].isNotNull(), spoken).otherwise(column), F.lit(" \n\t"))

    return bound(F.struct(_braced(column).alias("braced"), _closing(column).alias("closing")), cut)


def looks_mathy(column: Column) -> Column:
    """Holds an operator between operands, a power or a root."""
    return column.rlike(r"[0-9A-Za-z)]\s*[-+*/^=]\s*[-(0-9A-Za-z]|√|sqrt")


def outer_parens_off(column: Column) -> Column:
    """Without one pair of parentheses around a text that holds no others."""
    return F.regexp_replace(column, r"^\(([^()]*)\)\z", "$1")


def top_slash(column: Column) -> Column:
    """(top, bottom) at the first slash outside parentheses; null without one."""
    depth = F.aggregate(
        F.split(column, ""),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(0).alias("at")),
        lambda s, ch: F.struct(
            (s["i"] + 1).alias("i"),
            (s["depth"] + F.when(ch == "(", 1).when(ch == ")", -1).otherwise(0)).alias("depth"),
            F.when((s["at"] == 0) & (s["depth"] == 0) & (ch == "/"), s["i"] + 1).otherwise(s["at"]).alias("at"),
        ),
        lambda s: s["at"],
    )
    return F.when(depth > 0, F.struct(F.substring(column, F.lit(1), depth - 1).alias("top"), F.substring(column, depth + 1, F.length(column)).alias("bottom")))
