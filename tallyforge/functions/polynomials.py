"""Equations of one letter up to the second degree, and two linear ones of two letters, on columns alone.

An expression is a fold over its tokens. A polynomial of the letters v and w is a struct of its six coefficients (of 1, v,
v^2, w, w^2 and vw) over one denominator, in bigints; a level of brackets holds the sum so far, the product at hand and
whether the next factor divides. What leaves this form (quotients by letters, higher powers, numbers beyond bigint) is
odd and left to the parser.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import bound, by_name, fraction_text, gcd, quotient

#: A number, a letter or a closing bracket with its whole power, or a sign.
TOKEN = r"(?:[0-9]+(?:\.[0-9]+)?|[A-Za-z]|\))(?:\^(?:-?[0-9]{1,2}|\(-?[0-9]{1,2}\)))?|[-+*/(]"
#: Powers of sums and numbers beyond this are odd.
MAX_POWER = 8
#: Square factors are looked for up to the cube root of numbers up to this.
MAX_RADICAND = 10**12
POLY = "struct<c:array<bigint>,d:bigint>"
LEVEL = "struct<acc:struct<c:array<bigint>,d:bigint>,cur:struct<c:array<bigint>,d:bigint>,div:boolean>"


def poly(coefficients: list[Column], d: Column | int = 1) -> Column:
    return F.struct(F.array(*[F.lit(c).cast("bigint") for c in coefficients]).alias("c"), F.lit(d).cast("bigint").alias("d"))


ZERO, ONE, MINUS = ([n, 0, 0, 0, 0, 0] for n in (0, 1, -1))


def _at(p: Column, i: int) -> Column:
    return F.get(p["c"], F.lit(i))


def _sum(*terms: Column) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = F.try_add(out, t)
    return out


def plus(p: Column, q: Column) -> Column:
    """p + q; over the same denominator where both have it."""
    alike = poly([_sum(_at(p, i), _at(q, i)) for i in range(6)], p["d"])
    apart = poly([_sum(F.try_multiply(_at(p, i), q["d"]), F.try_multiply(_at(q, i), p["d"])) for i in range(6)], F.try_multiply(p["d"], q["d"]))
    return F.when(p["d"] == q["d"], alike).otherwise(apart)


def times(p: Column, q: Column) -> Column:
    pairs = [[(0, 0)], [(0, 1), (1, 0)], [(0, 2), (1, 1), (2, 0)], [(0, 3), (3, 0)], [(0, 4), (3, 3), (4, 0)], [(0, 5), (5, 0), (1, 3), (3, 1)]]
    return poly([_sum(*[F.try_multiply(_at(p, i), _at(q, j)) for i, j in each]) for each in pairs], F.try_multiply(p["d"], q["d"]))


def degree(p: Column) -> Column:
    nonzero = lambda *at: F.exists(F.array(*[_at(p, i) for i in at]), lambda c: c != 0)
    return F.when(nonzero(2, 4, 5), 2).when(nonzero(1, 3), 1).otherwise(0)


def inverse(p: Column) -> Column:
    """1 / p of a number; null for 0."""
    top = _at(p, 0)
    return F.when(top != 0, poly([F.when(top < 0, -p["d"]).otherwise(p["d"]), 0, 0, 0, 0, 0], F.abs(top)))


def _fold(tokens: Column, names: Column) -> Column:
    """The state behind the last token: acc + cur is the value if ok and nothing is wanted; odd if the parser has to see it."""

    def state(like: Column, **fields: Column) -> Column:
        kept = {f: like[f] for f in ("stack", "acc", "cur", "div", "want", "number", "ok", "odd")} | fields
        return F.struct(*[c.alias(f) for f, c in kept.items()])

    def atom(name: Column) -> Column:
        parts = F.split(name, r"\.")
        tail = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
        number = poly([F.concat(F.get(parts, F.lit(0)), tail).try_cast("bigint"), 0, 0, 0, 0, 0], F.rpad(F.lit("1"), F.length(tail) + 1, F.lit("0")).try_cast("bigint"))
        return F.when(name.rlike("^[0-9]"), number).when(name == F.get(names, F.lit(0)), poly([0, 1, 0, 0, 0, 0])).otherwise(poly([0, 0, 0, 1, 0, 0]))

    def valued(s: Column, t: Column) -> Column:
        """A number, letter or closed bracket to its power, taken into the product at hand."""
        name, power = F.substring_index(t, "^", 1), F.when(t.contains("^"), F.translate(F.substring_index(t, "^", -1), "()", "")).otherwise("1").cast("int")
        closes = name == ")"
        level = F.when(closes, F.get(s["stack"], F.lit(0))).otherwise(F.struct(s["acc"].alias("acc"), s["cur"].alias("cur"), s["div"].alias("div")))
        made = F.struct(F.when(closes, plus(s["acc"], s["cur"])).otherwise(atom(name)).alias("v"), power.alias("power"), level.alias("level"), closes.alias("closes"), name.rlike("^[0-9]").alias("number"))

        def taken(m: Column) -> Column:
            deep = degree(m["v"])
            # negative powers and divisors with letters are rational functions
            beyond = (F.abs(m["power"]) > MAX_POWER) | (deep * m["power"] > 2) | (deep > 0) & ((m["power"] < 0) | m["level"]["div"])
            raised = F.aggregate(F.sequence(F.lit(1), F.when(beyond, 1).otherwise(F.greatest(F.abs(m["power"]), F.lit(1)))), poly(ONE), lambda a, _: times(a, m["v"]))
            raised = F.when(m["power"] == 0, poly(ONE)).otherwise(raised)

            def joined(factor: Column) -> Column:
                far = beyond | (degree(factor) + degree(m["level"]["cur"]) > 2)
                return state(
                    s, stack=F.when(m["closes"], F.slice(s["stack"], 2, F.greatest(F.size(s["stack"]) - 1, F.lit(0)))).otherwise(s["stack"]), acc=m["level"]["acc"], cur=times(m["level"]["cur"], factor), div=F.lit(False), want=F.lit(False),
                    number=m["number"], odd=s["odd"] | F.coalesce(far, F.lit(True)), ok=s["ok"] & F.when(m["closes"], ~s["want"] & (F.size(s["stack"]) > 0)).otherwise(~(s["number"] & m["number"])),
                )

            flipped = (m["power"] < 0) != m["level"]["div"]
            return bound(raised, lambda r: bound(F.when(flipped, inverse(r)).otherwise(r), joined))

        return bound(made, taken)

    def step(s: Column, t: Column) -> Column:
        held = F.struct(s["acc"].alias("acc"), s["cur"].alias("cur"), s["div"].alias("div"))
        opened = state(s, stack=F.concat(F.array(held), s["stack"]), acc=poly(ZERO), cur=poly(ONE), div=F.lit(False), want=F.lit(True), number=F.lit(False))
        minus = F.when(t == "-", poly(MINUS)).otherwise(poly(ONE))
        unary = state(s, cur=F.when(t == "-", times(s["cur"], poly(MINUS))).otherwise(s["cur"]), number=F.lit(False))
        binary = state(s, acc=plus(s["acc"], s["cur"]), cur=minus, div=F.lit(False), want=F.lit(True), number=F.lit(False))
        timed = state(s, div=t == "/", want=F.lit(True), number=F.lit(False), ok=s["ok"] & ~s["want"])
        return F.when(t == "(", opened).when(t.isin("+", "-") & s["want"], unary).when(t.isin("+", "-"), binary).when(t.isin("*", "/"), timed).otherwise(valued(s, t))

    start = F.struct(
        F.array().cast(f"array<{LEVEL}>").alias("stack"), poly(ZERO).alias("acc"), poly(ONE).alias("cur"), F.lit(False).alias("div"), F.lit(True).alias("want"), F.lit(False).alias("number"), F.lit(True).alias("ok"), F.lit(False).alias("odd")
    )
    return F.aggregate(tokens, start, step)


#: A sum of terms without brackets and quotients; a term is a number, or a letter with a factor and a power up to 2.
TERM = r"(?:[0-9]{1,9}(?:\.[0-9]{1,6})?|(?:[0-9]{1,9}(?:\.[0-9]{1,6})?\*?)?[A-Za-z](?:\^[12])?)"
PLAIN_SUM = rf"^[-+]*{TERM}(?:[-+]+{TERM})*=[-+]*{TERM}(?:[-+]+{TERM})*\z"


def _plain_sum(bare: Column, names: Column) -> Column:
    """The difference of an equation of the form PLAIN_SUM, by adding up its terms."""
    def of_side(side: int) -> Column:
        return F.transform(F.regexp_extract_all(F.substring_index(bare, "=", side), F.lit("[-+]*[^-+]+"), F.lit(0)), lambda t: F.struct(t.alias("t"), F.lit(side).alias("side")))

    terms = F.concat(of_side(1), of_side(-1))
    scale = F.when(bare.contains("."), 1_000_000).otherwise(1).cast("bigint")

    def summed(unit: Column) -> Column:
        def part(x: Column) -> Column:
            number = F.regexp_extract(x["t"], r"^[-+]*([0-9.]*)", 1)
            turned = (F.length(x["t"]) - F.length(F.translate(x["t"], "-", ""))) % 2 == 1
            size = (F.when(number == "", "1").otherwise(number).cast("decimal(15,6)") * unit).cast("bigint")
            letter = F.regexp_extract(x["t"], "[A-Za-z]", 0)
            place = F.when(letter == "", 0).otherwise(F.when(letter == F.get(names, F.lit(0)), 1).otherwise(3) + F.when(x["t"].endswith("^2"), 1).otherwise(0))
            return F.struct(place.alias("at"), (size * F.when(turned, -1).otherwise(1) * x["side"]).alias("n"))

        parts = F.transform(terms, part)
        total = lambda a: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.aggregate(F.filter(a, lambda x: x["at"] == i), F.lit(0).cast("bigint"), lambda n, x: n + x["n"]))
        made = F.struct(bound(parts, total).alias("c"), unit.alias("d"))
        return F.struct(made.alias("p"), F.lit(True).alias("ok"), F.lit(False).alias("odd"))

    return bound(scale, summed)


def difference(equation: Column, names: Column) -> Column:
    """Left less right side as (p, ok, odd), p over its own denominator: sums by their terms, other expressions by a fold over their tokens."""
    bare = F.regexp_replace(equation, r"\s", "")
    # a space between digits would be lost
    plain = bound(bare, lambda b: F.when(b.rlike(PLAIN_SUM) & ~equation.rlike(r"[0-9.]\s+[0-9.]"), _plain_sum(b, names)))
    return bound(plain, lambda p: F.when(p.isNotNull(), p).otherwise(_by_tokens(equation, names)))


def _by_tokens(equation: Column, names: Column) -> Column:
    bare = F.regexp_replace(equation, r"\s", "")
    whole = F.concat(F.lit("("), F.substring_index(bare, "=", 1), F.lit(")-("), F.substring_index(bare, "=", -1), F.lit(")"))
    spaced = F.regexp_replace(equation, r"\s*\^\s*", "^")
    # digits with a space between them are two numbers
    broken = spaced.rlike(r"[0-9.]\s+[0-9.]")

    def checked(pair: Column) -> Column:
        known = F.length(F.array_join(pair["tokens"], "")) == F.length(pair["text"])

        def judged(s: Column) -> Column:
            p = plus(s["acc"], s["cur"])
            lost = p["d"].isNull() | F.exists(p["c"], lambda c: c.isNull())
            fine = s["ok"] & ~s["want"] & (F.size(s["stack"]) == 0) & ~broken
            return F.struct(p.alias("p"), (known & fine).alias("ok"), (~known | s["odd"] | F.coalesce(lost, F.lit(True))).alias("odd"))

        return bound(_fold(F.when(known, pair["tokens"]).otherwise(F.array(F.lit("0"))), names), judged)

    return bound(F.struct(F.regexp_extract_all(whole, F.lit(TOKEN), F.lit(0)).alias("tokens"), whole.alias("text")), checked)


def equations(text: Column) -> Column:
    """The parts of a text with one equals sign each. Line breaks, commas, semicolons and 'and' part it, and so does the white space behind a number that is a right side, where another equals sign follows."""
    again = F.regexp_replace(text, r"(=\s*-?[0-9]+(?:[./][0-9]+)?)\s+(?=[^=\n;,]*=)", "$1\n")
    parts = F.split(again, r"[\n;,]|\band\b")
    return F.filter(parts, lambda p: F.length(p) - F.length(F.translate(p, "=", "")) == 1)


def letters(parts: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.array_join(parts, " "), F.lit("[A-Za-z]"), F.lit(0)))


def shown(x: Column) -> Column:
    """A number near an integer as that, else three decimals without zeros at the end."""
    whole = F.round(x)
    text = F.rtrim(F.rtrim(F.round(x, 3).cast("decimal(38,3)").cast("string"), F.lit("0")), F.lit("."))
    return F.when(F.abs(x - whole) < 1e-9, whole.cast("decimal(38,0)").cast("string")).otherwise(text)


def square_root(n: Column) -> Column:
    """The root of a square; null for other numbers."""
    r = F.round(F.sqrt(n.cast("double"))).cast("bigint")
    return F.when(F.try_multiply(r, r) == n, r)


def root_parts(n: Column) -> Column:
    """(k, m) with n = k k m and m free of squares, for n from 1 to MAX_RADICAND: once the primes up to the cube root are divided out, what is left is a square or has none."""
    once = lambda s, f: F.when(s["rest"] % f == 0, F.struct((s["k"] * F.when(s["odd"], f).otherwise(1)).alias("k"), quotient(s["rest"], f).alias("rest"), (~s["odd"]).alias("odd"))).otherwise(s)
    fresh = lambda s: F.struct(s["k"].alias("k"), s["rest"].alias("rest"), F.lit(False).alias("odd"))
    step = lambda s, f: F.when(s["rest"] % f == 0, F.aggregate(F.sequence(F.lit(1), F.lit(40)), fresh(s), lambda a, _: once(a, f))).otherwise(s)
    last = F.greatest(F.ceil(F.cbrt(n.cast("double"))).cast("bigint"), F.lit(2))
    start = F.struct(F.lit(1).cast("bigint").alias("k"), n.alias("rest"), F.lit(False).alias("odd"))
    k = bound(F.aggregate(F.sequence(F.lit(2).cast("bigint"), last), start, step), lambda s: s["k"] * F.coalesce(square_root(s["rest"]), F.lit(1)))
    return bound(k, lambda f: F.struct(f.alias("k"), quotient(n, f * f).alias("m")))


def solution(answer: Column, kind: str, roots: Column | None = None) -> Column:
    none = F.array().cast("array<double>")
    return F.struct(answer.alias("answer"), F.lit(kind).alias("kind"), (none if roots is None else roots).alias("roots"))


def _reduced(p: Column) -> Column:
    """Coefficients of 1, v and v^2 without a common factor, their denominator's included."""
    g = gcd(gcd(gcd(_at(p, 0), _at(p, 1)), _at(p, 2)), p["d"])
    return bound(F.when(p["d"] == 1, F.lit(1).cast("bigint")).otherwise(F.greatest(g, F.lit(1))), lambda f: F.struct(*[quotient(_at(p, i), f).alias(n) for i, n in enumerate("cba")]))


def _quadratic(e: Column, v: Column) -> Column:
    a, b = e["a"], e["b"]
    disc = F.try_subtract(F.try_multiply(b, b), F.try_multiply(F.try_multiply(F.lit(4).cast("bigint"), a), e["c"]))
    root = lambda r, sign: fraction_text(-b + sign * r, 2 * a)
    near = lambda d, sign: (-b.cast("double") + sign * F.sqrt(d.cast("double"))) / (2 * a).cast("double")

    def whole(r: Column) -> Column:
        both = F.concat(v, F.lit(" = "), root(r, 1), F.lit(" or "), v, F.lit(" = "), root(r, -1))
        value = lambda sign: ((-b + sign * r) / (2 * a)).cast("double")
        return F.when(r == 0, solution(F.concat(v, F.lit(" = "), root(r, 1)), "quadratic", F.array(value(1)))).otherwise(solution(both, "quadratic", F.array(value(1), value(-1))))

    def radical(d: Column) -> Column:
        text = lambda x: F.concat(v, F.lit(" = ("), (-b).cast("string"), F.lit(" ± "), F.when(x["k"] == 1, "").otherwise(x["k"].cast("string")), F.lit("√"), x["m"].cast("string"), F.lit(") / "), (2 * a).cast("string"), F.lit("  ≈  "), shown(near(d, 1)), F.lit(" or "), shown(near(d, -1)))
        return bound(root_parts(d), lambda x: solution(text(x), "radical", F.array(near(d, 1), near(d, -1))))

    def of(d: Column) -> Column:
        return F.when(d < 0, solution(F.lit("no real solution"), "complex")).otherwise(bound(square_root(d), lambda r: F.when(r.isNotNull(), whole(r)).when(d <= MAX_RADICAND, radical(d))))

    return bound(disc, of)


def _single(p: Column, v: Column) -> Column:
    def of(e: Column) -> Column:
        linear = solution(F.concat(v, F.lit(" = "), fraction_text(-e["c"], e["b"])), "linear", F.array((-e["c"] / e["b"]).cast("double")))
        flat = F.when(e["c"] == 0, solution(F.lit("all real numbers"), "all")).otherwise(solution(F.lit("no solution"), "none"))
        return F.when((e["a"] == 0) & (e["b"] == 0), flat).when(e["a"] == 0, linear).otherwise(_quadratic(e, v))

    return bound(_reduced(p), of)


def _system(p: Column, q: Column, names: Column) -> Column:
    """Cramer's rule for two linear equations; null if one is not linear."""
    cross = lambda i, j: F.try_subtract(F.try_multiply(_at(p, i), _at(q, j)), F.try_multiply(_at(p, j), _at(q, i)))
    curved = F.exists(F.array(*[_at(x, i) for x in (p, q) for i in (2, 4, 5)]), lambda c: c != 0)

    def of(d: Column) -> Column:
        v, w = F.get(names, F.lit(0)), F.get(names, F.lit(1))
        text = F.concat(v, F.lit(" = "), fraction_text(d["x"], d["det"]), F.lit(",  "), w, F.lit(" = "), fraction_text(d["y"], d["det"]))
        return F.when(d["det"] == 0, solution(F.lit("no unique solution"), "none")).otherwise(solution(text, "system", F.array((d["x"] / d["det"]).cast("double"), (d["y"] / d["det"]).cast("double"))))

    return F.when(~curved, bound(F.struct(cross(1, 3).alias("det"), cross(3, 0).alias("x"), cross(0, 1).alias("y")), of))


@by_name
def solve(text: Column) -> Column:
    """(answer, kind, roots, vars, odd) of a text, like the parser's; answer is null where it has none, and odd says that the parser may know more.

    Null texts have null answers. More than two letters, two equations of one letter, one of two, and no letter have none.
    """

    def of(parts: Column) -> Column:
        def named(names: Column) -> Column:
            n, k = F.size(parts), F.size(names)
            fits = (n == 1) & (k == 1) | (n == 2) & (k == 2)

            def judged(z: Column) -> Column:
                one, two = F.get(z, F.lit(0)), F.get(z, F.lit(1))
                ok, odd = F.forall(z, lambda x: x["ok"]), F.exists(z, lambda x: x["odd"])
                done = F.when(F.size(z) == 1, _single(one["p"], F.get(names, F.lit(0)))).otherwise(_system(one["p"], two["p"], names))
                kept = bound(F.when(ok & ~odd & fits, done), lambda s: F.struct(s["answer"].alias("answer"), s["kind"].alias("kind"), s["roots"].alias("roots"), names.alias("vars"), F.coalesce(fits & (odd | ok & s["answer"].isNull()), F.lit(False)).alias("odd")))
                return kept

            return bound(F.transform(F.when(fits, parts).otherwise(F.array().cast("array<string>")), lambda p: difference(p, names)), judged)

        return bound(letters(parts), named)

    return bound(equations(F.coalesce(text, F.lit(""))), of)


def bracketed(fraction: Column) -> Column:
    return F.when(fraction.contains("/"), F.concat(F.lit("("), fraction, F.lit(")"))).otherwise(fraction)


@by_name
def steps(text: Column) -> Column:
    """The working of a linear equation in one letter: as given, terms collected, divided by the factor where it is not 1, solved; a line that repeats the one before is left out. Null for other texts."""

    def of(parts: Column) -> Column:
        def worked(pair: Column) -> Column:
            e, v = pair["e"], pair["v"]
            given = F.concat(F.trim(F.substring_index(F.get(parts, F.lit(0)), "=", 1)), F.lit(" = "), F.trim(F.substring_index(F.get(parts, F.lit(0)), "=", -1)))
            factor = F.when((e["b"] == e["d"]), "").when(e["b"] == -e["d"], "-").otherwise(fraction_text(e["b"], e["d"]))
            collected = F.concat(factor, v, F.lit(" = "), fraction_text(-e["c"], e["d"]))
            divided = F.when(F.abs(e["b"]) != e["d"], F.concat(v, F.lit(" = "), bracketed(fraction_text(-e["c"], e["d"])), F.lit(" / "), bracketed(fraction_text(e["b"], e["d"]))))
            solved = F.concat(v, F.lit(" = "), fraction_text(-e["c"], e["b"]))
            lines = F.array_compact(F.array(given, collected, divided, solved))
            return F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), (x == F.coalesce(F.get(lines, i - 1), F.lit(""))).alias("again"))), lambda x: ~x["again"]), lambda x: x["x"])

        def named(names: Column) -> Column:
            fits = (F.size(parts) == 1) & (F.size(names) == 1)
            z = F.transform(F.when(fits, parts).otherwise(F.array().cast("array<string>")), lambda p: difference(p, names))
            plain = lambda x: x["ok"] & ~x["odd"] & (_at(x["p"], 2) == 0) & (_at(x["p"], 1) != 0)
            made = lambda x: F.struct(F.struct(_at(x["p"], 0).alias("c"), _at(x["p"], 1).alias("b"), x["p"]["d"].alias("d")).alias("e"), F.get(names, F.lit(0)).alias("v"))
            return F.get(F.transform(F.transform(F.filter(z, plain), made), worked), F.lit(0))

        return bound(letters(parts), named)

    return bound(equations(F.coalesce(text, F.lit(""))), of)
