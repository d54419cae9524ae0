"""Products of numbers and letters with whole powers, on columns alone: simplified, in one form, compared.

A monomial is a struct of a fraction n/d in bigints and a map from letters to powers, which are added with map_zip_with.
An expression is a fold over its tokens; what goes beyond bigints or has other powers than whole numbers is odd and left
to the parser.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import LABEL, bound, by_name, gcd, quotient

#: A number, a letter or a closing bracket with its whole power, or a sign.
TOKEN = r"(?:[0-9]+(?:\.[0-9]+)?|[A-Za-z]|\))(?:\^(?:-?[0-9]{1,6}|\(-?[0-9]{1,6}\)))?|[-+*/(]"
MONO = "struct<n:bigint,d:bigint,p:map<string,int>>"
LEVEL = f"struct<cur:{MONO},div:boolean>"
#: Factors of a number's power beyond which it cannot be a bigint.
MAX_FACTORS = 64


def mono(n: Column | int, d: Column | int = 1, p: Column | None = None) -> Column:
    powers = F.create_map().cast("map<string,int>") if p is None else p
    return F.struct(F.lit(n).cast("bigint").alias("n"), F.lit(d).cast("bigint").alias("d"), powers.alias("p"))


def times(x: Column, y: Column) -> Column:
    both = F.map_zip_with(x["p"], y["p"], lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))

    def reduced(e: Column) -> Column:
        g = F.greatest(gcd(e["n"], e["d"]), F.lit(1))
        return mono(quotient(e["n"], g), quotient(e["d"], g), F.map_filter(e["p"], lambda _, v: v != 0))

    return bound(mono(F.try_multiply(x["n"], y["n"]), F.try_multiply(x["d"], y["d"]), both), lambda e: F.when(e["d"] == 1, mono(e["n"], e["d"], F.map_filter(e["p"], lambda _, v: v != 0))).otherwise(reduced(e)))


def inverse(x: Column) -> Column:
    """1 / x; null for 0."""
    made = mono(F.when(x["n"] < 0, -x["d"]).otherwise(x["d"]), F.abs(x["n"]), F.transform_values(x["p"], lambda _, v: -v))
    return F.when(x["n"] != 0, made)


def raised(x: Column, power: Column) -> Column:
    """x to a power; numbers beyond bigint are null."""
    size = F.abs(power)

    def number(base: Column) -> Column:
        unit = F.when((base == -1) & (size % 2 == 1), -1).otherwise(F.abs(base)).cast("bigint")
        folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(size, F.lit(MAX_FACTORS)), F.lit(1))), F.lit(1).cast("bigint"), lambda a, _: F.try_multiply(a, base))
        return F.when(size == 0, F.lit(1).cast("bigint")).when(F.abs(base) <= 1, unit).when(size <= MAX_FACTORS, folded)

    made = mono(number(x["n"]), number(x["d"]), F.map_filter(F.transform_values(x["p"], lambda _, v: v * size), lambda _, v: v != 0))
    return F.when(power < 0, bound(made, inverse)).otherwise(made)


def _fold(tokens: Column) -> Column:
    def state(like: Column, **fields: Column) -> Column:
        kept = {f: like[f] for f in ("stack", "cur", "div", "want", "number", "ok")} | fields
        return F.struct(*[c.alias(f) for f, c in kept.items()])

    def atom(name: Column) -> Column:
        parts = F.split(name, r"\.")
        tail = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
        number = mono(F.concat(F.get(parts, F.lit(0)), tail).try_cast("bigint"), F.rpad(F.lit("1"), F.length(tail) + 1, F.lit("0")).try_cast("bigint"))
        return F.when(name.rlike("^[0-9]"), number).otherwise(mono(1, 1, F.create_map(name, F.lit(1))))

    def valued(s: Column, t: Column) -> Column:
        name, power = F.substring_index(t, "^", 1), F.when(t.contains("^"), F.translate(F.substring_index(t, "^", -1), "()", "")).otherwise("1").cast("int")
        closes = name == ")"
        level = F.when(closes, F.get(s["stack"], F.lit(0))).otherwise(F.struct(s["cur"].alias("cur"), s["div"].alias("div")))
        made = F.struct(F.when(closes, s["cur"]).otherwise(atom(name)).alias("v"), power.alias("power"), level.alias("level"), closes.alias("closes"), name.rlike("^[0-9]").alias("number"))

        def taken(m: Column) -> Column:
            fine = s["ok"] & F.when(m["closes"], ~s["want"] & (F.size(s["stack"]) > 0)).otherwise(~(s["number"] & m["number"]))
            left = F.when(m["closes"], F.slice(s["stack"], 2, F.greatest(F.size(s["stack"]) - 1, F.lit(0)))).otherwise(s["stack"])
            signed = F.when(m["level"]["div"], -m["power"]).otherwise(m["power"])
            return bound(raised(m["v"], signed), lambda r: state(s, stack=left, cur=times(m["level"]["cur"], r), div=F.lit(False), want=F.lit(False), number=m["number"], ok=fine))

        return bound(made, taken)

    def step(s: Column, t: Column) -> Column:
        opened = state(s, stack=F.concat(F.array(F.struct(s["cur"].alias("cur"), s["div"].alias("div"))), s["stack"]), cur=mono(1), div=F.lit(False), want=F.lit(True), number=F.lit(False))
        # a sign between two factors is a sum, which is no monomial
        signed = state(s, cur=F.when(t == "-", times(s["cur"], mono(-1))).otherwise(s["cur"]), number=F.lit(False), ok=s["ok"] & s["want"])
        timed = state(s, div=t == "/", want=F.lit(True), number=F.lit(False), ok=s["ok"] & ~s["want"])
        return F.when(t == "(", opened).when(t.isin("+", "-"), signed).when(t.isin("*", "/"), timed).otherwise(valued(s, t))

    start = F.struct(F.array().cast(f"array<{LEVEL}>").alias("stack"), mono(1).alias("cur"), F.lit(False).alias("div"), F.lit(True).alias("want"), F.lit(False).alias("number"), F.lit(True).alias("ok"))
    return F.aggregate(tokens, start, step)


def monomial(text: Column) -> Column:
    """(m, ok, odd): the monomial of a text; ok where it is one, odd where the parser may know more."""
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")
    broken = F.coalesce(text, F.lit("")).rlike(r"[0-9.]\s+[0-9.]")

    def checked(pair: Column) -> Column:
        known = F.length(F.array_join(pair["tokens"], "")) == F.length(pair["text"])
        end = _fold(F.when(known, pair["tokens"]).otherwise(F.array(F.lit("1"))))

        def judged(s: Column) -> Column:
            lost = s["cur"]["n"].isNull() | s["cur"]["d"].isNull() | s["cur"]["p"].isNull()
            fine = known & s["ok"] & ~s["want"] & (F.size(s["stack"]) == 0) & ~broken
            zero = mono(F.coalesce(s["cur"]["n"], F.lit(0)))
            return F.struct(F.when(s["cur"]["n"] == 0, zero).otherwise(s["cur"]).alias("m"), (fine & ~F.coalesce(lost, F.lit(True))).alias("ok"), (~known | F.coalesce(lost, F.lit(True)) & fine).alias("odd"))

        return bound(end, judged)

    return bound(F.struct(F.regexp_extract_all(whole, F.lit(TOKEN), F.lit(0)).alias("tokens"), whole.alias("text")), checked)


def positive(m: Column) -> Column:
    """With positive powers only, as (top)/(bottom); letters in order, brackets around two factors or more."""

    def side(sign: int, number: Column) -> Column:
        letters = F.transform(F.filter(F.array_sort(F.map_entries(m["p"])), lambda e: e["value"] * sign > 0), lambda e: F.when(F.abs(e["value"]) == 1, e["key"]).otherwise(F.concat(e["key"], F.lit("^"), F.abs(e["value"]).cast("string"))))
        return F.when((number != 1) | (F.size(letters) == 0), F.concat(F.array(number.cast("string")), letters)).otherwise(letters)

    def joined(s: Column) -> Column:
        plain = F.array_join(s["bottom"], "") == "1"
        text = lambda a: F.when(F.size(a) > 1, F.concat(F.lit("("), F.array_join(a, ""), F.lit(")"))).otherwise(F.array_join(a, ""))
        return F.concat(F.when(m["n"] < 0, "-").otherwise(""), F.when(plain, F.array_join(s["top"], "")).otherwise(F.concat(text(s["top"]), F.lit("/"), text(s["bottom"]))))

    return bound(F.struct(side(1, F.abs(m["n"])).alias("top"), side(-1, m["d"]).alias("bottom")), joined)


@by_name
def canonical(text: Column) -> Column:
    """(form, odd): one form for equal monomials, whatever they are written like; the form of other texts is null."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), LABEL, ""), r"=\s*_*\s*\z", "")
    return bound(monomial(bare), lambda x: F.struct(F.when(x["ok"], positive(x["m"])).alias("form"), x["odd"].alias("odd")))


@by_name
def simplify(text: Column) -> Column:
    """(form, odd): the simplified form of a monomial expression; null if there is nothing to do."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), LABEL, ""), r"(?i)\b(?:simplify|evaluate|rewrite)\b:?", ""))
    plain = lambda c: F.regexp_replace(c, r"[\s*()]", "")

    def done(t: Column) -> Column:
        return bound(canonical(t), lambda x: F.struct(F.when(t.rlike("[*/^(]") & (plain(x["form"]) != plain(t)), x["form"]).alias("form"), (x["odd"] & t.rlike("[*/^(]")).alias("odd")))

    return bound(bare, done)
