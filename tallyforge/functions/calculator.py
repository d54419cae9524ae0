"""Calculations on columns alone: signs of several forms, brackets, functions, constants and results as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import bound, by_name

#: Functions of one number; angles are in degrees.
FUNCTIONS = {
    "sqrt": F.sqrt, "cbrt": F.cbrt, "abs": F.abs, "round": lambda x: _whole(x + 0.5), "floor": lambda x: _whole(x), "ceil": lambda x: -_whole(-x), "ln": F.ln, "log": F.log10,
    "sin": lambda x: F.sin(F.radians(x)), "cos": lambda x: F.cos(F.radians(x)), "tan": lambda x: F.tan(F.radians(x)),
    "asin": lambda x: F.degrees(F.asin(x)), "acos": lambda x: F.degrees(F.acos(x)), "atan": lambda x: F.degrees(F.atan(x)),
}
TOKEN = rf"(?:{'|'.join(FUNCTIONS)})?\(|[0-9]+(?:\.[0-9]+)?|\.[0-9]+|pi|inf|e|[-+*/%^)]"
LEVEL = "struct<acc:double,cur:double,op:string,bases:array<struct<v:double,neg:boolean>>,neg:boolean,call:string>"
#: Results beyond this are not written out here.
LARGEST = 1e18


def _whole(x: Column) -> Column:
    """The integer below x; numbers without decimals as they are."""
    return F.when(F.abs(x) < 2.0**52, F.floor(F.when(F.abs(x) < 2.0**52, x).otherwise(0.0)).cast("double")).otherwise(x)


def normal(text: Column) -> Column:
    """Signs in ASCII, raised digits as powers, a root of a number in brackets, no commas between thousands, no white space around signs."""
    c = F.translate(F.coalesce(text, F.lit("")), "×·∙÷−–—", "***/---")
    c = F.regexp_replace(c, "(⁻?[⁰¹²³⁴⁵⁶⁷⁸⁹]+)", "^($1)")
    c = F.translate(c, "⁻⁰¹²³⁴⁵⁶⁷⁸⁹", "-0123456789")
    c = F.regexp_replace(F.regexp_replace(c, "√\\s*([0-9]+(?:\\.[0-9]+)?|π)", "sqrt($1)"), "√", "sqrt")
    c = F.regexp_replace(F.regexp_replace(c, "π", " pi "), "∞", " inf ")
    return F.regexp_replace(c, r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")


def _fold(tokens: Column) -> Column:
    """The state behind the last token of (t, next)."""
    nan = F.lit(float("nan"))
    none = F.array().cast("array<struct<v:double,neg:boolean>>")

    def state(like: Column, **fields: Column) -> Column:
        kept = {f: like[f] for f in ("stack", "acc", "cur", "op", "bases", "neg", "call", "want", "number", "ok")} | fields
        return F.struct(*[c.alias(f) for f, c in kept.items()])

    def power(base: Column, exponent: Column) -> Column:
        return F.pow(base, exponent)

    def called(name: Column, x: Column) -> Column:
        out = x
        for f, made in FUNCTIONS.items():
            out = F.when(name == f, F.coalesce(made(x).cast("double"), nan)).otherwise(out)
        return out

    def taken(s: Column, token: Column) -> Column:
        """An operand: kept for a power that follows, else raised from right to left and taken into the product."""
        t = token["t"]
        closes = t == ")"
        held = F.struct(*[s[f].alias(f) for f in ("acc", "cur", "op", "bases", "neg", "call")])
        number = F.when(t == "pi", F.pi()).when(t == "e", F.e()).when(t == "inf", F.lit(float("inf"))).otherwise(t.try_cast("double"))
        made = F.struct(
            F.when(closes, called(s["call"], s["acc"] + s["cur"])).otherwise(number).alias("v"), F.when(closes, F.get(s["stack"], F.lit(0))).otherwise(held).alias("level"), closes.alias("closes"), t.rlike("^[0-9.]").alias("digits"), (F.coalesce(token["next"], F.lit("")) == "^").alias("based")
        )

        def placed(m: Column) -> Column:
            level = m["level"]
            fine = s["ok"] & F.when(m["closes"], ~s["want"] & (F.size(s["stack"]) > 0)).otherwise(~(s["number"] & m["digits"]))
            left = F.when(m["closes"], F.slice(s["stack"], 2, F.greatest(F.size(s["stack"]) - 1, F.lit(0)))).otherwise(s["stack"])
            common = {"stack": left, "acc": level["acc"], "call": level["call"], "want": F.lit(False), "number": m["digits"], "ok": fine, "neg": F.lit(False)}
            based = state(s, cur=level["cur"], op=level["op"], bases=F.concat(level["bases"], F.array(F.struct(m["v"].alias("v"), level["neg"].alias("neg")))), **common)
            first = F.when(level["neg"], -m["v"]).otherwise(m["v"])
            value = F.when(F.size(level["bases"]) == 0, first).otherwise(F.aggregate(F.reverse(level["bases"]), first, lambda r, b: F.when(b["neg"], -power(b["v"], r)).otherwise(power(b["v"], r))))

            def joined(r: Column) -> Column:
                safe = F.when(r == 0, 1.0).otherwise(r)
                cur = F.when(level["op"] == "/", F.when(r == 0, nan).otherwise(level["cur"] / safe)).when(level["op"] == "%", F.when(r == 0, nan).otherwise(level["cur"] % safe)).otherwise(level["cur"] * r)
                return state(s, cur=cur, op=F.lit("*"), bases=none, **common)

            return F.when(m["based"], based).otherwise(bound(value, joined))

        return bound(made, placed)

    def step(s: Column, token: Column) -> Column:
        t = token["t"]
        held = F.struct(*[s[f].alias(f) for f in ("acc", "cur", "op", "bases", "neg", "call")])
        opened = state(s, stack=F.concat(F.array(held), s["stack"]), acc=F.lit(0.0), cur=F.lit(1.0), op=F.lit("*"), bases=none, neg=F.lit(False), call=F.substring(t, F.lit(1), F.length(t) - 1), want=F.lit(True), number=F.lit(False))
        raising = F.size(s["bases"]) > 0
        unary = state(s, cur=F.when((t == "-") & ~raising, -s["cur"]).otherwise(s["cur"]), neg=F.when((t == "-") & raising, ~s["neg"]).otherwise(s["neg"]), number=F.lit(False))
        binary = state(s, acc=s["acc"] + s["cur"], cur=F.when(t == "-", -1.0).otherwise(1.0), op=F.lit("*"), want=F.lit(True), number=F.lit(False))
        timed = state(s, op=t, want=F.lit(True), number=F.lit(False), ok=s["ok"] & ~s["want"])
        raised = state(s, want=F.lit(True), number=F.lit(False), ok=s["ok"] & ~s["want"])
        return F.when(t.endswith("("), opened).when(t.isin("+", "-") & s["want"], unary).when(t.isin("+", "-"), binary).when(t == "^", raised).when(t.isin("*", "/", "%"), timed).otherwise(taken(s, token))

    start = F.struct(
        F.array().cast(f"array<{LEVEL}>").alias("stack"), F.lit(0.0).alias("acc"), F.lit(1.0).alias("cur"), F.lit("*").alias("op"), none.alias("bases"), F.lit(False).alias("neg"), F.lit("").alias("call"),
        F.lit(True).alias("want"), F.lit(False).alias("number"), F.lit(True).alias("ok"),
    )
    return F.aggregate(tokens, start, step)


def shown(x: Column) -> Column:
    """C34: 'undefined' where x is not finite, an integer within 1e-10 of one, else eight decimals without zeros at the end."""
    near = F.round(x)
    text = F.rtrim(F.rtrim(F.round(x, 8).cast("decimal(38,8)").cast("string"), F.lit("0")), F.lit("."))
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), "undefined").when(F.abs(x) > LARGEST, F.format_string("%.0f", x)).when(F.abs(x - near) < 1e-10, near.cast("decimal(38,0)").cast("string")).otherwise(text)


@by_name
def calculate(text: Column) -> Column:
    """The result of a calculation as text, '' for a null or empty text, null where it is none.

    Precedence: powers from the right, signs, then * / % and factors side by side from the left, sums. A function needs brackets.
    """
    plain = normal(text)
    whole = F.regexp_replace(plain, r"\s", "")
    # two numbers, or a point and a number, with a space between them
    broken = plain.rlike(r"[0-9.]\s+[0-9.]")

    def checked(pair: Column) -> Column:
        known = F.length(F.array_join(pair["tokens"], "")) == F.length(pair["text"])
        tokens = F.when(known, pair["tokens"]).otherwise(F.array(F.lit("0")))
        placed = bound(tokens, lambda a: F.transform(a, lambda t, i: F.struct(t.alias("t"), F.get(a, i + 1).alias("next"))))
        result = lambda s: F.when(known & s["ok"] & ~s["want"] & (F.size(s["stack"]) == 0) & ~broken, bound(s["acc"] + s["cur"], shown))
        return F.when(pair["text"] == "", "").otherwise(bound(_fold(placed), result))

    return bound(F.struct(F.regexp_extract_all(whole, F.lit(TOKEN), F.lit(0)).alias("tokens"), whole.alias("text")), checked)
