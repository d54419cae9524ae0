"""Linear equations of one letter solved by column functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import bound, by_name, gcd, quotient

#: coefficient, letter, sign and number of a sum with one letter, and the number it equals; numbers have nine digits and six decimals at most.
NUMBER = r"\d{1,9}(?:\.\d{1,6})?"
FORM = rf"^(-?(?:{NUMBER})?)\s*([a-z])(?:\s*([-+])\s*({NUMBER}))?\s*=\s*(-?{NUMBER})\z"


def millionths(number: Column) -> Column:
    return (number.try_cast("decimal(15,6)") * 1_000_000).try_cast("bigint")


@by_name
def linear_answer(text: Column) -> Column:
    """C06: 'v = n/d' of a text a*v + b = c with whole or decimal numbers and a not 0; null for any other text, which the parser has to see."""

    def numbers(t: Column) -> Column:
        part = [F.regexp_extract(t, FORM, i) for i in range(1, 6)]
        a = F.when(part[0].isin("", "-"), F.concat(part[0], F.lit("1"))).otherwise(part[0])
        n = millionths(part[4]) - F.coalesce(millionths(F.concat(part[2], part[3])), F.lit(0))
        return F.struct(part[1].alias("v"), n.alias("n"), millionths(a).alias("d"))

    def reduced(e: Column) -> Column:
        return F.struct(e["v"].alias("v"), e["n"].alias("n"), e["d"].alias("d"), F.greatest(gcd(e["n"], e["d"]), F.lit(1)).alias("g"))

    def shown(e: Column) -> Column:
        top = quotient(F.when(e["d"] < 0, -e["n"]).otherwise(e["n"]), e["g"])
        bottom = quotient(F.abs(e["d"]), e["g"]).cast("string")
        return F.concat(e["v"], F.lit(" = "), top.cast("string"), F.when(bottom == "1", "").otherwise(F.concat(F.lit("/"), bottom)))

    def solved(t: Column) -> Column:
        return F.when(t.rlike(FORM), bound(numbers(t), lambda e: F.when(e["d"] != 0, bound(reduced(e), shown))))

    return bound(text, solved)
