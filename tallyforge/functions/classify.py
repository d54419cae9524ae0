"""Problem types by the terms and forms of a text, and hints of our own wording."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import bound

#: Fixed values of our own, in order of precedence: the terms of a type. Words are compared in lower case with single spaces
#: between them; a term begins at a word, and ends at one where a space follows it.
TERMS = {
    "system": ["system", "two equations", "substitution", "elimination"],
    "factor": ["factor"],
    "exponents": ["positive exponent"],
    "simplify": ["simplif", "expand", "like terms", "distribut"],
    "slope": ["slope", "y intercept", "x intercept", "equation of the line", "equation of a line", "y mx "],
    "midpoint": ["midpoint", "middle point"],
    "distance": ["distance between", "length of segment", "length of the segment"],
    "pythagorean": ["pythagor", "hypotenuse", "right triangle"],
    "area": ["area ", "areas ", "perimeter", "circumference"],
    "volume": ["volume "],
    "angles": ["angle", "complementary", "supplementary", "transversal", "parallel lines"],
    "congruence": ["congruent", "similar ", "corresponding sides", "sss ", "sas ", "asa ", "aas "],
    "evaluate": ["evaluate", "find the value", "substitut", "when x "],
    "quadratic": ["quadratic"],
}
#: Terms of a text about powers if it has no equals sign, and terms that ask for a solution.
POWER_TERMS, ASKING_TERMS = ["exponent", "power of a power"], ["solv", "zero", "root"]
#: The names of the types.
LABELS = {
    "system": "System of equations", "factor": "Factoring", "exponents": "Properties of exponents", "simplify": "Simplify / expressions", "slope": "Slope / line equations", "midpoint": "Midpoint",
    "distance": "Distance between points", "pythagorean": "Pythagorean theorem", "area": "Area / perimeter", "volume": "Volume / surface area", "angles": "Angles",
    "congruence": "Congruent / similar figures", "evaluate": "Evaluate / substitute", "quadratic": "Quadratic equation", "linear": "Linear equation", "general": "General problem",
}

HINTS = {
    "system": ["Write one variable in terms of the other.", "Put that into the second equation."],
    "factor": ["Take out what all terms share.", "Look for two numbers with the right product and sum."],
    "exponents": ["Count how often each letter is multiplied.", "Like bases: add powers to multiply, subtract them to divide."],
    "simplify": ["Multiply out the brackets.", "Collect terms with the same letters."],
    "slope": ["Rise over run.", "Bring the line to the form y = mx + b."],
    "midpoint": ["Average the two x values, then the two y values.", "Write both as a point."],
    "distance": ["Square both differences and add them.", "Take the root of the sum."],
    "pythagorean": ["Which side is the longest?", "The two short sides squared add up to the long side squared."],
    "area": ["Name the shape first.", "Pick the formula that has the lengths you know."],
    "volume": ["Find the area of the base.", "Multiply by the height."],
    "angles": ["Which angles add up to 180 or 90 degrees?", "Write that as an equation."],
    "congruence": ["Mark what is equal.", "Compare with the rules for triangles."],
    "evaluate": ["Put the number in place of the letter.", "Powers first, then products, then sums."],
    "quadratic": ["Bring all terms to one side.", "Try to factor, or use the formula."],
    "linear": ["Undo sums before products.", "Do the same on both sides until the letter stands alone."],
    "general": ["Say what is asked.", "Write down what is given.", "Try a smaller case."],
}


def _any_of(words: Column, terms: list[str]) -> Column:
    return reduce(or_, [words.contains(f" {t}") for t in terms])


def _squared(text: Column) -> Column:
    """Holds a letter to the second power, its caret lost before a sign or not."""
    return F.translate(F.replace(text, F.lit("²"), F.lit("^2")), " \t\n", "").rlike(r"[a-z](?:\^2|2[+-])")


def classify(column: Column) -> Column:
    """The type of a text by the first type that has one of its terms or its form; 'general' where none has.

    Forms: a power without an equals sign is about exponents; an equation or a question for roots with a squared letter is
    quadratic, else with a letter linear. The last two are tried after all others.
    """

    def first(read: Column) -> Column:
        text, words = read["text"], read["words"]
        equals = text.contains("=")
        forms = {
            "exponents": ~equals & (text.contains("^") | _any_of(words, POWER_TERMS)),
            "quadratic": (equals | _any_of(words, ASKING_TERMS)) & _squared(text),
        }
        out = F
        for name, terms in TERMS.items():
            out = out.when(_any_of(words, terms) | forms.get(name, F.lit(False)), name)
        return out.when((equals & text.rlike("[a-z]")) | _any_of(words, ["solv"]), "linear").otherwise("general")

    words = lambda t: F.concat(F.lit(" "), F.regexp_replace(t, "[^a-z0-9]+", " "), F.lit(" "))
    return bound(F.lower(F.coalesce(column, F.lit(""))), lambda t: bound(F.struct(t.alias("text"), words(t).alias("words")), first))


def label(type_column: Column) -> Column:
    """The name of a type."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), type_column)


def hints(spark: SparkSession) -> DataFrame:
    """The dimension (type_label, hints), one row for each type."""
    return spark.createDataFrame([(k, v) for k, v in HINTS.items()], "type_label string, hints array<string>")


def hint_at(hints_column: Column, level: Column) -> Column:
    """The hint of a level from 1; the last one for higher levels."""
    return F.try_element_at(hints_column, F.least(level, F.size(hints_column)))
