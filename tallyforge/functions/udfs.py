"""Arrow UDFs over the algebra helpers, for distinct texts that columns cannot solve (see operators.extract)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from tallyforge.functions import algebra

# type objects, not DDL: the module can be imported before there is a session
TEXT = StringType()
SOLUTION = StructType([StructField("answer", TEXT), StructField("kind", TEXT), StructField("vars", ArrayType(TEXT)), StructField("roots", ArrayType(DoubleType()))])


@F.pandas_udf(SOLUTION)
def solve(text: pd.Series) -> pd.DataFrame:
    """The solution of an equation text; all fields null where there is none."""
    empty = {"answer": None, "kind": None, "vars": None, "roots": None}
    return pd.DataFrame([algebra.solve(t) or empty for t in text], columns=list(empty))


@F.pandas_udf(StructType([StructField("answer", TEXT), StructField("kind", TEXT)]))
def auto_answer(text: pd.Series) -> pd.DataFrame:
    """Solve, or else simplify, in one pass."""
    rows = []
    for t in text:
        done = algebra.solve(t)
        simple = None if done else algebra.simplify(t)
        rows.append((done["answer"], done["kind"]) if done else (simple, "monomial" if simple else None))
    return pd.DataFrame(rows, columns=["answer", "kind"])
