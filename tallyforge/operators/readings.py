"""Plausible readings of garbled questions: the cheapest paths of a lattice, solved exactly and ranked."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions.lattice import BUDGET, Lattice
from tallyforge.operators.extract import solutions
from tallyforge.sources.scratch import drop, keep

#: Readings are solved in bands of costs above a text's cheapest reading; a later band only for texts whose best three it can change.
BANDS = [(0, 4), (5, BUDGET)]


def base_reading(raw: Column) -> Column:
    """A garbled text without label, instruction and answer blanks, on one line; its glyphs stay as they were read.

    The text is cut at line breaks, commas and semicolons. Pieces at the end that hold nothing but a blank (a letter, an
    equals sign and underscores, or less) go, so do last lines of a single letter.
    """
    c = F.regexp_replace(F.regexp_replace(T.replace_all(F.regexp_replace(raw, "\r", ""), [(T.LABEL, ""), (T.INSTRUCTIONS, "")]), "[×·∙]", "*"), "÷", "/")
    pieces = F.split(c, r"(?<=[\n;,])")
    bare = F.transform(pieces, lambda p: F.regexp_replace(p, r"[\s;,_]", ""))
    blank = lambda b: (b == "") | (F.length(b) == 1) & b.rlike("[A-Za-z]") | (F.length(b) <= 2) & b.endswith("=")
    solid = F.array_max(F.concat(F.array(F.lit(1)), F.transform(bare, lambda b, i: F.when(blank(b), 0).otherwise(i + 1))))
    kept = F.array_join(F.slice(pieces, 1, solid), "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"[A-Za-z]?\s*=?\s*_{2,}\s*\z", ""), r"[\s;,]+\z", ""), r"\s*\n\s*", " "))


def paths(texts: DataFrame, low: int = 0, high: int = BUDGET) -> DataFrame:
    """(raw, least, variant, edits, loose): each reading of (raw, base) whose cost is low to high above least, the cheapest one's; texts that no equation can come of have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for raw, base in zip(batch.column("raw").to_pylist(), batch.column("base").to_pylist(), strict=True):
                lattice = Lattice(base)
                least = lattice.least()
                for cost in range(least + low, least + high + 1) if least is not None else ():
                    for reading, loose in lattice.paths(cost):
                        rows.append((raw, least, reading, cost, loose))
                        if len(rows) == 20_000:
                            yield batch_of(rows)
                            rows = []
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.bool_()), strict=True)], names=["raw", "least", "variant", "edits", "loose"])

    return texts.select("raw", "base").mapInArrow(run, "raw string, least int, variant string, edits int, loose boolean")


def bases(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """(raw, base) of the distinct texts; null ones and those without anything to read are left out."""
    texts = rows.select(F.col(raw).alias("raw")).where(F.col(raw).isNotNull()).distinct().withColumn("base", base_reading(F.col("raw"))).where("base <> ''")
    return spread(texts)


def spread(rows: DataFrame) -> DataFrame:
    """rows over all shuffle partitions: few bytes but much work each, which adaptive execution would put into one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def variants(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """(raw, variant, edits, loose): the distinct readings of each distinct text with their least cost; loose if that cost needs a loose edge."""
    return paths(bases(rows, raw)).groupBy("raw", "variant").agg(F.min("edits").alias("edits"), F.min_by("loose", F.struct("edits", "loose")).alias("loose"))


def niceness(kind: Column, answer: Column) -> Column:
    """0 for integers, 1 for fractions with denominators up to 12, 2 for other rationals and for all numbers, 4 for radicals (their text has approximations), 6 for none, 9 for no answer."""
    bottoms = F.transform(F.expr(r"regexp_extract_all(answer, r'/(\d+)', 1)"), lambda x: x.try_cast("bigint"))
    rational = F.when(F.size(bottoms) == 0, 0).when(F.coalesce(F.array_max(F.transform(bottoms, lambda x: F.coalesce(x, F.lit(99)))), F.lit(99)) <= 12, 1).otherwise(2)
    return F.when(answer.isNull(), 9).when(kind == "radical", 4).when(kind.isin("none", "complex"), 6).when(kind == "all", 2).otherwise(rational)


def scored(found: DataFrame, asked: DataFrame) -> DataFrame:
    """The readings that have an answer in asked (variant, answer, kind): adds answer and score, four times the niceness and the cost. A loose one needs a nice answer."""
    nice = found.join(asked, "variant").withColumn("nice", niceness(F.col("kind"), F.col("answer"))).where("nice < 6 and (not loose or nice <= 1)")
    return nice.select("raw", "least", "variant", "edits", "answer", (F.col("nice") * 4 + F.col("edits")).alias("score"))


def best_of(rows: DataFrame, limit: int) -> DataFrame:
    """The best reading of each answer, and of those the best of each text, with their rank."""
    order = ["score", "edits", "variant"]
    one = rows.withColumn("rank", F.row_number().over(Window.partitionBy("raw", "answer").orderBy(*order))).where("rank = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("raw").orderBy(*order))).where(F.col("rank") <= limit)


def readings(rows: DataFrame, raw: str = "raw", limit: int = 3) -> DataFrame:
    """(raw, rank, reading, answer, score, as_read): the best readings of each text, one for each answer, exact among all within the budget.

    A reading's score is at least its cost. So a text is done once its last rank scores no more than the next band's
    cheapest reading costs (of equal scores the one with fewer edits is first), and only the others are read on. Ties go
    to fewer edits, then to the smaller reading. Null and empty texts, and those that no equation can come of, have no readings.
    """
    texts = keep(bases(rows, raw), "texts")
    left, best, done = texts, None, []
    for low, high in BANDS:
        found = keep(paths(left, low, high), "paths")
        # each distinct reading is solved once; written, so that no filter of the join is moved below the solver
        asked = keep(solutions(spread(found.select("variant").distinct()), "variant"), "solved")
        now = scored(found, asked)
        both = now if best is None else best.drop("rank").unionByName(now)
        best = keep(best_of(both, limit), "best")
        done += [asked, found, best]
        if high == BUDGET:
            break
        last = best.groupBy("raw").agg(F.count("*").alias("n"), F.max("score").alias("last"))
        read_on = found.groupBy("raw").agg(F.min("least").alias("least")).join(last, "raw", "left").where((F.coalesce("n", F.lit(0)) < limit) | (F.col("last") > F.col("least") + high + 1))
        left = texts.join(read_on, "raw", "left_semi")
    for table in [texts, *done[:-1]]:
        drop(table)
    return best.select("raw", "rank", F.col("variant").alias("reading"), "answer", "score", (F.col("edits") == 0).alias("as_read"))
