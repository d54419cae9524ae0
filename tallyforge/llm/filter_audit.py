"""How filters of documents interact: every order of five filters at once, by products of histograms and incidence matrices.

A document's failures are a mask of five bits; what an order of filters does to it follows from the mask alone. So one
pass makes a histogram of 32 masks for each part, for all documents and for those with a label, and integer matrices of
32 masks by 600 steps (120 orders of 5) turn stacked histograms into counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import forget, save, table

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
#: Characters between words.
GAPS = " \t\n\x0b\x0c\r"
#: Parts whose histograms are multiplied at once.
PARTS = 256
COUNTS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: Column) -> Column:
    """Bits 0 to 3 of a text's mask: A too few words, B too few distinct ones, C too many capitals, D odd characters."""
    words = F.split(F.trim(text, F.lit(GAPS)), r"[\x20\x09-\x0D]+")
    n = F.when(F.trim(text, F.lit(GAPS)) == "", 0).otherwise(F.size(words)).cast("long")
    distinct = F.when(n == 0, 0).otherwise(F.size(F.array_distinct(words))).cast("long")
    capitals = (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))).cast("long")
    tests = [n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def incidence() -> dict[str, np.ndarray]:
    """Matrices of 32 masks by 600 steps, and shapley, the removals of a step's filter over all orders."""
    masks = np.arange(32)[:, None]
    bits = np.array([[1 << LETTERS.index(c) for c in order] for order in ORDERS])
    before = (np.cumsum(bits, axis=1) - bits).ravel()
    own = bits.ravel()
    fails, earlier = (masks & own) != 0, (masks & before) != 0
    out = {"kept": ~fails & ~earlier, "removed": fails & ~earlier, "redundant": fails & earlier, "unique_fails": masks == own}
    out = {k: v.astype(np.int64) for k, v in out.items()}
    out["shapley"] = out["removed"] @ (own[:, None] == own[None]).astype(np.int64)
    return out


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by mask, all and those labelled quality=1 or toxic=1.

    A document fails E where a smaller id of the whole table has the same text. Only (text digest, id) pairs are joined,
    so a text of very many copies is no hot key; rows without an id never fail E. A null text counts as the empty one. Where labels repeat
    an id, a document is good or toxic if one of its labels says so.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = save(
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), failures(text).alias("low")),
        "audit",
    )
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    said = labels.groupBy(F.col(id_col).alias("id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(o) for c, o in (("quality", "good"), ("toxic", "toxic"))])
    copy = F.col("first").isNull() & F.col("id").isNotNull()
    whole = rows.join(first, ["digest", "id"], "left").join(said, "id", "left").withColumn("mask", F.col("low") + F.when(copy, 16).otherwise(0))
    out = save(whole.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")), "histogram")
    forget(rows)
    return out


def audit(histogram: DataFrame) -> DataFrame:
    """Counts of every part, order and step, from masks(). No parts give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = incidence()
        order, step = pa.array(np.repeat(ORDERS, 5)), pa.array(np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS)))
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                block = batch.slice(at, PARTS)
                rows = {k: np.zeros((block.num_rows, 32), dtype=np.int64) for k in ("n", "good", "toxic")}
                for i, cells in enumerate(block.column("cells").to_pylist()):
                    for c in cells:
                        for k, h in rows.items():
                            h[i, c["mask"]] += c[k]
                made = [rows["n"] @ by[k] for k in ("kept", "removed", "redundant", "unique_fails")] + [rows[k] @ by["removed"] for k in ("good", "toxic")] + [rows["n"] @ by["shapley"]]
                for i, part in enumerate(block.column("part").to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(order), pa.string()), order, step, *[pa.array(m[i]) for m in made]], names=[c.split()[0] for c in COUNTS.split(", ")])

    # at most 32 cells a part
    cells = histogram.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return cells.mapInArrow(run, COUNTS)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t
), l AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(words) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INT)
    + 4 * CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS INT)
    + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(w.doc_id > first, false) AS INT) AS mask
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id
), x(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT x1.c || x2.c || x3.c || x4.c || x5.c AS filter_order, [x1.b, x2.b, x3.b, x4.b, x5.b] AS bits FROM x x1, x x2, x x3, x x4, x x5
  WHERE x1.b + x2.b + x3.b + x4.b + x5.b = 31 AND x1.b | x2.b | x3.b | x4.b | x5.b = 31
), s AS (
  SELECT filter_order, CAST(k AS INT) AS step, bits[k] AS own, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INT) AS earlier FROM o, range(1, 6) AS r(k)
), h AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
c AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE mask & (own + earlier) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & earlier <> 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0), 0) AS toxic_lost
  FROM h, s GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM c
"""
