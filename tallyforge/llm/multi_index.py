"""Embedding near-duplicates over an inverted multi-index.

Two codebooks, one for each half of the unit vectors, form a product grid of cells in each label. A vector visits cells
in the order of a lower bound on its distance to whatever they hold: for a half, the distance to the hyperplane between
its own centroid and the cell's. The traversal ends when that bound passes the distance that belongs to the cosine, so
its recall is proven to be 1, however well the codebooks fit; visited cells are then verified in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.blocks import split_hot
from tallyforge.llm.common import by_key, forget, save, table, valid_vector, vectors
from tallyforge.llm.graph import components
from tallyforge.llm.simhash import roots

#: The codebooks are fitted on at most this many vectors, those with the smallest hashes of their ids.
FIT_ROWS = 4096
PART_ROWS = 8_000
#: Vectors of a length from which their cells are told apart.
GRID_FROM = 256


def units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centroids of k-means; fewer than k where there are fewer distinct rows."""
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return np.unique(centres, axis=0)


def half_bounds(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, and squared lower bounds on its distance to each centroid's cell."""
    d = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T
    own = d.argmin(axis=1)
    gap = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))[own]
    ahead = d - d[np.arange(len(x)), own][:, None]
    bound = np.divide(ahead, 2 * gap, out=np.zeros_like(ahead), where=gap > 0)
    return own, np.maximum(bound, 0) ** 2


def traverse(first: np.ndarray, second: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, i, j) of the cells whose bound first[row, i] + second[row, j] is within limit, for all rows in rising order of the bound.

    The multi-sequence traversal of many rows at once: both lists of a row are sorted, each entry of the first is met
    with the head of the second that the limit leaves, and a row's cells are put in order.
    """
    a, b = np.argsort(first, axis=1, kind="stable"), np.argsort(second, axis=1, kind="stable")
    low_a, low_b = np.take_along_axis(first, a, axis=1), np.take_along_axis(second, b, axis=1)
    found: list[tuple[np.ndarray, ...]] = []
    for k in range(low_a.shape[1]):
        rows = np.flatnonzero(low_a[:, k] + low_b[:, 0] <= limit)
        if not len(rows):
            break
        sums = low_a[rows, k, None] + low_b[rows]
        at, head = np.nonzero(sums <= limit)
        found.append((rows[at], a[rows[at], k], b[rows[at], head], sums[at, head]))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    row, i, j, bound = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((bound, row))
    return row[order], i[order], j[order]


def visits(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (vector, cell, home 0/1): each unit vector in its own cell and in the later cells that it must meet."""
    half = x.shape[1] - x.shape[1] // 2
    own_a, low_a = half_bounds(x[:, :half], books[0])
    own_b, low_b = half_bounds(x[:, half:], books[1])
    width = len(books[1])
    home = own_a * width + own_b
    rows, i, j = traverse(low_a, low_b, limit)
    cells = i * width + j
    later = cells >= home[rows]
    rows, cells = rows[later], cells[later]
    return rows, cells, (cells == home[rows]).astype(np.int8)


def near_links(rows: DataFrame, cosine: float) -> DataFrame:
    """(rep, n_links, root): for each group, the links of its representatives and a spanning star of its components.

    The group's home vectors are compared with all its others in slices; n_links counts copies, not pairs of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, ["label", "size", "cell", "lo", "hi"]):
            home = np.flatnonzero(group.column("home").to_numpy())
            n = group.num_rows
            if not len(home) or n < 2:
                continue
            x, rep, copies, part = vectors(group.column("unit")), group.column("rep").to_numpy(), group.column("copies").to_numpy(), group.column("part").to_numpy()
            is_home, across = group.column("home").to_numpy().astype(bool), group.column("lo")[0].as_py() != group.column("hi")[0].as_py()
            count, label, every = np.zeros(n, dtype=np.int64), np.arange(n), np.arange(n)
            step = max(1, 2_000_000 // n)
            for a in range(0, len(home), step):
                h = home[a : a + step]
                i, j = np.nonzero(x[h] @ x.T >= cosine)
                i = h[i]
                once = (~is_home[j] | (j > i)) & (rep[i] != rep[j])
                if across:
                    once &= part[i] != part[j]
                i, j = i[once], j[once]
                if len(i):
                    np.add.at(count, i, copies[j])
                    np.add.at(count, j, copies[i])
                    label = roots(n, np.concatenate([i, every]), np.concatenate([j, label]))
            hit = np.flatnonzero(count)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(count[hit]), pa.array(rep[label[hit]])], names=["rep", "n_links", "root"])

    keys = ["label", "size", "cell", "lo", "hi"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "rep long, n_links long, root long")


def grid_size(n: int) -> int:
    """Centroids a half: cells grow with the square root of the rows, so that a cell's rows grow as slowly."""
    return max(4, round(n**0.25))


def dedup(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of rows.

    Vectors link when their labels are equal and not null and their cosine in double precision is at least cosine.
    Null, empty and zero vectors and those with null or non-finite components link with nothing, like those of a null
    label; vectors of different lengths do not link. Labels may be of any type that has a string form. Equal vectors of a label are one class while linking; each counts the other copies as links.
    component_id is the smallest id reachable; repeated ids each keep their row, and a null id has a null component.
    Empty tables give no rows; other columns are ignored.
    """
    src = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("string").alias("label"))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & valid_vector("embedding")
    # classes of equal vectors; 0.0 + x turns -0.0 into 0.0
    keyed = src.where(usable).withColumn("key", F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0)))
    classes = save(keyed.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    limit = 2 - 2 * cosine + 1e-9
    # lengths with few vectors have one cell, so there are few codebooks
    books: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size, n in classes.groupBy(F.size("key").alias("size")).count().where(F.col("count") > GRID_FROM).collect():
        fit = classes.where(F.size("key") == size).orderBy(F.xxhash64("rep"), "rep").limit(FIT_ROWS).select("key").collect()
        fit, half, k = units(np.array([r.key for r in fit], dtype=np.float64)), size - size // 2, grid_size(n)
        books[size] = (fit_codebook(fit[:, :half], k), fit_codebook(fit[:, half:], k) if size > 1 else np.zeros((1, 0)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = whole.column("key").value_lengths().to_numpy()
            for size in np.unique(sizes).tolist():
                b = whole.take(pa.array(np.flatnonzero(sizes == size)))
                for at in range(0, b.num_rows, 2_000):
                    part = b.slice(at, 2_000)
                    x = units(vectors(part.column("key")))
                    n = np.arange(len(x))
                    i, cell, home = visits(x, books[size], limit) if size in books else (n, np.zeros_like(n), np.ones_like(n).astype(np.int8))
                    for a in range(0, len(i), 20_000):
                        s = slice(a, a + 20_000)
                        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(i[s]) + 1, dtype=np.int32) * size), pa.array(x[i[s]].ravel()))
                        of = pa.array(i[s])
                        yield pa.RecordBatch.from_arrays(
                            [part.column("label").take(of), pa.array(np.full(len(of), size, np.int32)), pa.array(cell[s]), pa.array(home[s]), part.column("rep").take(of), part.column("copies").take(of), flat],
                            names=["label", "size", "cell", "home", "rep", "copies", "unit"],
                        )

    placed = classes.mapInArrow(index, "label string, size int, cell long, home byte, rep long, copies long, unit array<double>")
    found = save(near_links(split_hot(placed, ["label", "size", "cell"], "rep", PART_ROWS), cosine), "near")
    comp = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    totals = found.groupBy("rep").agg(F.sum("n_links").alias("links"))
    # written before the join, so that the partition of a hot class can be split (spark.sql.adaptive.skewJoin)
    per_class = save(
        classes.join(totals, "rep", "left")
        .join(comp.withColumnRenamed("id", "rep"), "rep", "left")
        .select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")),
        "per_class",
    )
    linked = keyed.select("vec_id", "label", "key").join(per_class, ["label", "key"]).select("vec_id", "n_links", "component_id")
    alone = src.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE e IS NOT NULL AND label IS NOT NULL
), link AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(u, v) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u
), comp AS (SELECT u, min(v) AS c FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS k FROM link GROUP BY u)
SELECT v.vec_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_links, comp.c AS component_id, v.vec_id = comp.c AS kept
FROM v JOIN comp ON comp.u = v.vec_id LEFT JOIN n ON n.u = v.vec_id
"""
