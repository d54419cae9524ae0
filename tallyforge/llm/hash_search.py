"""Nearest neighbours by multi-index hashing.

Codes are signs of centred vectors under a learned rotation (principal axes, then iterative quantisation). A block of
the index keeps an inverted list for each value of each code substring. By the pigeonhole principle a code within
Hamming radius r of a query is within r // m of it in one of the first r % m + 1 of m substrings, or within
r // m - 1 in another, so probing those lists finds every code within r; their floats are then reranked.
The radius is measured on the fit sample; queries for which it finds fewer than k rows ask again with the largest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import by_key, save, table, valid_vector, vectors

#: The rotation and radius are learned from at most this many vectors, those with the smallest hashes of their ids.
FIT_ROWS = 4096
#: Rows of a block and of a part of the queries at most, on the average; a pair of them is one group.
BLOCK_ROWS = 65_536
QUERY_ROWS = 16_384


class Codes:
    """A learned rotation to binary codes with substrings of eight bits, and the radius that finds most neighbours."""

    def __init__(self, fit: np.ndarray, k: int, found: float = 0.985, rounds: int = 20, seed: int = 0):
        self.shift = fit.max(axis=0) / 2 + fit.min(axis=0) / 2
        self.scale = np.abs(fit - self.shift).max() or 1.0
        x = (fit - self.shift) / self.scale
        mean = x.mean(axis=0)
        self.shift = self.shift + mean * self.scale
        x = x - mean
        size = x.shape[1]
        _, _, axes = np.linalg.svd(x, full_matrices=True) if len(x) < size else np.linalg.svd(x.T @ x)
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))[0]
        for _ in range(rounds):
            z = x @ axes.T @ turn
            u, _, w = np.linalg.svd(np.where(z >= 0, 1.0, -1.0).T @ (x @ axes.T))
            turn = (u @ w).T
        self.turn = axes.T @ turn
        self.bits = size
        self.radius = self._radius(fit, k, found)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """(rows, substrings) bytes; the last substring is padded with zeros."""
        return np.packbits((x - self.shift) / self.scale @ self.turn >= 0, axis=1)

    def _radius(self, fit: np.ndarray, k: int, found: float) -> int:
        probe = fit[:256]
        z, q = (fit - self.shift) / self.scale, (probe - self.shift) / self.scale
        d = (q * q).sum(axis=1)[:, None] + (z * z).sum(axis=1) - 2 * q @ z.T
        d[np.arange(len(probe)), np.arange(len(probe))] = np.inf
        near = np.argsort(d, axis=1)[:, : min(k, max(1, len(fit) - 1))]
        codes = self(fit)
        ham = np.bitwise_count(codes[: len(probe), None] ^ codes[near]).sum(axis=2)
        return int(np.ceil(np.quantile(ham, found)))


class Block:
    """Inverted lists of one block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable").T
        self.starts = np.stack([np.searchsorted(c[o], np.arange(257)) for c, o in zip(codes.T, self.order, strict=True)])
        values = np.arange(256, dtype=np.uint8)
        self.apart = np.bitwise_count(values[:, None] ^ values[None, :])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is within radius, by probing the substrings' lists."""
        m = len(code)
        each, more = divmod(radius, m)
        hit = np.zeros(len(self.codes), dtype=bool)
        for s in range(m):
            near = each if s <= more else each - 1
            if near >= 0:
                starts, order = self.starts[s], self.order[s]
                for v in np.flatnonzero(self.apart[code[s]] <= near):
                    hit[order[starts[v] : starts[v + 1]]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


def distance(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of one vector to rows, summed in order of the components in double precision."""
    d = x - q
    return np.sqrt((d * d).sum(axis=1))


def search(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, found: float = 0.985) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest rows of rows found, without its own id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids; vectors meet
    those of their own length only. Fewer than k candidates are all returned; ties go to the smaller id; rows that
    repeat an id or a vector stay candidates, each with a rank of its own; a query id that repeats asks once for each
    length, with its smallest vector of that length, and keeps the k nearest of all. Empty tables give no rows; other
    columns are ignored.

    Every block of the index meets every part of the queries once, as codes and floats together: a row of the index is
    sent once for each QUERY_ROWS queries, a query once for each block. The radius is that of the fit sample; queries
    for which it holds fewer than k rows in all ask again with the whole radius, alone.
    """
    spark = rows.sparkSession
    shape = "query_id long, rank int, vec_id long, score double"

    def usable(df: DataFrame) -> DataFrame:
        out = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
        return out.where(F.col("vec_id").isNotNull() & valid_vector("embedding")).withColumn("size", F.size("embedding"))

    src, ask = usable(rows), usable(queries)
    ask = save(ask.groupBy("vec_id", "size").agg(F.min("embedding").alias("embedding")), "asked")
    counts = {r["size"]: r["count"] for r in src.groupBy("size").count().collect()}
    asks = {r["size"]: r["count"] for r in ask.groupBy("size").count().collect() if r["size"] in counts}
    if not asks:
        return spark.createDataFrame([], shape)
    models: dict[int, Codes] = {}
    for size in asks:
        fit = src.where(F.col("size") == size).orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("embedding").collect()
        models[size] = Codes(np.array([r.embedding for r in fit], dtype=np.float64), k, found)
    # blocks are large, as their number times that of the queries' parts is sent, but each core has one at least
    tasks = max(1, spark.sparkContext.defaultParallelism)
    blocks = {size: -(-counts[size] // min(BLOCK_ROWS, max(1024, counts[size] // (2 * tasks)))) for size in asks}
    parts = {size: -(-n // QUERY_ROWS) for size, n in asks.items()}

    def number(of: dict[int, int]):
        return F.element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), F.col("size"))

    def nearest(asked: DataFrame, whole: bool) -> DataFrame:
        index_rows = src.where(F.col("size").isin(list(asks))).select(
            "size", F.pmod(F.xxhash64("vec_id"), number(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), number(parts) - 1)).alias("part"), F.lit(0).cast("byte").alias("asked"), "vec_id", "embedding"
        )
        ask_rows = asked.where(F.col("size").isin(list(asks))).select(
            "size", F.explode(F.sequence(F.lit(0), number(blocks) - 1)).alias("block"), F.pmod(F.xxhash64("vec_id"), number(parts)).cast("int").alias("part"), F.lit(1).cast("byte").alias("asked"), "vec_id", "embedding"
        )
        n_tasks = sum(blocks[size] * parts[size] for size in asks)
        both = index_rows.unionByName(ask_rows).repartition(n_tasks, "size", "block", "part").sortWithinPartitions("size", "block", "part")

        def in_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in by_key(batches, ["size", "block", "part"]):
                codes = models[group.column("size")[0].as_py()]
                asked = group.column("asked").to_numpy()
                x, ids = vectors(group.column("embedding")), group.column("vec_id").to_numpy()
                q, q_ids = x[asked == 1].astype(np.float64), ids[asked == 1]
                x, ids = x[asked == 0].astype(np.float64), ids[asked == 0]
                if not len(q) or not len(x):
                    continue
                index, q_codes, radius = Block(codes(x)), codes(q), codes.bits if whole else codes.radius
                out: list[tuple[np.ndarray, ...]] = []
                for v, code, me in zip(q, q_codes, q_ids, strict=True):
                    near = index.within(code, radius)
                    near = near[ids[near] != me]
                    d = distance(v, x[near])
                    best = np.lexsort((ids[near], d))[:k]
                    out.append((np.full(len(best), me), ids[near][best], d[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

        return save(both.mapInArrow(in_block, "query_id long, vec_id long, score double"), "best")

    best = nearest(ask, False)
    # where the radius holds fewer than k rows, all rows are asked for
    few = best.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    again = save(ask.join(few, "vec_id", "left_anti"), "again")
    if again.limit(1).count():
        more = nearest(again, True)
        best = best.join(again.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(more)
    # the blocks hold at most k rows a query each
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_hash_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 100 = 0"))
