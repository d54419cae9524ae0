"""Connected components by alternating large and small stars, with every round kept in a shared table."""

# A vertex with very many edges is a hot key of the joins below. Both of a join's sides are scans of written tables, so
# that adaptive execution can split the hot partition and send its one minimum to every piece.

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.blocks import BROADCAST_ROWS
from tallyforge.llm.common import forget, save


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
    return tuple(row)


def _minima(minima: DataFrame, n_edges: int) -> DataFrame:
    return save(minima, "minima") if n_edges > BROADCAST_ROWS else minima


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of edges (u long, v long); component is the smallest id reachable.

    Large stars link each larger neighbour of u to the smallest id around u; small stars do it for the smaller ones.
    Both only join edges with per-vertex minima, which are broadcast where they are few and else written before the
    join, so that a hub's edges are split among tasks (spark.sql.adaptive.skewJoin). The rounds grow with the logarithm
    of the longest path and end when no edge changes. Self-links, repeated edges and null ends are allowed (null ends go).
    """
    now = save(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _minima(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), mark[0])
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = save(large, "large")
        low = _minima(large.groupBy("u").agg(F.min("v").alias("m")), mark[0])
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = save(small, "small")
        for done in (large, now, least, low):
            forget(done)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return stars.select(F.col("u").alias("id"), "component").unionByName(roots)
