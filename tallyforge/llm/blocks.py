"""Hot groups split into blocks that meet pairwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table of hot keys is broadcast only up to this many rows.
BROADCAST_ROWS = 50_000


def split_hot(rows: DataFrame, keys: list[str], by: str, limit: int) -> DataFrame:
    """Adds lo, hi and part: any two rows of a key meet in exactly one group (keys, lo, hi) as a cross pair.

    A key with n rows has k = ceil(n / limit) parts by hash of column by; the row of part p goes to the k groups
    (min(p, q), max(p, q)). Groups lo = hi hold pairs within a part, others pairs between two parts, so that no group
    holds more than about 2 * limit rows however hot its key is, and no pair is lost.
    """
    hot = (
        rows.groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > limit)
        .select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("k"))
    )
    few = hot.limit(BROADCAST_ROWS + 1).count()
    if not few:
        return rows.select("*", *[F.lit(0).alias(c) for c in ("lo", "hi", "part")])
    joined = rows.join(F.broadcast(hot) if few <= BROADCAST_ROWS else hot, keys, "left")
    k = F.coalesce("k", F.lit(1))
    part = F.pmod(F.xxhash64(F.col(by), F.lit(7)), k).cast("int")
    return (
        joined.withColumn("part", part)
        .withColumn("q", F.explode(F.sequence(F.lit(0), k - 1)))
        .withColumn("lo", F.least("part", "q"))
        .withColumn("hi", F.greatest("part", "q"))
        .drop("q", "k")
    )
