"""Temperature mixing of sources to target weights.

Weights are token shares raised to an exponent and normalised. The exponent is bisected between 0 (equal weights) and
1 (the shares) to the largest that reaches a target entropy, then raised where a source would repeat more often than
allowed. Each source's quota of the token budget is then dealt from seeded permutations of its documents, one for each
epoch, into blocks that each hold every source at its weight.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import forget, save, table

#: Steps of an interval of exponents that one job looks at.
GRID = 32
#: Tokens of a bucket, the group in which documents of a source and epoch are ranked.
BUCKET_TOKENS = 1 << 20
#: Buckets of a run; tokens before a bucket are those of the runs before plus those of its own run.
RUN_BUCKETS = 4096
#: Bits of monotonically_increasing_id() that count rows of a partition.
ROW_BITS = 33
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    alpha: float
    budget: int
    weights: dict[str, float]
    quotas: dict[str, int]


def tempered(shares: list[float], alpha: float) -> list[float]:
    top = max(shares)
    raw = [(s / top) ** alpha for s in shares]
    total = sum(raw)
    return [r / total for r in raw]


def entropy(weights: list[float]) -> float:
    return -sum(w * log(w) for w in weights if w > 0)


def bisect(holds, low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    """The end of [low, high] where holds turns, from below: holds(low side) is false, holds(high side) true."""
    if holds(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def whole_budget(tokens: list[int], weights: list[float]) -> float:
    """The least budget at which every source is used at least once."""
    return max(t / w for t, w in zip(tokens, weights, strict=True))


def solve(totals: dict[str, int], target_entropy: float | None = 0.95, max_repeats: float | None = 4.0, budget: int | None = None) -> Mix:
    """Exponent, weights and quotas for sources with the given token totals (each at least 1), for a few sources held in memory.

    target_entropy is a share of the entropy of equal weights; shares that have more already are kept. max_repeats
    bounds quota over total for every source. Without a budget it is the least that uses every document once. If no
    exponent up to 1 keeps the limit, the budget itself is too large and a ValueError says so.
    """
    if not totals:
        return Mix(1.0, 0, {}, {})
    names = sorted(totals)
    tokens = [totals[n] for n in names]
    shares = [t / sum(tokens) for t in tokens]

    def repeats(alpha: float) -> float:
        w = tempered(shares, alpha)
        b = budget if budget is not None else whole_budget(tokens, w)
        return max(b * x / t for x, t in zip(w, tokens, strict=True))

    alpha = 1.0
    if target_entropy is not None and len(names) > 1:
        goal = target_entropy * log(len(names))
        # entropy falls as the exponent rises: the last exponent that still reaches the goal
        alpha = 1.0 if entropy(shares) >= goal else bisect(lambda a: entropy(tempered(shares, a)) < goal)
    if max_repeats is not None and repeats(alpha) > max_repeats:
        if repeats(1.0) > max_repeats * (1 + 1e-12):
            raise ValueError("the budget repeats every source more often than max_repeats allows")
        alpha = bisect(lambda a: repeats(a) <= max_repeats, alpha, 1.0)
    weights = tempered(shares, alpha)
    b = budget if budget is not None else round(whole_budget(tokens, weights))
    quotas = {n: round(b * w) for n, w in zip(names, weights, strict=True)}
    if budget is None:
        quotas = {n: max(q, totals[n]) for n, q in quotas.items()}
    return Mix(alpha, b, dict(zip(names, weights, strict=True)), quotas)


def solve_sums(totals: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: int | None) -> tuple[int, DataFrame]:
    """The budget of solve(), and (source, weight, quota, total) of each source, for any number of sources in totals (source, total).

    Entropy and repeats of an exponent follow from two sums over the sources and from their least and largest totals;
    one job gives the sums for GRID exponents, of which the two about the turning point are the next job's ends.
    """
    low_t, top, n = totals.agg(F.min("total"), F.max("total"), F.count("*")).head()
    if not n:
        return 0, totals.select("source", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"), "total")
    log_t = F.log(F.col("total") / F.lit(float(top)))

    def sums(alphas: list[float]) -> list[tuple[float, float]]:
        row = totals.agg(*[f for a in alphas for f in (F.sum(F.exp(log_t * a)), F.sum(F.exp(log_t * a) * log_t))]).head()
        return [(row[2 * i], row[2 * i + 1]) for i in range(len(alphas))]

    def entropy_of(a: float, z: float, s: float) -> float:
        return log(z) - a * s / z

    def repeats(a: float, z: float, s: float) -> float:
        return (budget / z if budget is not None else top) * (low_t / top) ** a / low_t

    def turn(holds, low: float) -> float:
        high = 1.0
        for _ in range(12):
            grid = [low + (high - low) * k / GRID for k in range(GRID + 1)]
            first = next((k for k, (a, x) in enumerate(zip(grid, sums(grid), strict=True)) if holds(a, *x)), GRID)
            if first == 0:
                return grid[0]
            low, high = grid[first - 1], grid[first]
        return high

    alpha = 1.0
    if target_entropy is not None and n > 1:
        goal = target_entropy * log(n)
        if entropy_of(1.0, *sums([1.0])[0]) < goal:
            alpha = turn(lambda a, z, s: entropy_of(a, z, s) < goal, 0.0)
    if max_repeats is not None and repeats(alpha, *sums([alpha])[0]) > max_repeats:
        if repeats(1.0, *sums([1.0])[0]) > max_repeats * (1 + 1e-12):
            raise ValueError("the budget repeats every source more often than max_repeats allows")
        alpha = turn(lambda a, z, s: repeats(a, z, s) <= max_repeats, alpha)
    z = sums([alpha])[0][0]
    b = budget if budget is not None else round(z * top)
    weight = F.exp(log_t * alpha) / z
    quota = F.rint(weight * b).cast("long")
    return b, totals.select("source", weight.alias("weight"), (quota if budget is not None else F.greatest(quota, "total")).alias("quota"), "total")


def source_key(column: str) -> Column:
    """Null is a source of its own, apart from the empty string."""
    return F.when(F.col(column).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(column).cast("string")))


def token_count(column: str) -> Column:
    """Words and one end; a null text has the end alone."""
    return (F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)) + 1).cast("long")


def numbered(ids: DataFrame) -> DataFrame:
    """ids (row_no, id_hash, ...) with copy: 0, 1, ... among the rows of equal id_hash.

    Rows are counted for each hash and written partition first and then ranked within the partition, so that no task
    holds a hash that very many rows share.
    """
    ids = ids.withColumn("part", F.shiftright("row_no", ROW_BITS))
    per = ids.groupBy("id_hash", "part").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("id_hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("id_hash", "part", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    rank = F.row_number().over(Window.partitionBy("id_hash", "part").orderBy("row_no")) - 1
    return ids.join(per, ["id_hash", "part"]).withColumn("copy", F.col("earlier") + rank).drop("part", "earlier")


def before_buckets(held: DataFrame) -> DataFrame:
    """held (source, epoch, bucket, held) with before, the tokens of all smaller buckets of the source and epoch, in place of held."""
    upto = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("run", F.floor(F.col("bucket") / RUN_BUCKETS))
    runs = held.groupBy("source", "epoch", "run").agg(F.sum("held").alias("run_held"))
    runs = runs.withColumn("run_before", F.coalesce(F.sum("run_held").over(upto(["source", "epoch"], "run")), F.lit(0))).drop("run_held")
    inside = held.withColumn("inside", F.coalesce(F.sum("held").over(upto(["source", "epoch", "run"], "bucket")), F.lit(0)))
    return inside.join(runs, ["source", "epoch", "run"]).select("source", "epoch", "bucket", (F.col("run_before") + F.col("inside")).alias("before"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = 0.95, max_repeats: float | None = 4.0,
    budget: int | None = None, block_tokens: int = 1 << 20, seed: int = 17, columns: list[str] | None = None,
) -> DataFrame:
    """docs (of its columns those named, else all) as a mixed stream, with mix_tokens, mix_weight, mix_epoch, mix_block and mix_order added.

    A row appears once for each epoch in which its source's quota reaches it; the stream is sorted by mix_block and
    mix_order. A source's tokens differ from its quota by less than one document, and each block's by less than two.
    Without a budget no row is dropped. Rows are written once with a number; places are found for numbers alone, by
    prefix sums over hashed buckets of bounded size, so a source with most rows is never gathered in one task, and each
    row is then shuffled once, whatever its number of epochs. Repeated rows are documents of their own and have places
    of their own; empty tables give no rows; columns named like the added ones are replaced, others are kept.
    """
    added = ["mix_tokens", "mix_weight", "mix_epoch", "mix_block", "mix_order"]
    kept = [c for c in (columns or docs.columns) if c not in added]
    rows = save(
        docs.select(
            F.struct(*kept).alias("row"), source_key(source_col).alias("source"), token_count(text_col).alias("tokens"),
            F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("id_hash"), F.monotonically_increasing_id().alias("row_no"),
        ),
        "rows",
    )
    ids = save(numbered(rows.select("row_no", "id_hash", "source", "tokens")), "ids")
    sums = save(rows.groupBy("source").agg(F.sum("tokens").alias("total")), "totals")
    whole, plan = solve_sums(sums, target_entropy, max_repeats, budget)
    sources = save(plan, "sources")
    turn = F.when(F.col("copy") == 0, F.xxhash64("id_hash", "epoch", F.lit(seed))).otherwise(F.xxhash64("id_hash", "epoch", F.lit(seed), "copy"))
    copies = (
        ids.join(sources, "source")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / F.col("total")))))
        .where("quota > 0")
        .withColumn("turn", F.shiftrightunsigned(turn, 11))
        .withColumn("bucket", F.floor((F.col("turn") / F.lit(float(1 << 53))) * F.ceil(F.col("total") / BUCKET_TOKENS)))
    )
    groups = ["source", "epoch", "bucket"]
    before = before_buckets(copies.groupBy(*groups).agg(F.sum("tokens").alias("held")))
    order = Window.partitionBy(*groups).orderBy("turn", "id_hash", "copy").rowsBetween(Window.unboundedPreceding, -1)
    n_blocks = max(1, -(-whole // block_tokens))
    placed = (
        copies.withColumn("inside", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
        .join(before, groups)
        .withColumn("at", F.col("epoch") * F.col("total") + F.col("before") + F.col("inside"))
        .where("at < quota")
        .select(
            "row_no", F.col("weight").alias("mix_weight"), F.col("epoch").alias("mix_epoch"), F.floor(F.col("at") / F.col("quota") * n_blocks).alias("mix_block"),
            F.xxhash64("turn", "id_hash", F.lit(seed + 1)).alias("mix_order"),
        )
    )
    placed = save(placed, "placed")
    for done in (ids, sums, sources):
        forget(done)
    return rows.select("row", F.col("tokens").alias("mix_tokens"), "row_no").join(placed, "row_no").select("row.*", *added)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over all documents: entropy 0.95 of equal weights, at most four repeats, no document left out."""
    return mix(table(spark, sf_dir, "documents"), columns=["doc_id", "source"]).select("doc_id", "source", "mix_tokens", "mix_weight", "mix_epoch", "mix_block", "mix_order")
