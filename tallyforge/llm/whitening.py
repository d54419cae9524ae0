"""Whitening of embeddings by a one-sided Jacobi SVD of centred rows.

Entries become integers x = floor(64 c) + 1000000, so that sums and deviations are exact and centring (n x - S) / n loses
nothing to cancellation. Tasks compress their centred rows block by block to an upper triangle R (TSQR), triangles are
stacked and compressed again in a tree, and plane rotations make the columns of the last R orthogonal: their lengths are
the standard deviations (times the root of n), small ones as accurate as large ones, and the accumulated rotations the
components. No covariance matrix is formed on the way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import forget, save, table, vectors

SCALE, SHIFT = 64, 1_000_000
#: Components returned of each row.
COMPONENTS = 32
#: Results of tasks that are merged by one task of the next round.
FAN_IN = 32
#: Rows of a block that is compressed at once, and numbers of one output batch.
BLOCK = 4096
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
LONGEST = 2**63 - 1


def grid(x: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 as integers; Python's own where one does not fit a long."""
    low = np.floor(np.asarray(x, dtype=np.float64) * SCALE)
    if low.size and np.abs(low).max() >= 2.0**62:
        # 64 c itself may exceed the doubles
        return np.array([[int(np.floor(v * SCALE)) if abs(v) < 1e300 else int(v) * SCALE for v in row] for row in np.asarray(x, dtype=np.float64)], dtype=object) + SHIFT
    return low.astype(np.int64) + SHIFT


def offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact."""
    if x.dtype != object and n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums), default=0) < LONGEST:
        return n * x - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def deviations(off: np.ndarray) -> list[int | None]:
    """Sums of squares of each row, exact; None where one does not fit a long."""
    top = int(np.abs(off).max(initial=0))
    if off.dtype != object and top * top * off.shape[1] < LONGEST:
        return (off * off).sum(axis=1).tolist()
    exact = (off.astype(object) ** 2).sum(axis=1).tolist()
    return [v if v <= LONGEST else None for v in exact]


def centred(off: np.ndarray, n: int) -> np.ndarray:
    return (off / n).astype(np.float64)


def triangle(*blocks: np.ndarray) -> np.ndarray:
    """R of the stacked blocks; fewer rows than columns where there are fewer rows."""
    return np.linalg.qr(np.vstack(blocks), mode="r")


def rounds(d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Disjoint pairs of columns, every pair once: the rounds of a tournament."""
    ring = list(range(d + d % 2))
    for _ in range(len(ring) - 1):
        pairs = [(min(p), max(p)) for p in zip(ring[: len(ring) // 2], ring[::-1], strict=False) if max(p) < d]
        if pairs:
            i, j = np.array(pairs).T
            yield i, j
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (columns) and singular values of r, by falling value: rotations of column pairs until all are orthogonal.

    A round rotates disjoint pairs at once; a pair is left alone once its cosine is below the doubles' precision.
    """
    d = r.shape[1]
    # a power of two keeps squares within the doubles and rounds nothing
    top = np.abs(r).max(initial=0)
    power = 2.0 ** np.floor(np.log2(top)) if top > 0 else 1.0
    r = r / power
    order = np.argsort(-np.sqrt((r * r).sum(axis=0)), kind="stable")
    a, v = r[:, order], np.eye(d)[:, order]
    for _ in range(sweeps):
        turned = False
        for i, j in rounds(d):
            x, y = a[:, i], a[:, j]
            p, q, c = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            do = np.abs(c) > 1e-15 * np.sqrt(p) * np.sqrt(q)
            if not do.any():
                continue
            turned = True
            i, j, p, q, c = i[do], j[do], p[do], q[do], c[do]
            with np.errstate(over="ignore"):  # a turn too small to matter
                zeta = (q - p) / (2 * c)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            cos = 1 / np.sqrt(1 + t * t)
            sin = cos * t
            for m in (a, v):
                left, right = m[:, i], m[:, j]
                m[:, i], m[:, j] = cos * left - sin * right, sin * left + cos * right
        if not turned:
            break
    values = np.sqrt((a * a).sum(axis=0)) * power
    order = np.argsort(-values, kind="stable")
    v = v[:, order]
    # either sign is right; the largest entry of a component is positive, so that runs agree
    v *= np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    return v, values[order]


def by_size(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(length, rows, matrix) of blocks of vectors of one length."""
    for batch in batches:
        sizes = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(sizes).tolist():
            rows = batch.take(pa.array(np.flatnonzero(sizes == size)))
            for at in range(0, rows.num_rows, BLOCK):
                part = rows.slice(at, BLOCK)
                yield size, part, vectors(part.column(column))


Payload = tuple[np.ndarray, ...]


def packed(payloads: dict[int, Payload]) -> Iterator[pa.RecordBatch]:
    """Rows (size, payload) of a task's results, one for each length of vectors."""
    for size, arrays in payloads.items():
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([pack(arrays)], pa.binary())], names=["size", "payload"])


def pack(arrays: Payload) -> bytes:
    import io

    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def unpack(payload: bytes) -> Payload:
    import io

    with np.load(io.BytesIO(payload)) as f:
        return tuple(f[k] for k in f.files)


def tree(results: DataFrame, merge: Callable[[Payload, Payload], Payload]) -> dict[int, Payload]:
    """One payload for each length, from rows (size, payload).

    About FAN_IN results of a length meet in a task, its results in the next round, so no task or driver gets them all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Payload] = {}
        for batch in batches:
            for size, payload in zip(batch.column("size").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                held[size] = merge(held[size], unpack(payload)) if size in held else unpack(payload)
        yield from packed(held)

    now = save(results, "whitening")
    while counts := now.groupBy("size").count().agg(F.max("count"), F.count("*")).head():
        most, sizes = counts
        if (most or 0) <= 1:
            break
        groups = -(-most // FAN_IN)
        keyed = now.repartition(min(groups * sizes, 4096), "size", F.pmod(F.xxhash64("payload"), F.lit(groups)))
        after = save(keyed.mapInArrow(run, "size int, payload binary"), "whitening")
        forget(now)
        now = after
    out = {r.size: unpack(bytes(r.payload)) for r in now.collect()}
    forget(now)
    return out


def usable(column: str) -> F.Column:
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & ~bad, F.lit(False))


class Fit:
    """What one length of vectors has learned: rows, sums, components (columns), their deviations and shares of the variance."""

    def __init__(self, n: int, sums: list[int], r: np.ndarray, most: int = COMPONENTS):
        v, s = jacobi(r)
        # beyond this, a deviation is what rounding has left of a component without any
        none = s <= 16 * len(sums) * np.finfo(float).eps * s.max(initial=0)
        s = np.where(none, 0, s)
        total = ((s / max(s.max(initial=0), 1e-300)) ** 2).sum()
        self.n, self.sums, self.components = n, sums, v[:, :most]
        self.deviation = s[:most] / np.sqrt(n)
        self.explained = (s[:most] / max(s.max(initial=0), 1e-300)) ** 2 / total if total else np.zeros(len(s[:most]))
        self.live = self.deviation > 0
        self.error = 0.0

    def whitened(self, off: np.ndarray) -> np.ndarray:
        """NaN for components without variance."""
        along = centred(off, self.n) @ self.components
        return np.divide(along, self.deviation, out=np.full_like(along, np.nan), where=self.live)


def merge_sums(a: Payload, b: Payload) -> Payload:
    return (a[0] + b[0], np.array([str(int(x) + int(y)) for x, y in zip(a[1], b[1], strict=True)]))


def merge_moments(a: Payload, b: Payload) -> Payload:
    """Counts, means and centred products of two sets of rows as those of both."""
    (n, p, x), (m, q, y) = a, b
    gap = q - p
    return n + m, p + gap * (m / (n + m)), x + y + np.outer(gap, gap) * (n * m / (n + m))


def fit(rows: DataFrame, most: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each length of vectors in the column embedding, over all rows: three passes (sums, triangles, products of the whitened)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Payload] = {}
        for size, _, x in by_size(batches, "embedding"):
            x = grid(x)
            if x.dtype != object and max(int(np.abs(x).max()), 1) * len(x) >= LONGEST:
                x = x.astype(object)
            mine = (np.array(len(x)), np.array([str(v) for v in x.sum(axis=0).tolist()]))
            held[size] = merge_sums(held[size], mine) if size in held else mine
        yield from packed(held)

    shape = "size int, payload binary"
    known = {size: (int(n), [int(v) for v in s]) for size, (n, s) in tree(rows.mapInArrow(sums, shape), merge_sums).items()}

    def triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for size, _, x in by_size(batches, "embedding"):
            z = centred(offsets(grid(x), *known[size]), known[size][0])
            held[size] = triangle(held[size], z) if size in held else triangle(z)
        yield from packed({k: (v,) for k, v in held.items()})

    fits = {size: Fit(*known[size], r, most) for size, (r,) in tree(rows.mapInArrow(triangles, shape), lambda a, b: (triangle(a[0], b[0]),)).items()}

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Payload] = {}
        for size, _, x in by_size(batches, "embedding"):
            f = fits[size]
            w = f.whitened(offsets(grid(x), f.n, f.sums))[:, f.live]
            mean = w.mean(axis=0)
            mine = (np.array(float(len(w))), mean, (w - mean).T @ (w - mean))
            held[size] = merge_moments(held[size], mine) if size in held else mine
        yield from packed(held)

    for size, (n, _, products) in tree(rows.mapInArrow(moments, shape), merge_moments).items():
        fits[size].error = float(np.abs(products / n - np.eye(len(products))).max(initial=0))
    return fits


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each usable vector on its first components.

    Vectors that are null, empty or hold null or non-finite entries are dropped; a zero vector stays. Each length of
    vectors is a fit of its own, with its own n. A component without variance (fewer rows than dimensions, constant or
    repeated columns, equal rows) has explained 0 and a null whitened value, and identity_error is over the others; where
    there are none it is 0. A deviation that does not fit a long is null. Repeated and null ids keep their rows; other
    columns are ignored; an empty table gives no rows. The input is read four times.
    """
    src = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where(usable("embedding"))
    fits = fit(src.select("embedding"), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, part, x in by_size(batches, "embedding"):
            f = fits[size]
            k = len(f.live)
            off = offsets(grid(x), f.n, f.sums)
            flat = f.whitened(off).ravel()
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(flat), f.n)), pa.array(deviations(off), pa.int64()).take(each),
                    pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(f.explained, len(x))), pa.array(np.full(len(flat), f.error)),
                ],
                names=[c.split()[0] for c in RESULT.split(", ")],
            )

    return src.mapInArrow(run, RESULT)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
