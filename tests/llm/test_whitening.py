import math
from collections import defaultdict

import numpy as np
import pytest

from tallyforge.llm import whitening

SHAPE = "vec_id long, embedding array<double>, n int, component string, size int, payload string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, "y") for i, v in rows], SHAPE)


def plain(rows, most=32):
    """id -> (deviation, components' eigenvalues), by an eigendecomposition of the exact covariance of each length."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for size in {len(v) for _, v in good}:
        mine = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in good if len(v) == size]
        n, sums = len(mine), [sum(x[d] for _, x in mine) for d in range(size)]
        off = np.array([[n * x[d] - sums[d] for d in range(size)] for _, x in mine], dtype=object)
        z = (off / n).astype(np.longdouble)
        cov = np.array((z.T @ z) / n, dtype=np.float64)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values)
        out[size] = n, [i for i, _ in mine], (off**2).sum(axis=1), np.asarray(z, dtype=np.float64), values[order], vectors[:, order], np.trace(cov)
    return out


def check(rows, got, most=32, tolerance=1e-6):
    by = defaultdict(list)
    for r in got:
        by[r.vec_id, r.n].append(r)
    for size, (n, ids, deviation, z, values, vectors, trace) in plain(rows).items():
        k = min(most, size)
        live = [c for c in range(k) if values[c] > 1e-12 * values[0] and values[0] > 0]
        errors = {r.identity_error for r in got if r.n == n}
        assert len(errors) == 1 and errors.pop() <= 1e-4
        whitened = np.full((n, k), np.nan)
        for row, i in enumerate(ids):
            mine = sorted(by[i, n], key=lambda r: r.component)
            assert [r.component for r in mine] == list(range(1, k + 1))
            for r in mine:
                assert r.deviation == deviation[row]
                c = r.component - 1
                if c in live:
                    assert abs(r.explained - values[c] / trace) <= 1e-4 * values[c] / trace
                    whitened[row, c] = r.whitened
                else:
                    assert r.whitened is None and r.explained == 0
        if live:
            w = whitened[:, live]
            assert np.abs(np.cov(w.T, bias=True).reshape(len(live), -1) - np.eye(len(live))).max() < 1e-6
            # the span of well separated components agrees with the eigenvectors, up to sign
            for c in live:
                others = np.delete(values, c)
                if not len(others) or np.abs(others - values[c]).min() > 1e-3 * values[c]:
                    want = z @ vectors[:, c] / math.sqrt(values[c])
                    assert min(np.abs(want - w[:, live.index(c)]).max(), np.abs(want + w[:, live.index(c)]).max()) < tolerance * max(1, np.abs(want).max())


def test_table_matches_eigendecomposition(spark, sf_dir):
    src = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in src.select("vec_id", "embedding").collect()]
    check(rows, whitening.op13_whitening(spark, sf_dir).collect())


def test_small_deviations_beside_large_ones(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)) * np.array([3e3, 2e2, 9, 1, 0.3, 0.1])
    x[:, 1] += x[:, 0] * 0.5
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    check(rows, whitening.whiten(frame(spark, rows).repartition(7)).collect(), tolerance=1e-5)


def test_edges(spark):
    rng = np.random.default_rng(1)
    base = [(i, rng.normal(size=5).tolist()) for i in range(30)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [float("nan")] * 5), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    rows = base + odd + [(105, [0.0] * 5)] + [(200 + i, [float(i % 3), 1.0]) for i in range(7)] + [(300, [4.0, 4.0, 4.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert not {r.vec_id for r in got} & {i for i, _ in odd}
    check([r for r in rows if r[0] not in {100, 101}], got)
    assert {(r.n, r.whitened, r.explained, r.identity_error, r.deviation) for r in got if r.vec_id == 300} == {(1, None, 0.0, 0.0, 0)}
    assert whitening.whiten(frame(spark, rows).limit(0)).count() == 0


def test_repeated_and_null_ids_keep_their_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.0, 5.0]), (None, [3.0, 1.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert sorted(str((r.vec_id, r.component)) for r in got) == sorted(str((i, c)) for i, _ in rows for c in (1, 2))
    assert all(r.n == 4 for r in got)


def test_numbers_beyond_long(spark):
    rows = [(i, [1e17 * i, float(i)]) for i in range(5)] + [(9, [1e306, 0.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    x = {i: [int(np.floor(64 * c)) + 1000000 if c < 1e300 else int(c) * 64 + 1000000 for c in v] for i, v in rows}
    sums = [sum(v[d] for v in x.values()) for d in range(2)]
    for r in got:
        exact = sum((6 * x[r.vec_id][d] - sums[d]) ** 2 for d in range(2))
        assert r.deviation == (exact if exact < 2**63 else None)


@pytest.mark.parametrize("shape", [(1, 1), (3, 7), (40, 9), (64, 64)])
def test_jacobi_is_the_svd(shape):
    r = np.random.default_rng(2).normal(size=shape)
    v, s = whitening.jacobi(r)
    want = np.linalg.svd(r, compute_uv=False)
    assert np.allclose(s[: len(want)], want, rtol=1e-12) and np.allclose(s[len(want) :], 0, atol=1e-12)
    assert np.allclose(v.T @ v, np.eye(shape[1]), atol=1e-13)


def test_every_pair_of_columns_meets_once():
    for d in (1, 2, 5, 8):
        met = [tuple(p) for i, j in whitening.rounds(d) for p in zip(i.tolist(), j.tolist(), strict=True)]
        assert sorted(met) == [(a, b) for a in range(d) for b in range(a + 1, d)]


def test_many_tasks_are_merged_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(90)]
    check(rows, whitening.whiten(frame(spark, rows).repartition(20)).collect())
