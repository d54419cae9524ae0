import math

import numpy as np
import pytest

from tallyforge.llm import hash_search, multi_index
from tests.llm.helpers import UnionFind

SHAPE = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute_links(rows, cosine=0.98):
    uf, n = UnionFind(), {}
    for i, (a, va, la) in enumerate(rows):
        uf.find(a)
        n.setdefault(a, 0)
        for b, vb, lb in rows[:i]:
            if la is None or la != lb or not usable(va) or not usable(vb) or len(va) != len(vb):
                continue
            x, y = np.array(va, float), np.array(vb, float)
            if x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                uf.union(a, b)
                n[a] += 1
                n[b] += 1
    return {a: (n[a], uf.find(a), uf.find(a) == a) for a, _, _ in rows}


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def clustered(seed, groups, size, dim, noise):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, size))):
            rows.append((centre + noise * rng.normal(size=dim) * np.linalg.norm(centre) / math.sqrt(dim), g % 3))
    rng.shuffle(rows)
    return [(i, [float(np.float32(x)) for x in v], c) for i, (v, c) in enumerate(rows)]


@pytest.mark.parametrize("noise", [0.05, 0.1, 0.14])
def test_links_match_brute_force(spark, noise, monkeypatch):
    rows = clustered(1, 60, 14, 9, noise)
    df = spark.createDataFrame(rows, SHAPE)
    want = brute_links(rows)
    assert sum(n for n, _, _ in want.values()) > 100
    assert got(multi_index.dedup(df)) == want
    monkeypatch.setattr(multi_index, "PART_ROWS", 5)
    assert got(multi_index.dedup(df)) == want


def test_link_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(9, [1.0, 0.0], 1), (4, [2.0, 0.0], 1), (5, [1.0, 0.0], 2), (6, [1.0, 0.0], None), (7, None, 1), (8, [0.0, 0.0], 1), (10, [nan, 1.0], 1),
            (11, [inf, 1.0], 1), (12, [None, 1.0], 1), (13, [], 1), (14, [1.0, -0.0], 1), (15, [1.0, 0.0], 1), (16, [1e-30, 0.0], 1), (17, [-1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], SHAPE + ", cell int, rep int")
    assert got(multi_index.dedup(df)) == brute_links(rows)
    assert multi_index.dedup(df.limit(0)).count() == 0
    assert multi_index.dedup(df.where("vec_id in (7, 8)")).count() == 2


def test_traversal_is_ordered_and_whole():
    rng = np.random.default_rng(0)
    a, b = rng.random((5, 9)), rng.random((5, 7))
    row, i, j = multi_index.traverse(a, b, 1.1)
    sums = a[row, i] + b[row, j]
    assert list(zip(row, sums, strict=True)) == sorted(zip(row, sums, strict=True))
    assert set(zip(row, i, j, strict=True)) == {(n, i, j) for n in range(5) for i in range(9) for j in range(7) if a[n, i] + b[n, j] <= 1.1}
    assert all(len(x) == 0 for x in multi_index.traverse(a, b, -1))


def test_links_of_all_lengths_and_text_labels(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "GRID_FROM", 100)
    rows = [(i, v, f"label {c}") for i, v, c in clustered(3, 30, 12, 9, 0.1)]
    n = len(rows)
    rows += [(n + i, v, f"label {c}") for i, v, c in clustered(4, 12, 8, 5, 0.1)] + [(5000, [1.0], "a"), (5001, [2.0], "a"), (5002, [2.0], "b"), (5003, [-2.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    want = brute_links(rows)
    assert want[5000][:2] == (1, 5000) and want[5002][0] == 0
    assert got(multi_index.dedup(df)) == want


def brute_nearest(rows, query, k=10):
    q = np.array(dict((i, v) for i, v, _ in rows)[query], float)
    d = sorted((math.sqrt(((np.array(v, float) - q) ** 2).sum()), i) for i, v, _ in rows if i != query and usable(v) and len(v) == len(q))
    return [(i, s) for s, i in d[:k]]


def test_search_recall(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(hash_search, "BLOCK_ROWS", 120)
    monkeypatch.setattr(hash_search, "QUERY_ROWS", 2)
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    found = {}
    for r in hash_search.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    hits = 0
    for q, near in found.items():
        assert [r for _, _, r in near] == list(range(1, 11))
        assert [(s, i) for i, s, _ in near] == sorted((s, i) for i, s, _ in near)
        hits += len({i for i, _, _ in near} & {i for i, _ in brute_nearest(rows, q)})
    assert len(found) == 25 and hits >= 0.9 * 250


def test_search_edges(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (3, None, 1), (4, [0.0, 0.0], 1), (100, [0.0, 1.0], 1), (200, None, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SHAPE + ", block int")
    out = [(r.query_id, r.rank, r.vec_id) for r in hash_search.search(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 1), (100, 2, 2), (100, 3, 0)]
    assert hash_search.search(df.limit(0), df).count() == 0


def test_search_of_all_lengths(spark, monkeypatch):
    monkeypatch.setattr(hash_search, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6 if i % 5 else 3)], 0) for i in range(300)] + [(301, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found, hits = {}, 0
    for r in hash_search.search(df, df.where("vec_id % 7 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q, near in found.items():
        want = {i for i, _ in brute_nearest(rows, q)}
        assert len(near) == len(want) == 10
        hits += len(near & want)
    assert set(found) == set(range(0, 300, 7)) and hits >= 0.9 * 10 * len(found)


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (400, 5), dtype=np.uint8)
    index = hash_search.Block(codes)
    for r in range(0, 41, 3):
        want = np.flatnonzero(np.bitwise_count(codes ^ codes[0]).sum(axis=1) <= r)
        assert np.array_equal(index.within(codes[0], r), want)
