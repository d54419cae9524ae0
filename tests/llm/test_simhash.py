import random

import numpy as np
import xxhash

from tallyforge.llm import blocks, simhash
from tallyforge.llm.graph import components
from tests.llm.helpers import UnionFind, words


def plain_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = {}
    uf = UnionFind()
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    for i, (d, f) in enumerate(prints):
        uf.find(d)
        for e, g in prints[:i]:
            if (f ^ g).bit_count() <= 3:
                uf.union(d, e)
        fps[d] = f
    return {d: (f"{f:016x}", uf.find(d)) for d, f in fps.items()}


def result(df):
    from pyspark.sql import functions as F

    got = df.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("f"), "component_id").collect()
    return {r.doc_id: (r.f, r.component_id) for r in got}


def test_documents_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert result(simhash.dedup(docs)) == want


def test_edges_nulls_and_clashing_columns(spark):
    text = "one two three four five six seven"
    rows = [(5, text), (3, text.upper()), (9, ""), (8, None), (7, " \t\n"), (1, "lone"), (2, "two words"), (4, "é " * 30000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, component string")
    got = result(simhash.dedup(docs))
    assert got == brute(rows)
    assert got[8] == ("0" * 16, 7)
    assert simhash.dedup(docs.limit(0)).count() == 0


def test_hot_anchors_lose_no_link(spark, monkeypatch):
    rng = random.Random(3)
    centre, fps = rng.getrandbits(64), set()
    while len(fps) < 300:
        x = centre
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    signed = [int(np.array([x], dtype="<u8").view("<i8")[0]) for x in sorted(fps)]
    rows = simhash.replicate(spark.createDataFrame([(x,) for x in signed], "fp long"), simhash.code_blocks(len(signed)))
    edges = simhash.links(blocks.split_hot(rows, ["anchor"], "fp", 40))
    got = {r.id: r.component for r in components(edges).collect()}
    uf = UnionFind()
    for i, x in enumerate(signed):
        for y in signed[:i]:
            if ((x ^ y) & (2**64 - 1)).bit_count() <= 3:
                uf.union(x, y)
    want = {x: uf.find(x) for x in signed}
    assert {x: got.get(x, x) for x in signed} == want


def test_code_covers_every_close_pair():
    rng = np.random.default_rng(1)
    for n in (1, 5000, 10**6, 10**9):
        lengths = simhash.code_blocks(n)
        assert sum(lengths) == 64 and all(x % 2 for x in lengths)
        x = rng.integers(-(2**63), 2**63 - 1, 200, dtype=np.int64)
        y = x.copy()
        for _ in range(3):
            y ^= np.left_shift(np.int64(1), rng.integers(0, 64, 200))
        i, anchor, home = simhash.anchors_of(np.concatenate([x, y]), lengths)
        at, homes = [set() for _ in range(400)], [0] * 400
        for k, a, h in zip(i, anchor, home):
            at[k].add(a)
            if h:
                homes[k] = a
        assert all(homes[k] in at[k + 200] or homes[k + 200] in at[k] for k in range(200))


def test_long_chain_of_links(spark):
    rng = random.Random(5)
    ids = list(range(200))
    rng.shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (7, 7), (None, 3)], "u long, v long")
    assert {r.component for r in components(edges).collect()} == {0}
