import re
from collections import Counter, defaultdict
from math import log

import pytest

from tallyforge.llm import mixing


def test_exponent_meets_entropy_and_limit():
    totals = {"a": 9000, "b": 900, "c": 90}
    m = mixing.solve(totals, 0.8, None)
    assert mixing.entropy(list(m.weights.values())) == pytest.approx(0.8 * log(3))
    assert all(m.quotas[s] >= t for s, t in totals.items())
    m = mixing.solve(totals, 0.999, 4.0)
    assert max(m.quotas[s] / t for s, t in totals.items()) == pytest.approx(4, rel=0.02)
    assert mixing.solve({"a": 5, "b": 5}, 0.9).alpha == 1.0
    with pytest.raises(ValueError):
        mixing.solve(totals, 0.8, 2.0, budget=30_000)
    assert mixing.solve({"a": 7}, 0.9).quotas == {"a": 7}


def make(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), s) for i, s in enumerate(["hot"] * 600 + ["mid"] * 120 + ["few"] * 12 + [None] * 6 + [""] * 5)]
    rows += [(9, "w " * 24, "hot"), (None, "w", "mid"), (800, None, "few"), (801, "", "few"), (802, "w " * 3000, "hot")]
    return rows, spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, epoch int, mix_block int")


@pytest.mark.parametrize("budget", [None, 9000])
def test_stream_meets_quotas(spark, budget, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_TOKENS", 700)
    rows, docs = make(spark)
    got = mixing.mix(docs, target_entropy=0.85, max_repeats=3, budget=budget, block_tokens=1000).collect()
    size = [(s, len(re.findall(r"\S+", t or "")) + 1) for _, t, s in rows]
    totals = defaultdict(int)
    for s, n in size:
        totals["null" if s is None else "=" + s] += n
    plan = mixing.solve(dict(totals), 0.85, 3, budget)
    sums, longest = defaultdict(int), 3001
    for r in got:
        sums["null" if r.source is None else "=" + r.source] += r.mix_tokens
    for s, q in plan.quotas.items():
        assert q <= sums[s] < q + longest
    assert all(len(r) == len(docs.columns) + 4 for r in got)
    ids = Counter(r.doc_id for r in got)
    if budget is None:
        assert set(ids) == {i for i, _, _ in rows}
    seen = Counter((r.doc_id, r.source, r.mix_epoch, r.mix_tokens) for r in got)
    assert seen.pop((9, "hot", 0, 25), 2) <= 2 and max(seen.values()) == 1  # that row is given twice
    by_block = defaultdict(int)
    for r in got:
        by_block[r.mix_block, r.source] += r.mix_tokens
    n = -(-plan.budget // 1000)
    for b in range(n):
        assert abs(by_block[b, "mid"] - plan.quotas["=mid"] / n) < 100


def test_epochs_are_whole_permutations(spark):
    rows, docs = make(spark)
    got = mixing.mix(docs, target_entropy=0.85, max_repeats=3).where("source = 'few'").collect()
    last = max(r.mix_epoch for r in got)
    per = [[r.doc_id for r in sorted(got, key=lambda r: r.mix_order) if r.mix_epoch == e] for e in range(last)]
    assert last >= 1 and all(sorted(p) == sorted(per[0]) for p in per) and (last < 2 or per[0] != per[1])
    assert mixing.mix(docs.limit(0)).count() == 0


def test_every_document_is_in_the_query(spark, sf_dir):
    got = mixing.op2_mixing(spark, sf_dir)
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


@pytest.mark.parametrize("target, limit, budget", [(0.9, 4.0, None), (0.9, None, None), (None, 1.5, None), (0.2, 4.0, None), (0.97, 2.0, None), (0.9, 50.0, 5000)])
def test_sums_give_what_totals_give(spark, target, limit, budget):
    totals = {f"s{i}": 3 + i * i * i for i in range(40)}
    plan = mixing.solve(totals, target, limit, budget)
    whole, table = mixing.solve_sums(spark.createDataFrame(list(totals.items()), "source string, total long"), target, limit, budget)
    assert whole == pytest.approx(plan.budget, rel=1e-6)
    for r in table.collect():
        assert r.weight == pytest.approx(plan.weights[r.source], rel=1e-6) and abs(r.quota - plan.quotas[r.source]) <= 1


def test_repeated_rows_have_places_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_TOKENS", 50)
    monkeypatch.setattr(mixing, "RUN_BUCKETS", 3)
    rows = [(None, "w w w", "a")] * 300 + [(i, "w w", "b") for i in range(60)] + [(7, None, None)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mixing.mix(docs, target_entropy=0.9, max_repeats=3, block_tokens=200).collect()
    plan = mixing.solve({"=a": 1200, "=b": 180, "null": 20}, 0.9, 3)
    sums = Counter()
    for r in got:
        sums["null" if r.source is None else "=" + r.source] += r.mix_tokens
    for s, q in plan.quotas.items():
        assert q <= sums[s] < q + 4
    first = Counter(r.source for r in got if r.mix_epoch == 0)
    assert first == {"a": 300, "b": 60, None: 20}
    per_block = Counter(r.mix_block for r in got if r.source == "a")
    n = max(1, -(-plan.budget // 200))
    assert all(abs(4 * per_block[b] - plan.quotas["=a"] / n) < 8 for b in range(n))
    once = sorted((str(r.doc_id), r.mix_epoch, r.mix_block, r.mix_order) for r in got)
    again = mixing.mix(docs.repartition(3), target_entropy=0.9, max_repeats=3, block_tokens=200).collect()
    assert once == sorted((str(r.doc_id), r.mix_epoch, r.mix_block, r.mix_order) for r in again)
