import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import lm_score
from tallyforge.llm.common import doc_split
from tallyforge.llm.sp_codec import default_model
from tests.llm.helpers import words


def base(rows):
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    c, ends = Counter(), 0
    for i, t in rows:
        if not held[i]:
            c.update(words(t))
            ends += 1
    total, distinct = sum(c.values()) + ends, len(c) + (ends > 0)
    out = []
    for i, t in rows:
        w = words(t)
        s = sum(log10((c[x] + 1) / (total + distinct + 1)) for x in w) + log10((ends + 1) / (total + distinct + 1))
        out.append((i, held[i], len(w) + 1, sum(c[x] > 0 for x in w) + (ends > 0), total, pytest.approx(s, rel=1e-9)))
    return sorted(out, key=str)


def plain(rows):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=lambda r: str(r[:5]))


def test_documents(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = lm_score.op1_lm_score(spark, sf_dir).collect()
    want = base([(r.doc_id, r.text) for r in docs.collect()])
    assert plain(got) == sorted(want, key=lambda r: str(r[:5]))
    monkeypatch.setattr(lm_score, "RATES", ())
    prior = lm_score.op1_lm_score(spark, sf_dir).where("held_out").agg({"score": "sum"}).head()[0]
    assert sum(r.score for r in got if r.held_out) > 0.99 * prior


def test_edges(spark):
    rows = [(1, "The cat  sat\ton the mat"), (2, None), (3, ""), (None, "A cat"), (5, "die KATZE " * 20_000), (5, "die KATZE " * 20_000), (8, " nbsp É"), (17, "unseen wordsonly"), (18, "x")]
    docs = spark.createDataFrame([(*r, True, 1) for r in rows], "doc_id long, text string, held_out boolean, bucket int")
    out = doc_split("doc_id", 7) == 2
    got = lm_score.score_documents(docs, default_model(), out).collect()
    assert plain(got) == sorted(base(rows), key=lambda r: str(r[:5]))
    assert all(r.score < 0 and np.isfinite(r.score) for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[2] == by[3]
    none = lm_score.score_documents(docs, default_model(), F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and np.isfinite(r.score) for r in none)
    assert lm_score.score_documents(docs.limit(0), default_model(), out).count() == 0


def small_model():
    rng = np.random.default_rng(1)
    size = 5000
    first = np.arange(size) % 3 == 0
    model = lm_score.Attention({i: 4000 - i for i in range(3000)}, 20, first)
    for whole in (True, False):
        adam = lm_score.Adam(model, 0.05, whole)
        for inputs, target, _ in model.windows(model.number[rng.integers(0, size, 400)], np.array([250, 150]), 0, 4):
            adam.step(inputs, target)
    return model, rng


def dense(model, seq):
    """Probabilities of every number and of the end after a sequence, from all its inputs in the window."""
    p = {k: v.astype(float) for k, v in model.params.items()}
    t = len(seq) - 1
    start = max(0, t // lm_score.STRIDE * lm_score.STRIDE - lm_score.CONTEXT)
    h = p["embed"][seq[start:]]
    s = np.clip(h @ p["key"], -4, 4) @ np.clip(h[-1] @ p["query"], -4, 4) / lm_score.WIDTH**0.5 + p["near"][t - np.arange(start, t + 1)]
    a = np.exp(s) / np.exp(s).sum()
    z = np.tanh(h[-1] @ p["last"] + a @ (h @ p["value"]) @ p["mixed"] + p["shift"])
    top = np.exp(z @ p["out"] + p["bias"])
    top /= top.sum()
    inner = np.exp(np.einsum("w,gwi->gi", z, p["inner"]) + p["inner_bias"])
    inner /= inner.sum(axis=1, keepdims=True)
    ids = top[model.top]
    grouped = model.group >= 0
    ids[grouped] *= inner[model.group[grouped], model.slot[grouped]]
    return ids


def test_windows_score_each_position_once_with_masked_attention():
    model, rng = small_model()
    stride = lm_score.STRIDE
    lengths = np.array([0, 1, stride - 1, stride, stride + 1, 150])
    raw = rng.integers(0, 5000, lengths.sum())
    ids = model.number[raw]
    owner, lp = (np.concatenate(x) for x in zip(*model.positions(ids, lengths, model.tables(), batch=3), strict=True))
    assert np.array_equal(owner, np.repeat(np.arange(len(lengths)), lengths + 1))
    unseen = {kind: ((np.arange(3000, 5000) % 3 == 0) == kind).sum() for kind in (True, False)}
    k = at = 0
    for n in lengths:
        doc, names = ids[at : at + n], raw[at : at + n]
        at += n
        seq = [model.start, *doc]
        for t in range(n + 1):
            every = dense(model, seq[: t + 1])
            assert every.sum() == pytest.approx(1, abs=1e-3)
            want = every[-1] if t == n else every[doc[t]] if names[t] < 3000 else every[doc[t]] / unseen[bool(names[t] % 3 == 0)]
            assert np.exp(lp[k]) == pytest.approx(want, rel=2e-3)
            k += 1
    got = model.score(ids, lengths, model.tables())
    assert got == pytest.approx(np.bincount(owner, weights=lp) / np.log(10), rel=1e-6)


def test_every_id_has_an_embedding_and_an_output_of_its_own():
    model, _ = small_model()
    assert len(set(model.number[:3000])) == 3000 and set(model.number[3000:]) == {3000, 3001}
    assert len({*zip(model.top[:3000], model.group[:3000], model.slot[:3000], strict=True)}) == 3000
    assert model.params["embed"].shape[0] == 3003


def test_gradients_match_differences():
    model, rng = small_model()
    ids, lengths = model.number[rng.integers(0, 5000, 70)], np.array([40, 30])
    model.params = {k: v.astype(float) for k, v in model.params.items()}
    [(inputs, target, _)] = model.windows(ids, lengths, lm_score.CONTEXT, 100)

    def loss():
        lp = np.concatenate([x for _, x in model.positions(ids, lengths, model.tables())])
        goal = target.ravel()[target.ravel() != lm_score.NONE]
        return -(lp - model.within[goal]).mean()

    g = model.gradients(inputs, target)
    for k, x in model.gradients(inputs, target, model.tables()).items():
        assert np.allclose(x[1] if isinstance(x, tuple) else x, g[k][1] if isinstance(g[k], tuple) else g[k])
    assert set(g) == set(model.shapes)
    assert set(model.gradients(inputs, target, model.tables())) == set(model.HEAD)
    for name, p in model.params.items():
        rows, d = g[name] if isinstance(g[name], tuple) else (np.arange(len(p)), g[name])
        full = np.zeros(p.shape)
        full[rows] = d
        at = np.unravel_index(np.abs(full).argmax(), p.shape)
        old = p[at]
        p[at] = old + 1e-3
        up = loss()
        p[at] = old - 1e-3
        down = loss()
        p[at] = old
        assert (up - down) / 2e-3 == pytest.approx(full[at], rel=0.03)


def test_rounds_share_every_block():
    size = lm_score.BLOCK_WORDS
    for n in (0, 1, size, size + 1, 4 * size):
        text = [b"w%d" % i for i in range(n)]
        found = [b for whole in (True, False) for b in lm_score.blocks(text, whole)]
        assert sorted(w for words, _ in found for w in words) == sorted(text)
        assert [words for words, last in found if last] == [text[max(0, (n - 1) // size * size) :]]
    # as many blocks are learned from as there are, whatever their first words
    assert sum(len(list(lm_score.blocks([b"a%d" % i] * size, whole))) for i in range(200) for whole in (True, False)) == 200


def test_training_learns_where_texts_end(spark):
    texts = spark.createDataFrame([(b"the cat sat on mat %d" % (i % 50),) for i in range(1600)], "text binary").repartition(2)
    subwords = lm_score.Subwords(default_model())
    ids = np.array([i for w in subwords([b"the", b"cat", b"sat", b"on", b"mat", b"7"]) for i in w])
    model = lm_score.Attention({int(i): 1600 for i in ids}, 1600, subwords.first())
    ids = model.number[ids]

    def end():
        return np.concatenate([x for _, x in model.positions(ids, np.array([len(ids)]), model.tables())])[-1]

    prior = end()
    for k in range(len(lm_score.RATES)):
        model.load(lm_score.train_round(texts, default_model(), model, k))
    assert end() > prior + 0.1


def test_blocks_of_every_round_train_all_parameters(spark):
    text = b" ".join(b"the cat sat on mat %d" % (i % 50) for i in range(200))
    subwords = lm_score.Subwords(default_model())
    ids = {i for w in subwords(text.split()) for i in w}
    for k in range(len(lm_score.RATES)):
        model = lm_score.Attention(dict.fromkeys(range(200), 200) | dict.fromkeys(ids, 100), 1, subwords.first())
        before = {n: p.copy() for n, p in model.params.items()}
        model.load(lm_score.train_round(spark.createDataFrame([(text,)], "text binary"), default_model(), model, k))
        assert [n for n, p in model.params.items() if np.array_equal(p, before[n])] == []


def test_long_texts_have_buckets_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 4000)
    rows = [(i, "x" * (3000 if 40 <= i < 60 else 100)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = lm_score.bucketed(df, "doc_id", "text", F.lit(False)).groupBy("bucket").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in out) == 200 and max(r.b for r in out) <= 4000


def test_one_pass_gives_the_words_of_buckets_and_their_counts(spark, tmp_path):
    # long texts, which have buckets of their own, lie between short ones in every batch
    rows = [(i, "a long text " * 500 if i % 5 == 4 else f"the cat {i % 3} sat THE") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    src = lm_score.bucketed(spark.read.parquet(f"{tmp_path}/docs"), "doc_id", "text", F.col("doc_id") % 3 == 2)
    bucket = {r.doc_id: r.bucket for r in src.collect()}
    want = Counter()
    for i, t in rows:
        for w in words(t):
            want[bucket[i], w] += i % 3 != 2
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [((r.bucket, r.word), r.c) for r in lm_score.bucket_words(src).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(set(bucket.values())) > 1 and any(c == 0 for _, c in got)
    assert sorted(got) == sorted((k if isinstance(k[1], bytes) else (k[0], k[1].encode()), c) for k, c in want.items())


def test_words_that_are_no_utf8_have_ids_as_replaced():
    subwords = lm_score.Subwords(default_model())
    some = [b"cat", b"\xff\xfecat", "É".encode(), b"\xc3"]
    assert subwords(some) == subwords.plain.encode([w.decode("utf-8", "replace") for w in some]) and subwords([]) == []
    numbers = lm_score.WordNumbers(subwords, np.arange(subwords.plain.get_piece_size()))
    for words_ in (some[:2], some, some[::-1]):
        ids, n = numbers.numbers(numbers.at(words_))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == subwords(words_)
