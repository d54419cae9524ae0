import re
from collections import Counter

import corpus_pipeline
from tallyforge.llm import lang_id, secret_scan, sp_codec
from tests.llm.test_simhash import brute

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stages_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [n for n, _ in corpus_pipeline.STAGES] and len(stages) == 5

    kept = stages["language ID"](spark, docs, sf_dir).cache()
    pred = {r.doc_id: r.lang_pred for r in lang_id.op5_lang_id(spark, sf_dir).collect()}
    assert {r[0] for r in rows_of(kept)} == {i for i, p in pred.items() if p != "und"}
    assert kept.count() >= 0.98 * docs.count() and kept.columns == docs.columns

    one = stages["SimHash near-dedup"](spark, kept, sf_dir).cache()
    groups = brute([(r[0], r[1]) for r in rows_of(kept)])
    assert sorted(r[0] for r in rows_of(one)) == sorted({c for _, c in groups.values()})

    clean = stages["secret scans"](spark, one, sf_dir).cache()
    before, after = {r[0]: r[1] for r in rows_of(one)}, {r[0]: r[1] for r in rows_of(clean)}
    assert before.keys() == after.keys()
    hexes = r'token = "[0-9a-f]{40}"'
    assert {i: re.sub(hexes, f'token = "{secret_scan.MASK}"', t) for i, t in before.items()} == after
    assert all(r[4] == len(r[1]) for r in rows_of(clean))

    mixed = stages["mixing sources"](spark, clean, sf_dir).cache()
    times = Counter(r[0] for r in rows_of(mixed))
    assert times.keys() == after.keys() and max(times.values()) <= 5

    coded = stages["SentencePiece encoding"](spark, mixed, sf_dir).cache()
    assert Counter(r.doc_id for r in coded.collect()) == times
    assert coded.where("not parity").count() == 0
    back = {r.doc_id: r.text for r in sp_codec.decode(coded, sp_codec.default_model()).collect()}
    assert back == after


def test_odd_rows_pass_every_stage(spark, sf_dir):
    words = "the cat and the dog of that is with to"
    rows = [(i, f"{words} number {i} " + "plain words of the report that we find " * (i % 5 + 1), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(i, "der hund und die katze nicht mit dem ein " * (i % 3 + 1) + str(i), "de", None, 1) for i in range(40, 60)]
    rows += [(100, None, None, None, None), (101, "", "en", "", 0), (None, words, "en", "s1", 3), (None, words, "en", "s1", 3), (None, "other " + words * 3, None, "s1", 3), (5, "repeat " + words, "en", "s0", 1)]
    docs = spark.createDataFrame(rows, SHAPE).repartition(3)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        docs.count()
    got = Counter(r.doc_id for r in docs.collect())
    assert 100 not in got and 101 not in got and got[None] >= 2
    empty = spark.createDataFrame([], SHAPE)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0


def test_run_is_registered(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, sf_dir).where("n_ids > 0").count() > 100


def test_junk_and_foreign_texts_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    junk = [
        "xqzt vbnk wrtp lkjh gfds zxcv mnbv qqqq wwkk", "asdfghjkl qwertyuiop zxcvbnm", "zzzz zzzz zzzz", "kjhg 8734 xx %%% fjf kdkd q",
        "Привет, как дела, это русский текст о погоде и природе", "これは日本語の文章です。今日は天気がいい",
        "hvala lijepo, danas je vrijeme vrlo lijepo i idemo na more", "to jest polski tekst o pogodzie i przyrodzie w naszym kraju",
    ]
    planted = spark.createDataFrame([(10**9 + i, t, None, "junk", len(t)) for i, t in enumerate(junk)], SHAPE)
    kept = [r[0] for r in rows_of(corpus_pipeline.language_id(spark, docs.unionByName(planted), ""))]
    assert not [i for i in kept if i >= 10**9]
    # no document with letters goes
    assert len(kept) >= 0.998 * docs.where(docs.text.rlike(r"\p{L}")).count()


def test_rows_that_repeat_an_id_are_judged_by_their_texts(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma"))
    rows = [(3, a), (5, a), (5, b), (7, b), (5, c), (5, c), (None, a), (None, c + " more words of its own " * 20)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SHAPE)
    assert sorted((r[0] or 0, r[1]) for r in rows_of(corpus_pipeline.near_dedup(spark, docs, ""))) == sorted([(3, a), (5, b), (5, c), (0, rows[-1][1])])
