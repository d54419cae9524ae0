import numpy as np

from tallyforge.llm import lang_id


def plain_presence(text):
    kept = []
    for c in (text or "").lower():
        c = c if c.isalpha() else " "
        if c != " " or not kept or kept[-1] != " ":
            kept.append(c)
    s = " " + "".join(kept).strip(" ") + " "
    return {s[i : i + k] for k in lang_id.ORDERS for i in range(len(s) - k + 1)}


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = lang_id.op5_lang_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_kernel_counts_common_ngrams():
    texts = ["The cat sat, on the mat!", "le chat est là", "a", "über 12 straße"]
    rows = np.stack([lang_id.presence(t) for t in texts])
    sets = [plain_presence(t) for t in texts]
    for i, a in enumerate(sets):
        assert abs(rows[i].sum() - len(a)) <= 1
        for j, b in enumerate(sets):
            assert abs((rows[i] & rows[j]).sum() - len(a & b)) <= 1


def test_edges(spark):
    rows = [(i, ("the cat and the dog of that" if i % 2 else "der hund und die katze nicht"), "en" if i % 2 else "de") for i in range(1, 40)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !? \n", None), (103, "THE DOG", None), (None, "the", "en"), (104, "und die " * 50000, None), (1, "the cat and the dog of that", "en")]
    docs = spark.createDataFrame([(*r, 1.0, "zz") for r in rows], "doc_id long, text string, lang string, score double, bits string")
    model = lang_id.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.predict(docs, model).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[103][0] == "en" and got[104][0] == "de" and got[None][0] == "en"
    assert lang_id.predict(docs, model).count() == len(rows)
    nothing = lang_id.fit(docs.where("lang is null"))
    assert nothing is None and {r.lang_pred for r in lang_id.predict(docs, nothing).collect()} == {"und"}
    assert lang_id.predict(docs.limit(0), lang_id.fit(docs.limit(0))).count() == 0
