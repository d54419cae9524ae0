import random
import re

import duckdb
import numpy as np
import pytest

from tallyforge.llm import license_scan

NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction, including ..."


def plain_words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain(text, templates, phrases, containment):
    """Places of phrases and (template, block start) by trying every template on every block."""
    w = plain_words(text)
    places = sorted((i, label) for p, label in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    met = {}
    for t, ((_, wording), width) in enumerate(zip(templates, license_scan.widths(templates), strict=True)):
        own = set(plain_words(wording))
        for b in range(0, len(w), width):
            share = len(own & set(w[b : b + 2 * width])) / len(own)
            if share >= containment - 1e-12:
                met[t, b, width] = share
    sets = [set(plain_words(x)) for _, x in templates]
    return len(w), places, {(t, b): s for (t, b, wide), s in met.items() if not any(sets[t] < sets[o] and b == c and wide == v for o, c, v in met)}


def rows_of(df):
    return {
        r.doc_id: (r.n_words, sorted((p.word, p.label) for p in r.places), {(m.template, m.begin): m.containment for m in r.found})
        for r in df.collect()
    }


@pytest.mark.parametrize("containment", [0.5, 0.7, 0.95, 1.0])
def test_join_finds_all_that_brute_force_finds(spark, containment):
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(30)]
    templates = [(f"l{k % 9}", " ".join(rng.choice(pool) for _ in range(rng.choice([1, 2, 3, 5, 9, 20, 40])))) for k in range(25)]
    phrases = [("w1 w2", "p"), ("w1 w1", "q"), ("w3", "r")]
    texts = [(i, " ".join(rng.choice(pool + ["other", "és"] * rng.choice([0, 10, 60])) for _ in range(rng.choice([0, 1, 7, 60, 300])))) for i in range(60)]
    got = rows_of(license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string"), templates, phrases, containment))
    assert got == {i: plain(t, templates, phrases, containment) for i, t in texts}


def test_edges(spark):
    texts = [
        (1, None), (2, ""), (3, " \n.,"), (4, "Released under the MIT License."), (5, "under the mit license, under\nTHE MIT license"), (6, "Apache-License; version 2"), (7, "cc by nc CC-BY-NC"), (8, MIT),
        (9, "This work is licensed under the GNU General Public License, version 3."), (10, "licensed under the GNU Lesser General Public License version 3"), (11, "the mit under license"), (12, "undér the mit license"),
        (13, "filler words here " * 600_000 + "Licensed under CC BY-NC-SA 4.0"), (14, "x" * 9_000_000 + " cc by nc"), (4, "ünder the mit license"), (None, "cc by nc"),
    ]
    df = spark.createDataFrame([(*t, 1, "z", "w") for t in texts], "doc_id long, text string, n_words int, label string, found string")
    got = license_scan.scan(df).collect()
    by = {(r.doc_id, r.n_words): r for r in got}
    assert len(got) == len(texts) and sum(r.doc_id == 4 for r in got) == 2
    labels = lambda r: sorted({m.label for m in r.found})
    for (i, t), r in ((k, by[k[0], len(plain_words(k[1]))]) for k in texts):
        n, places, found = plain(t, license_scan.NOTICES, license_scan.PHRASES, license_scan.CONTAINMENT)
        assert (n, places, found) == (r.n_words, sorted((p.word, p.label) for p in r.places), {(m.template, m.begin): m.containment for m in r.found}), i
    assert labels(by[9, 12]) == ["gpl-3"] and labels(by[10, 10]) == ["lgpl-3"] and labels(by[8, len(plain_words(MIT))]) == ["mit"] and labels(by[11, 4]) == []
    assert labels(by[13, 1_800_008]) == ["cc-by-nc-sa"] and [p.word for p in by[5, 8].places] == [0, 4] and [p.word for p in by[7, 6].places] == [0, 3]
    assert license_scan.scan(df.limit(0)).count() == 0
    assert all(r.found == [] for r in license_scan.scan(df.limit(5), templates=[("none", " .,")], phrases=[]).collect())
    with pytest.raises(ValueError, match="bytes"):
        license_scan.scan(df, templates=[("big", "a" * 33_000_000)])


def test_filters_prune_and_keep():
    index = license_scan.Index([("a", "rare common other"), ("b", "common")], [], {b"common": 50, b"other": 9, b"rare": 1}, 1.0)
    assert [w.decode() for w in index.number] == ["rare", "other", "common"]
    # a template that has to be held whole is looked up by its rarest word alone
    assert {w: list(p) for w, p in index.postings.items()} == {8: [0, 2]}
    assert index.found(np.array([2, 1, -1], dtype=np.int32)) == [{"label": "b", "template": 1, "begin": 0, "end": 3, "containment": 1.0}]
    assert [m["label"] for m in index.found(np.array([2, 1, 0], dtype=np.int32))] == ["a"]


def test_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(NAMES)} FROM ({license_scan.OP11_SQL}) ORDER BY doc_id").fetchall()
    got = license_scan.op11_license_scan(spark, sf_dir).select(*NAMES).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want
    assert any(r.labels for r in got)
