import re

import pytest

from tallyforge.llm import secret_scan


@pytest.fixture(scope="module")
def model(spark):
    return secret_scan.train(secret_scan.labelled_findings(spark))


def test_forest_on_held_out_findings(spark, model):
    rows = secret_scan.labelled_findings(spark, 12_000)
    seen = secret_scan.labelled_findings(spark).select("candidate", "before")
    new = rows.join(seen, ["candidate", "before"], "left_anti")
    scored = model.transform(secret_scan.assembler().transform(secret_scan.with_features(new))).select("label", "prediction").collect()
    assert len(scored) > 4000 and sum(r.label == r.prediction for r in scored) >= 0.97 * len(scored)


def test_candidates_match_plain_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {(r.doc_id, m.start(), m.end(), m.group()) for r in docs.collect() for m in re.finditer(secret_scan.CANDIDATE, r.text)}
    got = {(r.doc_id, r.begin, r.end, r.candidate) for r in secret_scan.candidates(docs).collect()}
    assert got == want and want


def test_planted_secrets_are_found_and_other_values_stay(spark, model):
    value = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(1, f'é los token = "{value}"### 4785380592391139$$$ de', "a"), (2, None, "a"), (3, "", None), (4, f"commit {value} by", "a"), (5, "wör " * 50_000 + f'secret = "{value}"', None),
            (None, f'token = "{value}" token = "{value[::-1]}"', "b"), (1, f'é los token = "{value}"### 4785380592391139$$$ de', "a"), (7, value, ""), (8, "plain words only", "x")]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, source string, begin int, score string")
    got = sorted(((r.doc_id, r.begin, r.candidate) for r in secret_scan.scan(docs, model).where("is_secret").collect()), key=str)
    want = [(i, t.index(v), v) for i, t, _ in rows if i not in (4, 7) and t for v in (value, value[::-1]) if v in t]
    assert got == sorted(want, key=str)
    clean = sorted(((r.doc_id, r.text) for r in secret_scan.redact(docs, model).collect()), key=str)
    assert clean == sorted(((i, t if i in (4, 7) or t is None else t.replace(value, secret_scan.MASK).replace(value[::-1], secret_scan.MASK)) for i, t, _ in rows), key=str)
    assert secret_scan.redact(docs, model).columns == docs.columns
    assert secret_scan.scan(docs.limit(0), model).count() == 0


def test_every_token_of_the_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {(r.doc_id, m.start(1)) for r in docs.collect() for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text)}
    got = {(r.doc_id, r.begin) for r in secret_scan.scan(docs, model).where("is_secret").collect()}
    assert want <= got and len(got) <= len(want) + 2


def test_assigned_values_are_found_without_their_names(spark, model):
    hexes, mixed = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff71aa0c55d1e8842b6f9037ce", "Ab3dK9xQz7LmP2vRt5Wy8NcE4fGh6Jk1sUoIbTaV"
    lines = [(f"export API_TOKEN={hexes}", hexes), (f"secret={mixed}", mixed), (f"the secret={mixed}== of", f"{mixed}=="), (f"clientSecretToken={mixed}", mixed),
             ('password = "hunter2pass99"', "hunter2pass99"), ("password = 'tr0ub4dor&3horsebatter'", "tr0ub4dor&3horsebatter"), ('{"secret": "k7Qp!x9Zt2Lw"}', "k7Qp!x9Zt2Lw")]
    docs = spark.createDataFrame([(i, t, "a") for i, (t, _) in enumerate(lines)], "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.begin, r.candidate) for r in secret_scan.scan(docs, model).where("is_secret").collect())
    assert got == [(i, t.index(v), v) for i, (t, v) in enumerate(lines)]
    assert {r.doc_id: r.text for r in secret_scan.redact(docs, model).collect()} == {i: t.replace(v, secret_scan.MASK) for i, (t, v) in enumerate(lines)}
