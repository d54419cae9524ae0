from collections import Counter
from itertools import permutations

import duckdb

from tallyforge.llm import filter_audit


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(docs, labels):
    """(part, order, step) -> counts, with each order applied to each document one by one."""
    fails = []
    for doc_id, text, source in docs:
        t, w = text or "", words(text)
        f, mine = set(), [l for l in labels if l[0] is not None]
        if len(w) < 50:
            f.add("A")
        if 100 * len(set(w)) < 65 * len(w):
            f.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t):
            f.add("C")
        if set(t) & set("#$%&*|"):
            f.add("D")
        if doc_id is not None and any(o is not None and o < doc_id and (x or "") == t for o, x, _ in docs):
            f.add("E")
        fails.append((source or "", f, any(l[0] == doc_id and l[1] == 1 for l in mine), any(l[0] == doc_id and l[2] == 1 for l in mine)))
    out, shapley = {}, Counter()
    for part in {f[0] for f in fails}:
        for order in permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            for step, c in enumerate(order, 1):
                gone = [f for f in left if c in f[1]]
                n_fail = sum(1 for f in fails if f[0] == part and c in f[1])
                left = [f for f in left if c not in f[1]]
                shapley[part, c] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), n_fail - len(gone), sum(1 for f in fails if f[0] == part and f[1] == {c}), sum(f[2] for f in gone), sum(f[3] for f in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


LONG = " ".join(f"w{i}" for i in range(60))
DOCS = [
    (1, LONG, "a"), (2, LONG, "b"), (3, LONG, "a"), (4, None, None), (5, "", "a"), (6, "  \t\n", None), (7, "x " * 80, "b"), (8, LONG.upper(), "b"), (9, LONG + " 5%", "a"), (9, LONG + " 5%", "a"), (None, LONG, "a"),
    (None, None, None), (10, "a b c " * 60, "a"), (11, "É" * 30 + " A", ""), (12, "word " * 400_000, "c"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, None), (7, None, 1), (8, 1, 1), (None, 1, 1), (99, 1, 1)]


def tables(spark, docs=DOCS, labels=LABELS):
    d = spark.createDataFrame([(*r, 1, "z", 0) for r in docs], "doc_id long, text string, source string, mask int, part string, first int")
    return d, spark.createDataFrame([(*r, "k") for r in labels], "doc_id long, quality int, toxic int, good string")


def test_edges_match_every_order_applied_one_by_one(spark):
    assert result(filter_audit.audit(filter_audit.masks(*tables(spark)))) == plain(DOCS, LABELS)


def test_empty_tables(spark):
    docs, labels = tables(spark)
    assert filter_audit.audit(filter_audit.masks(docs.limit(0), labels)).count() == 0
    got = result(filter_audit.audit(filter_audit.masks(docs, labels.limit(0))))
    assert got == plain(DOCS, [])


def test_many_parts(spark):
    docs = [(i, LONG if i % 3 else "short", f"s{i % 700}") for i in range(1400)]
    got = result(filter_audit.audit(filter_audit.masks(*tables(spark, docs))))
    assert len(got) == 700 * 600
    sample = [d for d in docs if d[2] in ("s0", "s1")]
    # E looks at the whole table: all but the first of each text fail it
    assert got["s0", "EABCD", 1][:2] == (1, 1) and got["s1", "EABCD", 1][:2] == (1, 1) and len(sample) == 4


def test_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    names = [c.split()[0] for c in filter_audit.COUNTS.split(", ")]
    want = {r[:3]: r[3:] for r in con.execute(f"SELECT {', '.join(names)} FROM ({filter_audit.OP12_SQL})").fetchall()}
    assert result(filter_audit.op12_filter_audit(spark, sf_dir)) == want
