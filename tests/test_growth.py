"""What a step costs as its table grows: partitions follow rows, pages are read once and in time that follows their glyphs."""

import contextlib
import io

import pytest

from tallyforge import plans
from tallyforge.operators import layout
from tallyforge.sources import adapters

GLYPH = "doc_id long, page_index int, glyph_seq long, x double, y double, w double, scale double, s string"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


class Counted(dict):
    """A glyph that counts how often it is looked at."""

    seen = 0

    def __getitem__(self, key):
        Counted.seen += 1
        return super().__getitem__(key)


@pytest.mark.parametrize("name", ["f02_f03_presentations", "f04_session_summary", "a03_column_cuts", "a03_column_buckets", "a_page_texts"])
def test_partitions_follow_rows_and_no_later_shuffle_undoes_it(spark, sf_dir, monkeypatch, name):
    rows = adapters.table(spark, sf_dir, "lineitem").count()
    monkeypatch.setattr(adapters, "TASK_ROWS", 300)
    n = -(-rows // 300)
    text = plan(plans.QUERIES[name](spark, sf_dir))
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all(f", {n})" in line for line in exchanges), exchanges


def test_rows_are_the_same_in_many_partitions(spark, sf_dir, monkeypatch):
    for name in ("f04_session_summary", "a03_column_buckets", "a_page_texts"):
        few = sorted(map(tuple, plans.QUERIES[name](spark, sf_dir).collect()))
        monkeypatch.setattr(adapters, "TASK_ROWS", 300)
        assert few and sorted(map(tuple, plans.QUERIES[name](spark, sf_dir).collect())) == few
        monkeypatch.undo()


def test_column_cuts_read_their_glyphs_once(spark, sf_dir):
    glyphs = spark.read.schema(GLYPH).parquet(_written(spark))
    assert plan(layout.column_cuts(glyphs)).count("FileScan") == 1


def _written(spark):
    import tempfile

    at = tempfile.mkdtemp(prefix="glyphs-") + "/t"
    spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 1.0, 8.0, "x")], GLYPH).write.parquet(at)
    return at


@pytest.mark.parametrize("step", ["lines", "powers", "fractions"])
def test_work_of_a_page_follows_its_glyphs(step):
    n = 2000
    # one below the other, with small glyphs that have no base and a bracket that is no fraction
    g = [Counted(x=10.0, y=30.0 * (n - i), w=5.0, scale=12.0 if i % 2 else 6.0, s="(a" if i % 3 else "b", col=0) for i in range(n)]
    Counted.seen = 0
    {"lines": layout._lines, "powers": lambda x: layout._superscripts(x, 12.0), "fractions": layout._fractions}[step](g)
    assert Counted.seen < 60 * n


def test_texts_without_a_shuffle_are_those_of_the_lines(spark):
    rows = []
    for page in range(6):
        for k in range(60):
            rows.append((page, 1, k, float(k % 2 * 300 + k % 7), 700.0 - 14 * (k // 4) - k % 3 * 0.5, 40.0, float(6 + k % 4), f"{k % 9}x + {k} = {page}"))
    df = spark.createDataFrame(rows, GLYPH)
    want = {r.doc_id: r.text for r in layout.page_texts(layout.assemble(df)).collect()}
    got = layout.assemble_texts(df)
    assert {r.doc_id: r.text for r in got.collect()} == want and len(want) == 6 and any("\n\n" in t for t in want.values())
    assert "Exchange" not in plan(got).split("MapInArrow")[0]


def test_powers_go_to_the_nearest_base_and_build_towers():
    atom = lambda x, y, s, scale=12.0, w=6.0: {"x": x, "y": y, "w": w, "scale": scale, "s": s}
    # 11.9 is in a band of its own, 12.1 in the next one; the power of either is in a third
    got = layout._superscripts([atom(0.0, 11.9, "a"), atom(6.5, 16.7, "2", 7.0, 3.0), atom(10.0, 20.0, "3", 6.0, 3.0), atom(40.0, 12.1, "b"), atom(46.5, 24.0, "n", 7.0)], 12.0)
    assert [x["s"] for x in got] == ["a^2^3", "b^n"]
    assert all(set(x) == {"x", "y", "w", "scale", "s"} for x in got)
