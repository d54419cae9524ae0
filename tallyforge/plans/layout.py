"""Queries over positioned glyphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import layout as L
from tallyforge.sources.adapters import CARDS, cards, spread, table


def _glyphs(s, d):
    """Pages of up to some hundred glyphs in two columns: 50 decks a page, one glyph a card."""
    deck = cards(s, d)
    text = F.when(F.col("part") % 11 == 0, F.lit("Name: ann")).when(F.col("part") % 13 == 0, F.lit("- 4 -")).otherwise(F.col("question"))
    glyphs = deck.select(
        F.floor(F.col("deck_id") / 50).cast("long").alias("doc_id"), F.lit(1).alias("page_index"), F.col("card_id").alias("glyph_seq"), ((F.col("part") % 2) * 300 + F.col("b")).cast("double").alias("x"),
        (700 - (F.col("deck_id") % 50) * 14 - F.col("number") * 0.5).cast("double").alias("y"), (F.col("a") * 8 + 20).cast("double").alias("w"), (F.col("part") % 4 + 6).cast("double").alias("scale"), text.alias("s"),
    )
    return spread(glyphs, table(s, d, "lineitem").count(), "doc_id")


GLYPHS = f"""{CARDS}, glyphs AS (SELECT deck_id // 50 AS doc_id, card_id AS glyph_seq, CAST(part % 2 * 300 + b AS DOUBLE) AS x, CAST(700 - (deck_id % 50) * 14 AS DOUBLE) - CAST(number AS DOUBLE) * CAST(0.5 AS DOUBLE) AS y,
  CAST(a * 8 + 20 AS DOUBLE) AS w, CAST(part % 4 + 6 AS DOUBLE) AS scale, CASE WHEN part % 11 = 0 THEN 'Name: ann' WHEN part % 13 = 0 THEN '- 4 -' ELSE question END AS s FROM cards)"""


def a01(s, d):
    return L.drop_furniture(_glyphs(s, d)).select("doc_id", "glyph_seq", "s")


def a03(s, d):
    return L.column_cuts(_glyphs(s, d)).select("doc_id", "cut")


def a03b(s, d):
    return L.with_columns(_glyphs(s, d)).groupBy("doc_id", "col").agg(F.count("*").alias("n"))


def a04(s, d):
    return L.mode_scale(_glyphs(s, d)).select("doc_id", "mode_scale")


def a08(s, d):
    return L.with_rows(_glyphs(s, d)).groupBy("doc_id").agg(F.max("row_no").alias("n_rows"), F.count("*").alias("n"))


def a08_first_fit(s, d):
    """Glyphs two points apart, which a chain of gaps would take for one row."""
    tall = (600 - F.col("number") * 2 - F.col("deck_id") % 50 * 9).cast("double")
    glyphs = cards(s, d).select(F.floor(F.col("deck_id") / 50).cast("long").alias("doc_id"), F.lit(1).alias("page_index"), F.col("card_id").alias("glyph_seq"), tall.alias("y"))
    return L.with_rows(glyphs).select("doc_id", "glyph_seq", "row_no")


def _stacked(s, d):
    deck = cards(s, d)
    one = F.array(
        F.struct(F.lit(0).alias("k"), F.concat(F.col("a").cast("string"), F.lit("x = "), F.col("b").cast("string")).alias("text"), F.lit(10.0).alias("x0"), F.lit(60.0).alias("x1")),
        F.struct(F.lit(1).alias("k"), F.when(F.col("part") % 3 == 0, F.lit("see the second page")).otherwise(F.col("c").cast("string")).alias("text"), F.when(F.col("part") % 5 == 0, F.lit(40.0)).otherwise(F.lit(12.0)).alias("x0"), F.lit(50.0).alias("x1")),
        F.struct(F.lit(2).alias("k"), F.lit("--").alias("text"), F.lit(0.0).alias("x0"), F.lit(90.0).alias("x1")),
    )
    return deck.select(F.col("card_id").alias("doc_id"), F.lit(1).alias("page_index"), F.lit(0).alias("col"), F.explode(one).alias("l")).select("doc_id", "page_index", "col", F.col("l.k").alias("line_no"), "l.text", "l.x0", "l.x1")


def a10(s, d):
    return L.merge_stacked(_stacked(s, d)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text")


def a11(s, d):
    lines = _glyphs(s, d).select("doc_id", "page_index", F.col("glyph_seq").alias("line_no"), F.col("s").alias("text"), (F.floor(F.col("x") / 300) * 300 + F.col("x") % 7).alias("x0"), (F.floor(F.col("x") / 300) * 300 + 100).alias("x1"), (-F.col("y")).alias("y0"))
    return L.reflow(lines).select("doc_id", "line_no", "col", "place")


def a_pages(s, d):
    return L.assemble(_glyphs(s, d))


def a_texts(s, d):
    return L.assemble_texts(_glyphs(s, d))


QUERIES = {
    "a01_drop_furniture": a01, "a03_column_cuts": a03, "a03_column_buckets": a03b, "a04_mode_scale": a04, "a08_row_groups": a08, "a08_first_fit_rows": a08_first_fit, "a10_stacked_fractions": a10, "a11_reflow": a11, "a02_a09_page_lines": a_pages, "a_page_texts": a_texts,
}

CUTS = f"""WITH {GLYPHS}, lim AS (SELECT doc_id, max(y) - (max(y) - min(y)) * CAST(0.12 AS DOUBLE) AS top FROM glyphs GROUP BY doc_id),
body AS (SELECT g.* FROM glyphs g JOIN lim ON lim.doc_id = g.doc_id WHERE g.y <= lim.top),
new AS (SELECT *, CASE WHEN coalesce(lag(y) OVER w - y > 3, TRUE) THEN 1 ELSE 0 END AS starts FROM body WINDOW w AS (PARTITION BY doc_id ORDER BY y DESC, x, glyph_seq)),
rows_ AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY y DESC, x, glyph_seq ROWS UNBOUNDED PRECEDING) AS row_no FROM new),
size AS (SELECT doc_id, CAST(floor(min(x)) AS BIGINT) AS a, CAST(ceil(max(x + w)) AS BIGINT) AS z, count(*) AS n, count(DISTINCT row_no) AS n_rows FROM rows_ GROUP BY doc_id),
px AS (SELECT doc_id, a, z, n_rows, unnest(range(a, z + 1)) AS px FROM size WHERE n >= 8 AND z - a >= 100),
cover AS (SELECT p.doc_id, p.px, count(DISTINCT r.row_no) AS inked FROM px p JOIN rows_ r ON r.doc_id = p.doc_id AND p.px BETWEEN floor(r.x) AND ceil(r.x + r.w) GROUP BY p.doc_id, p.px),
blank AS (SELECT p.*, p.px - row_number() OVER (PARTITION BY p.doc_id ORDER BY p.px) AS island FROM px p LEFT JOIN cover c ON c.doc_id = p.doc_id AND c.px = p.px WHERE coalesce(c.inked, 0) < p.n_rows * CAST(0.06 AS DOUBLE)),
runs_ AS (SELECT doc_id, a, z, min(px) AS f, max(px) AS t FROM blank GROUP BY doc_id, island, a, z),
cuts AS (SELECT doc_id, (f + t) / 2.0 AS cut FROM runs_ WHERE t - f + 1 >= 8 AND t - f + 1 >= (z - a) * CAST(0.035 AS DOUBLE) AND f - a > (z - a) * CAST(0.12 AS DOUBLE) AND z - t > (z - a) * CAST(0.08 AS DOUBLE))"""

ORACLE_SQL = {
    "a01_drop_furniture": f"""WITH {GLYPHS}, l AS (SELECT doc_id, min(y) + (max(y) - min(y)) * CAST(0.035 AS DOUBLE) AS low FROM glyphs GROUP BY doc_id)
      SELECT g.doc_id, g.glyph_seq, g.s FROM glyphs g JOIN l ON l.doc_id = g.doc_id WHERE g.s NOT LIKE 'Name:%' AND g.s <> '- 4 -' AND NOT (g.scale < 8 AND g.y < l.low)""",
    "a03_column_cuts": CUTS + " SELECT doc_id, CAST(cut AS DOUBLE) AS cut FROM cuts",
    "a03_column_buckets": CUTS + """, b AS (SELECT g.doc_id, g.glyph_seq, count(c.cut) AS col FROM glyphs g LEFT JOIN cuts c ON c.doc_id = g.doc_id AND c.cut <= g.x + g.w / 2 GROUP BY g.doc_id, g.glyph_seq)
      SELECT doc_id, col, count(*) AS n FROM b GROUP BY doc_id, col""",
    "a04_mode_scale": f"""WITH {GLYPHS}, n AS (SELECT doc_id, scale, count(*) AS n FROM glyphs GROUP BY doc_id, scale)
      SELECT doc_id, scale AS mode_scale FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, scale DESC) AS k FROM n) WHERE k = 1""",
    "a08_row_groups": f"""WITH RECURSIVE {GLYPHS}, ys AS (SELECT DISTINCT doc_id, floor(y + CAST(0.5 AS DOUBLE)) AS y FROM glyphs),
      k AS (SELECT doc_id, max(y) AS y FROM ys GROUP BY doc_id UNION ALL SELECT k.doc_id, max(ys.y) FROM k JOIN ys ON ys.doc_id = k.doc_id AND ys.y < k.y - 3 GROUP BY k.doc_id, k.y)
      SELECT g.doc_id, any_value(k.n) AS n_rows, count(*) AS n FROM glyphs g JOIN (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id) k ON k.doc_id = g.doc_id GROUP BY g.doc_id""",
    "a08_first_fit_rows": f"""WITH RECURSIVE {CARDS}, g AS (SELECT deck_id // 50 AS doc_id, card_id AS glyph_seq, CAST(600 - number * 2 - deck_id % 50 * 9 AS DOUBLE) AS y FROM cards),
      ys AS (SELECT DISTINCT doc_id, y FROM g),
      k AS (SELECT doc_id, max(y) AS y FROM ys GROUP BY doc_id UNION ALL SELECT k.doc_id, max(ys.y) FROM k JOIN ys ON ys.doc_id = k.doc_id AND ys.y < k.y - 3 GROUP BY k.doc_id, k.y)
      SELECT g.doc_id, g.glyph_seq, count(*) AS row_no FROM g JOIN k ON k.doc_id = g.doc_id AND k.y >= g.y GROUP BY g.doc_id, g.glyph_seq""",
    "a10_stacked_fractions": f"""WITH {CARDS}, f AS (SELECT *, part % 3 <> 0 AND part % 5 <> 0 AS merged FROM cards)
      SELECT card_id AS doc_id, CAST(0 AS BIGINT) AS line_no, CASE WHEN merged THEN '(' || CAST(a AS VARCHAR) || 'x)/(' || CAST(c AS VARCHAR) || ') = ' || CAST(b AS VARCHAR) ELSE CAST(a AS VARCHAR) || 'x = ' || CAST(b AS VARCHAR) END AS text FROM f
      UNION ALL SELECT card_id, CAST(1 AS BIGINT), CASE WHEN part % 3 = 0 THEN 'see the second page' ELSE CAST(c AS VARCHAR) END FROM f WHERE NOT merged
      UNION ALL SELECT card_id, CAST(2 AS BIGINT), '--' FROM f""",
    "a11_reflow": f"""WITH {GLYPHS}, l AS (SELECT doc_id, glyph_seq AS line_no, floor(x / 300) AS side, -y AS y0, count(*) OVER (PARTITION BY doc_id) AS n,
        max(floor(x / 300)) OVER (PARTITION BY doc_id) - min(floor(x / 300)) OVER (PARTITION BY doc_id) AS sides, min(floor(x / 300)) OVER (PARTITION BY doc_id) AS first_side FROM glyphs),
      c AS (SELECT *, CASE WHEN n < 5 OR sides = 0 THEN 0 ELSE CAST(side - first_side AS BIGINT) END AS col FROM l)
      SELECT doc_id, line_no, CAST(col AS BIGINT) AS col, row_number() OVER (PARTITION BY doc_id ORDER BY col, y0, line_no) AS place FROM c""",
}
