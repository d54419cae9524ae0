"""Positioned glyphs to lines in reading order. Glyph: doc_id, page_index, glyph_seq, x, y (upward), w, scale, s."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_index"]
#: What stands on pages besides problems: page numbers, form labels, blanks to fill in and notices.
FURNITURE = r"(?i)^\s*(?:page \d+|-\s*\d+\s*-|(?:name|date|score|period)\b.*|.*_{3,}.*|.*(?:copyright|all rights reserved|©).*)\s*$"


def drop_furniture(glyphs: DataFrame) -> DataFrame:
    """Without furniture, and without small text (scale under 8) in the lowest 3.5 % of a page's height."""
    page = Window.partitionBy(*PAGE)
    low, high = F.min("y").over(page), F.max("y").over(page)
    kept = glyphs.withColumn("_floor", low + (high - low) * 0.035).where(~F.col("s").rlike(FURNITURE) & ~((F.col("scale") < 8) & (F.col("y") < F.col("_floor"))))
    return kept.drop("_floor")


def mode_scale(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page_index, mode_scale): the most frequent rounded scale, the larger of equals, 12 without any."""
    n = glyphs.where("s <> ''").groupBy(*PAGE, F.floor(F.col("scale") + 0.5).cast("double").alias("k")).agg(F.count("*").alias("n"))
    return n.groupBy(*PAGE).agg(F.coalesce(F.max_by("k", F.struct("n", "k")), F.lit(12.0)).alias("mode_scale"))


def with_rows(glyphs: DataFrame, gap: float = 3.0) -> DataFrame:
    """Adds row_no from 1 at the top: a glyph belongs to the first row whose key is within gap of its rounded y, else its y is a new key.

    From the top down only the last key can still fit, so keys come from one fold over a page's different ys, and a
    glyph's row is the number of keys not below it. Glyphs without a y have no row.
    """
    tall = F.floor(F.col("y") + 0.5).cast("double")
    keys = F.aggregate(
        F.sort_array("_ys", asc=False), F.array().cast("array<double>"),
        lambda k, y: F.when(F.coalesce(F.get(k, F.size(k) - 1) - y > gap, F.lit(True)), F.concat(k, F.array(y))).otherwise(k),
    )
    pages = glyphs.groupBy(*PAGE).agg(F.collect_set(tall).alias("_ys")).select(*PAGE, keys.alias("_keys"))
    joined = glyphs.join(pages, PAGE, "left")
    above = F.size(F.filter("_keys", lambda k: k >= F.floor(F.col("y") + 0.5))).cast("long")
    return joined.withColumn("row_no", F.when(F.col("y").isNotNull(), above)).drop("_keys")


def _ink_rows(glyphs: DataFrame, gap: float = 3.0) -> DataFrame:
    """Adds row_no for the share of rows that ink a point: a glyph more than gap below the one before begins a row."""
    down = Window.partitionBy(*PAGE).orderBy(F.desc("y"), "x", "glyph_seq")
    new = F.coalesce(F.lag("y").over(down) - F.col("y") > gap, F.lit(True)).cast("long")
    return glyphs.withColumn("_new", new).withColumn("row_no", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def column_cuts(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page_index, cut): middles of the gutters between columns.

    Below the top 12 % of a page with eight glyphs and 100 points of width or more, a gutter is a run of whole points
    inked on less than 6 % of the rows, as wide as 8 points and 3.5 % of the width, not within 12 % of the left nor 8 %
    of the right edge.
    """
    page = Window.partitionBy(*PAGE)
    low, high = F.min("y").over(page), F.max("y").over(page)
    body = _ink_rows(glyphs.withColumn("_top", high - (high - low) * 0.12).where("y <= _top").drop("_top"))
    # rows are numbered from 1, so that the last number is how many there are
    size = {"a": F.floor(F.min("x").over(page)).cast("long"), "z": F.ceil(F.max(F.col("x") + F.col("w")).over(page)).cast("long"), "n": F.count("*").over(page), "n_rows": F.max("row_no").over(page)}
    # a row's ink as intervals that do not touch, so that a point counts a row once
    ink = body.withColumns(size).where("n >= 8 and z - a >= 100").select(*PAGE, "a", "z", "n_rows", "row_no", F.floor("x").cast("long").alias("from"), F.ceil(F.col("x") + F.col("w")).cast("long").alias("to")).where("from <= to")
    along = Window.partitionBy(*PAGE, "row_no").orderBy("from", "to")
    reached = F.max("to").over(along.rowsBetween(Window.unboundedPreceding, -1))
    pieces = ink.withColumn("_new", F.coalesce(F.col("from") > reached, F.lit(True)).cast("long")).withColumn("_piece", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = pieces.groupBy(*PAGE, "a", "z", "n_rows", "row_no", "_piece").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    # the sweep: rows begin and end at events, between two events the number of inked rows stays; a page's edges turn nothing
    event = lambda at, turn: F.struct(at.alias("px"), F.lit(turn).alias("turn"))
    ends = F.array(event(F.col("from"), 1), event(F.col("to") + 1, -1))
    edges = F.array(event(F.col("a"), 0), event(F.col("z") + 1, 0))
    turns = F.explode(F.when(F.col("_piece") == 1, F.concat(ends, edges)).otherwise(ends))
    events = pieces.select(*PAGE, "a", "z", "n_rows", turns.alias("e")).groupBy(*PAGE, "a", "z", "n_rows", "e.px").agg(F.sum("e.turn").alias("turn"))
    sweep = Window.partitionBy(*PAGE).orderBy("px")
    spans = events.withColumns({"inked": F.sum("turn").over(sweep.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("px").over(sweep)}).where("px <= z")
    spans = spans.withColumn("blank", F.col("inked") < F.col("n_rows") * 0.06).withColumn("island", F.sum((~F.col("blank")).cast("long")).over(sweep.rowsBetween(Window.unboundedPreceding, 0)))
    runs = spans.where("blank").groupBy(*PAGE, "island", "a", "z").agg(F.min("px").alias("from"), (F.max("next") - 1).alias("to"))
    span = F.col("z") - F.col("a")
    wide = (F.col("to") - F.col("from") + 1 >= 8) & (F.col("to") - F.col("from") + 1 >= span * 0.035)
    inside = (F.col("from") - F.col("a") > span * 0.12) & (F.col("z") - F.col("to") > span * 0.08)
    return runs.where(wide & inside).select(*PAGE, ((F.col("from") + F.col("to")) / 2).alias("cut"))


def _page_cuts(glyphs: DataFrame) -> DataFrame:
    return column_cuts(glyphs).groupBy(*PAGE).agg(F.sort_array(F.collect_list("cut")).alias("_cuts"))


def with_columns(glyphs: DataFrame) -> DataFrame:
    """Adds col: the number of cuts at or left of a glyph's middle."""
    joined = glyphs.join(_page_cuts(glyphs), PAGE, "left")
    return joined.withColumn("col", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("x") + F.col("w") / 2)), F.lit(0)).cast("long")).drop("_cuts")


def merge_stacked(lines: DataFrame) -> DataFrame:
    """A10: lines (doc_id, page_index, col, line_no, text, x0, x1) with a short numerator over a denominator put together as (a)/(b).

    A denominator is a lone term, or an expression in brackets, under at most 18 characters, within 35 % of their width
    of the left edge and no more than 10 % beyond the right one; what follows '=' above stays behind the fraction.
    """
    order = Window.partitionBy(*PAGE, "col").orderBy("line_no")
    lead = lambda c: F.lead(c).over(order)
    width = F.col("x1") - F.col("x0")
    top = F.trim(F.regexp_extract("text", r"^([^=]*)", 1))
    fits = (
        F.coalesce(lead("text").rlike(r"^\s*(?:[A-Za-z0-9^]{1,8}|\([A-Za-z0-9^+\-*. ]{1,16}\))\s*$"), F.lit(False)) & (F.length(top).between(1, 18)) & ~top.rlike(r"[/:]") & top.rlike(r"[A-Za-z0-9]")
        & (F.abs(lead("x0") - F.col("x0")) <= width * 0.35) & (lead("x1") <= F.col("x1") + width * 0.1)
    )
    marked = lines.withColumns({"_fits": fits, "_under": F.regexp_replace(F.trim(lead("text")), r"^\(|\)$", ""), "_top": top, "_tail": F.regexp_extract("text", r"(=.*)$", 1)})
    # of a chain of lines that all fit, every second one from the first is a numerator
    run = F.col("line_no") - F.coalesce(F.max(F.when(~F.col("_fits"), F.col("line_no"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    marked = marked.withColumn("_first", F.col("_fits") & (run % 2 == 1))
    used = F.coalesce(F.lag("_first").over(order), F.lit(False))
    text = F.when(F.col("_first"), F.trim(F.concat(F.lit("("), F.col("_top"), F.lit(")/("), F.col("_under"), F.lit(") "), F.col("_tail")))).otherwise(F.col("text"))
    return marked.withColumn("_used", used).where("not _used").select(*PAGE, "col", "line_no", text.alias("text"), "x0", "x1")


def reflow(lines: DataFrame) -> DataFrame:
    """Adds col and place to lines (doc_id, page_index, line_no, text, x0, x1, y0): columns found by gaps of more than 10 % of the width.

    Columns are clusters of the left edges of lines narrower than 55 %; every line goes to the nearest cluster's mean.
    Pages with fewer than five lines are one column.
    """
    page = Window.partitionBy(*PAGE)
    sized = lines.withColumns({"_n": F.count("*").over(page), "_width": F.max("x1").over(page) - F.min("x0").over(page)})
    narrow = sized.where((F.col("_n") >= 5) & (F.col("x1") - F.col("x0") < F.col("_width") * 0.55))
    order = Window.partitionBy(*PAGE).orderBy("x0", "line_no")
    new = F.coalesce(F.col("x0") - F.lag("x0").over(order) > F.col("_width") * 0.1, F.lit(True)).cast("long")
    clusters = narrow.withColumn("_new", new).withColumn("_c", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    means = clusters.groupBy(*PAGE, "_c").agg(F.avg("x0").alias("_m")).groupBy(*PAGE).agg(F.sort_array(F.collect_list("_m")).alias("_means"))
    joined = sized.join(means, PAGE, "left")
    near = F.array_min(F.transform("_means", lambda m, i: F.struct(F.abs(m - F.col("x0")).alias("d"), i.alias("i"))))["i"]
    placed = joined.withColumn("col", F.coalesce(near, F.lit(0)).cast("long"))
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("col", "y0", "line_no"))
    return placed.withColumn("place", place.cast("long")).drop("_n", "_width", "_means")


# A02, A05-A07 and A09 use up glyphs one after another, so they stay in one small function for each page.


def _braces(g: list[dict]) -> list[dict]:
    """Runs from '{' to '}' on a row as one atom."""
    down = sorted(g, key=lambda x: (-round(x["y"] / 3), x["x"]))
    if not any("{" in x["s"] for x in down):
        return down
    out: list[dict] = []
    held = None
    for x in down:
        if held and abs(held["y"] - x["y"]) > 3:
            out.append(held)
            held = None
        if held:
            held = held | {"s": held["s"] + x["s"], "w": x["x"] + x["w"] - held["x"]}
        elif "{" in x["s"]:
            held = dict(x)
        else:
            out.append(x)
        if held and held["s"].count("}") >= held["s"].count("{"):
            out.append(held)
            held = None
    return [*out, held] if held else out


def _superscripts(g: list[dict], mode: float) -> list[dict]:
    """Small glyphs raised beside another become its power; left to right, so towers build up."""
    out: list[dict] = []
    # a base is at most the mode's height below its power, so it is in the power's band or the one or two under it
    high = abs(mode) or 1.0
    bands: dict[int, list[tuple[int, dict]]] = {}
    for x in sorted(g, key=lambda x: x["x"]):
        at, y = x["x"], x["y"]
        band = math.floor(y / high)
        if x["scale"] < 0.85 * mode:
            below = [(n, b) for k in (band - 2, band - 1, band) for n, b in bands.get(k, ()) if -2 <= at - (b["x"] + b["w"]) <= mode * 0.6 and mode * 0.15 <= y - b["y"] <= mode]
            if below:
                _, b = min(below, key=lambda nb: (abs(at - nb[1]["x"] - nb[1]["w"]) + abs(y - nb[1]["y"] - mode * 0.4), nb[0]))
                b["s"] += f"^{x['s']}"
                b["w"] = at + x["w"] - b["x"]
                continue
        out.append(dict(x))
        bands.setdefault(band, []).append((len(out), out[-1]))
    return out


def _fractions(g: list[dict]) -> list[dict]:
    """A token and the nearest short, narrower one 3 to 24 points below it, each used once, as (a)/(b)."""
    down = sorted(g, key=lambda x: (-x["y"], x["x"]))
    used = [False] * len(down)
    out = []
    for i, top in enumerate(down):
        if used[i]:
            continue
        if re.fullmatch(r"[\w^+\-. ]+", top["s"]):
            for j in range(i + 1, len(down)):
                b = down[j]
                if top["y"] - b["y"] > 24:
                    break
                if not used[j] and top["y"] - b["y"] >= 3 and b["x"] >= top["x"] - 3 and b["x"] + b["w"] <= top["x"] + top["w"] + 3 and len(b["s"]) <= 12 and re.fullmatch(r"[\w^+\-. ]+", b["s"]):
                    used[j] = True
                    top = top | {"s": f"({top['s'].strip()})/({b['s'].strip()})", "y": (top["y"] + b["y"]) / 2}
                    break
        out.append(top)
    return out


def _is_mark(s: str) -> bool:
    """A problem's number by itself: up to three digits and a dot or bracket."""
    s = s.strip()
    return 2 <= len(s) <= 4 and s[-1] in ".)" and s[:-1].isdigit()


def _is_term(s: str) -> bool:
    return not _is_mark(s) and re.fullmatch(r"[\w^+\-. ]{1,12}", s) is not None


def _proportions(g: list[dict], mode: float) -> list[dict]:
    """Around each lone '=', the glyphs above and below on either side as (a)/(b) = (c)/(d), after the problem's number if one stands left of them."""
    left = list(g)
    for eq in [x for x in g if x["s"].strip() == "="]:
        band = [x for x in left if x is not eq and abs(x["x"] + x["w"] / 2 - eq["x"]) < 8 * mode and abs(x["y"] - eq["y"]) <= 1.4 * mode]
        near = [x for x in band if abs(x["y"] - eq["y"]) > mode * 0.2 and not _is_mark(x["s"])]
        quarter = {(x["x"] < eq["x"], x["y"] > eq["y"]): x for x in sorted(near, key=lambda x: -abs(x["x"] - eq["x"]))}
        if len(quarter) == 4:
            s = "({}) / ({}) = ({}) / ({})".format(*(quarter[k]["s"].strip() for k in ((True, True), (True, False), (False, True), (False, False)))).replace(" / ", "/")
            start = min(q["x"] for q in quarter.values())
            marks = [x for x in band if _is_mark(x["s"]) and x["x"] <= start]
            label = max(marks, key=lambda x: x["x"]) if marks else None
            used = [eq, *quarter.values(), *([label] if label else [])]
            left = [x for x in left if not any(x is u for u in used)]
            left.append(eq | {"s": f"{label['s'].strip()} {s}" if label else s, "x": label["x"] if label else start, "w": 1.0})
    return left


def _lines(g: list[dict], gap: float = 3.0) -> list[str]:
    """Rows from the top; an empty 'N)' between two short lines takes them as its fraction, beside one alone that one."""
    rows: list[list[dict]] = []
    key = math.inf
    for x in sorted(g, key=lambda x: (-x["y"], x["x"])):
        y = math.floor(x["y"] + 0.5)
        # from the top down only the last row can still fit
        if key - y > gap:
            rows.append([])
            key = y
        rows[-1].append(x)
    text = [" ".join(x["s"].strip() for x in sorted(r, key=lambda x: x["x"])) for r in rows]
    i = 0
    while i < len(text):
        if _is_mark(text[i]):
            above, below = i > 0 and _is_term(text[i - 1]), i + 1 < len(text) and _is_term(text[i + 1])
            a, z = i - above, i + 1 + below
            terms = [text[j] for j in range(a, z) if j != i]
            if terms:
                text[a:z] = [f"{text[i]} ({terms[0]})/({terms[1]})" if len(terms) == 2 else f"{text[i]} {terms[0]}"]
                i = a
        i += 1
    return text


def _page(glyphs: list[dict], mode: float) -> Iterator[tuple[int, int, str]]:
    glyphs = _braces(glyphs)
    small = sum(x["scale"] < 0.85 * mode for x in glyphs)
    cols: dict[int, list[dict]] = {}
    for x in glyphs:
        cols.setdefault(x["col"], []).append(x)
    n = 0
    for col in sorted(cols):
        g = _superscripts(_proportions(cols[col], mode), mode)
        for line in _lines(g if small >= 6 else _fractions(g)):
            n += 1
            yield col, n, line


LINES = pa.list_(pa.struct([("col", pa.int32()), ("line_no", pa.int32()), ("text", pa.string())]))


def _pages(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page_index, lines): each page's lines (col, line_no, text) in reading order.

    A page is a row with its glyphs and cuts, so that Python takes many pages at once; a page is small and shares nothing with others.
    """
    kept = drop_furniture(glyphs.where("trim(s) <> ''"))
    atoms = F.struct("glyph_seq", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "scale")), "s", (F.col("x") + F.col("w") / 2).alias("middle"))
    pages = kept.groupBy(*PAGE).agg(F.collect_list(atoms).alias("glyphs")).join(_page_cuts(kept), PAGE, "left").join(mode_scale(glyphs), PAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                lists, cuts, modes = b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist()
                ends, out = lists.offsets.to_pylist(), []
                for a, z, own, mode in zip(ends[:-1], ends[1:], cuts, modes, strict=True):
                    part = lists.values.slice(a, z - a).flatten()
                    seq, s, known = part[0], part[5].to_numpy(zero_copy_only=False).tolist(), part[6].is_valid().to_pylist()
                    x, y, w, scale, middle = (part[i].to_numpy(zero_copy_only=False).tolist() for i in (1, 2, 3, 4, 6))  # nulls are not a number
                    col = [bisect_right(own, m) if k else 0 for m, k in zip(middle, known, strict=True)] if own else [0] * (z - a)
                    order = pc.sort_indices(seq).to_numpy().tolist()
                    page = [{"x": x[i], "y": y[i], "w": w[i], "scale": scale[i], "s": s[i], "col": col[i]} for i in order]
                    out.append([{"col": c, "line_no": n, "text": text} for c, n, text in _page(page, mode)])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, LINES)], names=[*PAGE, "lines"])

    ready = pages.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_index").cast("int").alias("page_index"), "glyphs", "_cuts", "mode_scale")
    return ready.mapInArrow(run, "doc_id long, page_index int, lines array<struct<col: int, line_no: int, text: string>>")


def assemble(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page_index, col, line_no, text): the lines of each page in reading order, columns from the left."""
    return _pages(glyphs).select(*PAGE, F.inline("lines"))


def assemble_texts(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page_index, text): page_texts of assemble, without a shuffle of the lines."""
    before = lambda i: F.when(i == 0, "").when(F.get("lines", i)["col"] == F.get("lines", i - 1)["col"], "\n").otherwise("\n\n")
    return _pages(glyphs).where("size(lines) > 0").select(*PAGE, F.array_join(F.transform("lines", lambda x, i: F.concat(before(i), x["text"])), "").alias("text"))


def page_texts(lines: DataFrame) -> DataFrame:
    """(doc_id, page_index, text): lines joined, with an empty line between columns."""
    per = lines.groupBy(*PAGE, "col").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("t"))
    return per.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "t"))), lambda x: x["t"]), "\n\n").alias("text"))
