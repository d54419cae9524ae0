"""PDF files written here in several forms, and their runs read again."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import files, pdf


def text_object(n, body):
    return b"%d 0 obj\n%s\nendobj\n" % (n, body)


def stream_object(n, data, flate=False, extra=b""):
    if flate:
        data, extra = zlib.compress(data), extra + b" /Filter /FlateDecode"
    return text_object(n, b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), extra, data))


FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /FirstChar 32 /LastChar 126 /Widths [" + b"600 " * 95 + b"] >>"


def classic(contents, flate=False, broken=False):
    """A file with a table of places, a page for each content."""
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents)))
    parts = [text_object(1, b"<< /Type /Catalog /Pages 2 0 R >>"), text_object(2, b"<< /Type /Pages /Kids [" + kids + b"] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % len(contents)), text_object(3, FONT)]
    numbers = [1, 2, 3]
    for i, c in enumerate(contents):
        parts += [text_object(10 + 2 * i, b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)), stream_object(11 + 2 * i, c, flate)]
        numbers += [10 + 2 * i, 11 + 2 * i]
    out, table = b"%PDF-1.4\n", b""
    for n, p in zip(numbers, parts, strict=True):
        table += b"%d 1\n%010d 00000 n \n" % (n, len(out) + (7 if broken else 0))
        out += p
    return out + b"xref\n" + table + b"trailer\n<< /Root 1 0 R /Size 99 >>\nstartxref\n%d\n%%%%EOF" % len(out)


def packed(content):
    """A file whose objects lie in an object stream and whose places in a filtered cross-reference stream."""
    inside = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [4 0 R] /Count 1 >>"), (3, FONT), (4, b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R 7 0 R] /Resources << /Font << /F1 3 0 R >> >> >>")]
    heads, bodies = b"", b""
    for n, body in inside:
        heads += b"%d %d " % (n, len(bodies))
        bodies += body + b" "
    out, places = b"%PDF-1.5\n", {}
    half = len(content) // 2
    half = content.index(b"\n", half)
    for n, made in ((5, stream_object(5, heads + bodies, True, b" /Type /ObjStm /N %d /First %d" % (len(inside), len(heads)))), (6, stream_object(6, content[:half], True)), (7, stream_object(7, content[half:]))):
        places[n] = len(out)
        out += made
    places[8] = len(out)
    rows = [(0, 0, 0)] + [(2, 5, k) for k in range(4)] + [(1, places[n], 0) for n in (5, 6, 7, 8)]
    raw = [bytes([a]) + b.to_bytes(4, "big") + bytes([c]) for a, b, c in rows]
    up = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(r, p, strict=True)) for r, p in zip(raw, [bytes(6), *raw], strict=False))
    return out + stream_object(8, up, True, b" /Type /XRef /Size 9 /Root 1 0 R /W [1 4 1] /DecodeParms << /Predictor 12 /Columns 6 >>") + b"startxref\n%d\n%%%%EOF" % places[8]


LINES = [(72, 700, "1) x + 1 = 3"), (300.5, 680, "a (b) \\ c"), (72, 660, "caf\xe9 – 5")]


def content(lines):
    escape = lambda s: s.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    return b"BT /F1 12 Tf\n" + b"".join(b"1 0 0 1 %s %d Tm (%s) Tj\n" % (str(x).encode(), y, escape(s)) for x, y, s in lines) + b"ET"


@pytest.mark.parametrize("make", [lambda c: classic([c]), lambda c: classic([c], flate=True), lambda c: classic([c], broken=True), packed, lambda c: packed(c).replace(b"startxref", b"startxxxx")])
def test_what_was_written_is_read(make):
    rows = list(pdf.file_runs(make(content(LINES))))
    assert [(r[0], r[1], r[2][4], r[2][5], r[4], r[5]) for r in rows] == [(1, i, x, y, s, None) for i, (x, y, s) in enumerate(LINES, 1)]
    assert all(r[2][:4] == [12, 0, 0, 12] for r in rows) and rows[0][3] == pytest.approx(12 * 0.6 * 12)


def test_pages_in_order():
    rows = list(pdf.file_runs(classic([content([(1, 1, f"page {i}")]) for i in range(12)])))
    assert [(r[0], r[4]) for r in rows] == [(i + 1, f"page {i}") for i in range(12)]


def runs(commands):
    return [(r[4], round(r[2][4], 6), round(r[2][5], 6), round(r[3], 6), round(r[2][3], 6)) for r in pdf.file_runs(classic([commands]))]


def test_text_operators():
    assert runs(b"BT /F1 10 Tf 14 TL 5 100 Td (a) Tj T* (b) Tj (c) ' 0 -6 TD (d) Tj T* (e) Tj ET") == [("a", 5, 100, 6, 10), ("b", 5, 86, 6, 10), ("c", 5, 72, 6, 10), ("d", 5, 66, 6, 10), ("e", 5, 60, 6, 10)]
    assert runs(b"q 2 0 0 2 10 20 cm BT /F1 10 Tf (a) Tj (b) Tj ET Q BT /F1 10 Tf (c) Tj ET") == [("a", 10, 20, 12, 20), ("b", 22, 20, 12, 20), ("c", 0, 0, 6, 10)]
    assert runs(b"BT /F1 10 Tf [(ab) -300 (c) 50 (d)] TJ 3 Ts 50 Tz 1 Tc (x y) Tj ET")[0] == ("ab cd", 0, 0, 26.5, 10)
    assert runs(b"BT /F1 10 Tf 3 Ts 50 Tz 1 Tc 2 Tw (x y) Tj ET") == [("x y", 0, 3, (18 + 3 + 2) / 2, 10)]
    assert runs(b"BT /F1 10 Tf <61 6> Tj 7 1 (z) \" ET % a comment (no)\nBI /W 1 ID (junk) Tj \x00 EI BT Td Tj /F1 10 Tf (ok) Tj ET") == [("a`", 0, 0, 12, 10), ("z", 0, 0, 7, 10), ("ok", 0, 0, 14, 10)]


def test_codes_of_two_bytes_and_maps():
    cmap = b"1 beginbfchar <0041> <03C0> endbfchar 2 beginbfrange <0042> <0044> <0061> <0045> <0046> [<0078> <00660066>] endbfrange"
    data = classic([b"BT /F1 10 Tf <0041004200440046FFFF> Tj ET"])
    type0 = b"<< /Type /Font /Subtype /Type0 /DescendantFonts [<< /DW 500 /W [65 [100 200] 68 70 300] >>] /ToUnicode 50 0 R >>"
    data = data.replace(text_object(3, FONT), text_object(3, type0) + stream_object(50, cmap, True))
    assert [(r[4], round(r[3], 6)) for r in pdf.file_runs(data)] == [("πacff�", 1 + 2 + 3 + 3 + 5)]


def test_unfiltered_undoes_all_five_filters():
    import random

    rng = random.Random(7)
    rows = [bytes(rng.randrange(256) for _ in range(12)) for _ in range(20)]
    made, above = b"", bytes(12)
    for i, row in enumerate(rows):
        kind, left, corner = i % 5, bytes(3) + row[:-3], bytes(3) + above[:-3]
        guess = [[0] * 12, left, above, [(a + b) // 2 for a, b in zip(left, above, strict=True)], [min((a, b, c), key=lambda v, a=a, b=b, c=c: abs(a + b - c - v)) for a, b, c in zip(left, above, corner, strict=True)]][kind]
        made += bytes([kind]) + bytes((x - g) & 255 for x, g in zip(row, guess, strict=True))
        above = row
    assert pdf.unfiltered(made, 12, 3) == b"".join(rows)


def test_files_by_spark(spark, tmp_path):
    good = classic([content(LINES)], flate=True)
    made = {"a.pdf": good, "b.pdf": b"", "c.pdf": b"no pdf at all", "d.pdf": good[: len(good) // 2], "e.pdf": good.replace(b"/Root", b"/Encrypt 9 0 R /Root"), "f.pdf": packed(content(LINES)), "g.txt": good, "h.pdf": b"%PDF-1.4\n" + b"[" * 5000}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    rows = pdf.pdf_runs(files.read_sources(spark, str(tmp_path), "*.pdf")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    for name in ("a.pdf", "f.pdf"):
        assert [r.text for r in by[name]] == [s for _, _, s in LINES]
    assert set(by) == set(made) - {"b.pdf", "g.txt"}
    for name in set(by) - {"a.pdf", "f.pdf"}:
        assert by[name][-1].problem and by[name][-1].text is None, name
    assert by["e.pdf"][0].problem == "encrypted"
    df = spark.createDataFrame([(1, None, "x"), (1, good, "y")], "doc_id long, content binary, text string")
    assert [r.problem for r in pdf.pdf_runs(df, "doc_id").collect()].count(None) == 3
    assert pdf.pdf_runs(df.limit(0), "doc_id").count() == 0


def test_runs_of_many_files_go_together(spark):
    """A batch of runs holds those of many files, and one of a file's fewest numbers and strings reads as before."""

    assert pdf.value(b"[600 20\n7]", 0)[0] == [600, 20, 7] and pdf.value(b"[1 2.5 (a\\)b) true]", 0)[0] == [1, 2.5, b"a)b", True]
    held = {}

    class Frame:
        dtypes = [("key", "bigint"), ("content", "binary")]

        def selectExpr(self, *_):
            return self

        def mapInArrow(self, run, _):
            held["run"] = run
            return self

        def withColumnRenamed(self, *_):
            return self

    pdf.pdf_runs(Frame(), "key")
    batch = pdf.pa.RecordBatch.from_pydict({"key": list(range(50)), "content": [None] * 50})
    out = list(held["run"](iter([batch])))
    assert len(out) == 1 and out[0].column("key").to_pylist() == list(range(50))


def test_what_many_files_share_is_parsed_once(monkeypatch):
    made, parsed = [], []
    font, value = pdf.Font.__init__, pdf.value
    monkeypatch.setattr(pdf.Font, "__init__", lambda self, *given: (made.append(1), font(self, *given))[1])
    monkeypatch.setattr(pdf, "value", lambda *given: (parsed.append(1), value(*given))[1])
    many = [classic([content([(10 + i, 700, f"line {i}"), (20, 600, "a (b)")])]) for i in range(50)]
    rows = [list(pdf.file_runs(m)) for m in many]
    assert [[(r[2][4], r[4]) for r in x] for x in rows] == [[(10 + i, f"line {i}"), (20, "a (b)")] for i in range(50)]
    assert len(made) <= 1 and len(parsed) < 50 * 12
    # fonts of one name that differ, or lead to objects of their files, are not mixed up
    wide = [classic([content([(1, 1, "ab")])]).replace(b"600 " * 95, b"%d " % w * 95) for w in (100, 900)] * 2
    assert [round(r[3], 6) for d in wide for r in pdf.file_runs(d)] == [2.4, 21.6] * 2
    far = [classic([content([(1, 1, "ab")])]).replace(b"/Widths [" + b"600 " * 95 + b"]", b"/Widths 60 0 R").replace(b"xref", text_object(60, b"[" + b"%d " % w * 95 + b"]") + b"xref", 1) for w in (100, 200)]
    assert [round(r[3], 6) for d in far for r in pdf.file_runs(d)] == [2.4, 4.8]


def test_plain_operations_are_read_as_others(monkeypatch):
    rng = random.Random(11)
    some = [b"BT", b"/F1 10 Tf", b"/F1", b"12", b"1 0 0 1 5.5 -.6 Tm (t\\(u) Tj", b"Tm", b"3 4 Td[(k)]TJ", b"-7 +8. TD (a) '", b"T*", b"(a\\) b)", b"(a (b) c)", b"(x\\\\)", b"(\\101\\n)", b"(q\r\nz)", b"Tj", b"TJ", b"[(ab) -300 50 (c)]", b"1 2 (z) \""]
    some += [b"q", b"Q", b"2 0 0 2 1 1 cm", b"3 Ts 50 Tz 1 Tc 2 Tw 14 TL", b"true", b"null Tj", b"% no (x) Tj\n", b"BI (x) Tj EI", b"BI", b"<61 6>", b"<<", b">>", b"]", b"[", b")", b"(", b"0 0 9 9 re f (s) Tj", b"5 Tj", b"--5", b"1_0", b"-0", b"\x00", b"9" * 320, b"Tj_x", b"(a)Tj(b)Tj", b"abc(def)Tj"]
    files = [classic([b"/F1 10 Tf " + b"".join(rng.choice(some) + rng.choice([b" ", b"\n", b""]) for _ in range(rng.randrange(1, 25)))]) for _ in range(300)]
    fast = [list(pdf.file_runs(f)) for f in files]
    monkeypatch.setattr(pdf, "OPERATION", re.compile(b"(?!)"))
    assert [repr(list(pdf.file_runs(f))) for f in files] == list(map(repr, fast)) and sum(map(len, fast)) > 300


def test_files_are_dealt_to_as_many_tasks_as_were_asked_for(spark, sf_dir):
    from tallyforge.plans import worksheets

    made = worksheets._pdf_files(spark, sf_dir)
    assert made.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
