import hashlib
import zlib

import pytest

from tallyforge.llm import warc

LONG = "<p>" + "é" * 60 + "</p>"


def expected(rows):
    digests = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, p in digests:
        if len(p) >= 100 and i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, p in digests:
        f = first.get(p)
        again = f is not None and f != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def test_round_trip_and_edges(spark, tmp_path):
    rows = [(3, "http://a/x y?q=1\r\n", LONG), (1, None, LONG), (2, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "x" * 300_000),
            (None, "u", LONG), (1, "again", LONG), (8, "u", "a\r\n\r\nb" * 40)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, first int")
    folder = f"file://{tmp_path}/w"
    made = warc.write(pages, folder, archive_bytes=2000).collect()
    assert sum(r.n_records for r in made) == len(rows)
    got = warc.read(spark, folder).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    bodies = {(r.page_id, r.record_type): r.block.split(b"\r\n\r\n", 1)[1] for r in got}
    assert bodies[(7, "response")] == b"x" * 300_000 and bodies[(8, "response")] == b"a\r\n\r\nb" * 40
    assert bodies[(3, "revisit")] == b""


def test_whole_table_matches_plain_form(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = warc.op10_warc(spark, sf_dir).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_empty_table(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "html": pa.array([], pa.string())}), tmp_path / "pages.parquet")
    assert warc.op10_warc(spark, str(tmp_path)).count() == 0


def test_reader_rejects_damage():
    digest = hashlib.sha256(b"payload").hexdigest()
    good = warc.record("response", "u", b"payload", digest, "<urn:page:1>") * 2
    assert len(list(warc.records(good[i : i + 7] for i in range(0, len(good), 7)))) == 2
    with pytest.raises(warc.ArchiveError):
        list(warc.records([good[:-3]]))
    text = zlib.decompress(good[: len(good) // 2], 31)

    def again(t):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(t) + c.flush()

    for bad in (text.replace(b"payload", b"paYload"), text.replace(b"WARC/1.1", b"WARC/2.0"), text + b"x", text.replace(digest.encode(), b"0" * 64)):
        with pytest.raises(warc.ArchiveError):
            list(warc.records([again(bad)]))
    with pytest.raises(zlib.error):
        list(warc.records([b"not gzip"]))


def test_archives_of_other_writers(spark, tmp_path):
    import base64
    import gzip

    def member(*lines, block=b""):
        return gzip.compress(b"\r\n".join([b"WARC/1.0", *lines, b"Content-Length: %d" % len(block)]) + b"\r\n\r\n" + block + b"\r\n\r\n")

    body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>hi</p>"
    sha1 = base64.b32encode(hashlib.sha1(b"<p>hi</p>").digest())
    info = member(b"warc-type: warcinfo", b"WARC-RECORD-ID: <urn:uuid:1>", b"Content-Type: application/warc-fields", block=b"software: x\r\n\r\nmore")
    page = member(b"Warc-Type: response", b"warc-target-uri:http://a/", b"Content-Type: application/http;", b" msgtype=response", b"WARC-Payload-Digest: sha1:" + sha1, b"WARC-Block-Digest: tiger:123", block=body)
    again = member(b"WARC-Type: revisit", b"WARC-Payload-Digest: sha1:" + sha1, b"Content-Type: application/http", block=b"HTTP/1.1 200 OK\r\n\r\n")
    (tmp_path / "x.warc.gz").write_bytes(info + page + again)
    got = {r.record_type: r for r in warc.read(spark, f"file://{tmp_path}").collect()}
    assert got["response"].payload_bytes == 9 and got["response"].payload_digest == hashlib.sha256(b"<p>hi</p>").hexdigest() and got["response"].target_uri == "http://a/"
    assert got["warcinfo"].payload_bytes == 19 and got["warcinfo"].page_id is None and got["warcinfo"].target_uri is None
    assert got["revisit"].payload_bytes is None and got["revisit"].payload_digest is None
    for bad in (page.replace(page, member(b"WARC-Type: response", b"Content-Type: application/http", b"WARC-Payload-Digest: sha1:" + sha1, block=body + b"!")), gzip.compress(b"WARC/1.0\r\nWARC-Type: metadata\r\n\r\n\r\n\r\n")):
        with pytest.raises(warc.ArchiveError):
            list(warc.records([bad]))


def test_an_attempt_that_runs_again_doubles_nothing(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string").repartition(2)
    for _ in range(2):
        assert sum(r.n_records for r in warc.write(pages, f"file://{tmp_path}/w").collect()) == 20
    assert warc.read(spark, f"file://{tmp_path}/w").count() == 20
