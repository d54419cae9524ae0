"""WARC archives: a writer of one gzip member per record, and a sequential reader.

Archives are files in the shared folder. A task stages its archives and moves them, all at once, to the folder of its
partition. Where that folder is there already, an earlier attempt has written the same records whole, and the staged
ones are thrown away, so no record is doubled. The reader takes the bytes as they come, inflates member after member in
steps, frames each record by its Content-Length and checks its block and payload digests where it has them. It reads
archives of other writers as well: header names in any case, other record types, versions and digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import save, shared_dir, table

#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"

#: An archive is closed once it has this many compressed bytes; one record alone may be larger.
ARCHIVE_BYTES = 16 << 20
STEP = 1 << 16


class ArchiveError(ValueError):
    """Bytes that are not a whole, intact record."""


def base32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, uri: str, payload: bytes, digest: str, record_id: str, refers_to: str | None = None, refers_uri: str | None = None, level: int = 6) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head only and names the payload by its digest."""
    block = HTTP_HEAD + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=response")]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", base32_sha1(block)), ("X-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers_to), ("WARC-Refers-To-Target-URI", refers_uri)]
    head.append(("Content-Length", str(len(block))))
    text = VERSION + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(text) + deflate.flush()


def digest_differs(named: str | None, data: bytes) -> bool:
    """Whether a digest header (algorithm:value in base 16 or 32) is not that of data; one of an unknown algorithm is not checked."""
    kind, _, value = (named or "").partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("sha1", "sha256", "sha512", "md5"):
        return False
    made = hashlib.new(kind, data)
    return value.strip().lower() not in (made.hexdigest(), base64.b32encode(made.digest()).decode().lower())


def header_lines(text: str) -> dict[str, str]:
    """Headers by lower-case name; a line that begins with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in text.split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += f" {line.strip()}"
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def payload_of(head: dict[str, str], block: bytes) -> bytes:
    """The block without the HTTP head where the record's type says that it has one."""
    if head.get("content-type", "").replace(" ", "").lower().startswith("application/http") and b"\r\n\r\n" in block:
        return block.split(b"\r\n\r\n", 1)[1]
    return block


def inflated(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """Pieces of inflated bytes; True marks the end of a gzip member."""
    member = zlib.decompressobj(31)
    fed = False
    for chunk in chunks:
        while chunk:
            fed = True
            piece = member.decompress(chunk, STEP)
            chunk = member.unused_data if member.eof else member.unconsumed_tail
            yield piece, member.eof
            if member.eof:
                member, fed = zlib.decompressobj(31), False
    if fed:
        raise ArchiveError("the last gzip member is cut off")


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record in turn; raises ArchiveError at the first that isn't whole or whose digest differs.

    The payload digest of a revisit is of the payload that it leaves out, so it is not checked.
    """
    held = bytearray()
    head: dict[str, str] | None = None
    need = 0
    for piece, end in inflated(chunks):
        held += piece
        if head is None and (cut := held.find(b"\r\n\r\n")) >= 0:
            if not held.startswith(b"WARC/1."):
                raise ArchiveError("a member that does not start with a record")
            head = header_lines(held[held.find(b"\r\n") + 2 : cut].decode("utf-8", "replace"))
            if not head.get("content-length", "").isdigit():
                raise ArchiveError("a record without Content-Length")
            need = int(head["content-length"])
            del held[: cut + 4]
        if end:
            if head is None or len(held) != need + 4 or held[-4:] != b"\r\n\r\n":
                raise ArchiveError("Content-Length does not frame the record")
            block = bytes(held[:need])
            if digest_differs(head.get("warc-block-digest"), block):
                raise ArchiveError("the block digest differs")
            if head.get("warc-type") != "revisit" and digest_differs(head.get("warc-payload-digest"), payload_of(head, block)):
                raise ArchiveError("the payload digest differs")
            yield head, block
            held, head = bytearray(), None


def safe_uri(url: str) -> str:
    """The url without bytes that would break a header line."""
    return quote(url, safe=":/?#[]@!$&'()*+,;=-._~")


def page_urn(page_id: int | None) -> str:
    """The record id of a page; a null page_id has one of its own."""
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    """The page of a record id; null for null and for ids of other writers."""
    value = urn[len("<urn:page:") : -1] if urn and urn.startswith("<urn:page:") else "none"
    return int(value) if value.lstrip("-").isdigit() else None


def plan_records(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, first): first is the smallest page_id with the payload where that is long enough.

    The smallest id is found by partial aggregates over digests, so a payload that a third of all pages share is
    gathered nowhere; they are written before the join, so that the partition of a digest that many pages share can be
    split (spark.sql.adaptive.skewJoin). Where they are not few, the join shuffles each payload once.
    """
    src = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    shared = (
        src.where(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select("digest", "first")
    )
    return src.join(save(shared, "shared"), "digest", "left")


def write(pages: DataFrame, folder: str, least_bytes: int = 100, archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> DataFrame:
    """Writes the archives under folder (a URI that executors can open) and returns (path, n_records, n_bytes) of each.

    Of pages with equal payloads of at least least_bytes, that with the smallest page_id is a response and the others
    revisit it; pages that repeat that id are responses as well. Pages without an id are written as responses where
    all pages of their payload have none, else as revisits. Null html is an empty payload, a null url an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        part = f"part-{TaskContext.get().partitionId():06d}"
        staged = f"{root}/_staged/{uuid.uuid4().hex}"
        done: list[tuple[str, int, int]] = []
        out, size, n = None, 0, 0
        for b in batches:
            for page_id, url, payload, digest, first in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    store.create_dir(staged, recursive=True)
                    out, size, n = store.open_output_stream(f"{staged}/{len(done):06d}.warc.gz", compression=None), 0, 0
                revisit = first is not None and first["page_id"] != page_id
                data = record(
                    "revisit" if revisit else "response", safe_uri(url), payload, digest, page_urn(page_id),
                    page_urn(first["page_id"]) if revisit else None, safe_uri(first["url"]) if revisit else None, level,
                )
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{part}/{len(done):06d}.warc.gz", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{part}/{len(done):06d}.warc.gz", n, size))
        if done:
            there = store.get_file_info(f"{root}/{part}").type != fs.FileType.NotFound
            if not there:
                try:
                    store.move(staged, f"{root}/{part}")
                except OSError:  # another attempt was faster
                    there = store.get_file_info(f"{root}/{part}").type != fs.FileType.NotFound
                    if not there:
                        raise
            if there:
                store.delete_dir(staged)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "n_records", "n_bytes"])

    planned = plan_records(pages, least_bytes).select("page_id", "url", "payload", "digest", "first")
    return planned.mapInArrow(run, "path string, n_records long, n_bytes long")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives of a folder: page_id, record_type, refers_to, target_uri, headers (by lower-case name), payload_bytes, payload_digest, block.

    payload_bytes and payload_digest (bare SHA-256) are of the full payload: of a revisit what the writer named, null
    where it named none of this kind; of other records what they hold. page_id and refers_to are null in archives of
    other writers, and so is a missing target.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")
    return files.mapInArrow(
        _read_batches,
        "page_id long, record_type string, refers_to long, target_uri string, headers map<string,string>, payload_bytes long, payload_digest string, block binary",
    )


def described(head: dict[str, str], block: bytes) -> tuple:
    """A row of read()."""
    kind, uri, length = head.get("warc-type"), head.get("warc-target-uri"), head.get("x-payload-length", "")
    named = re.fullmatch("sha256:([0-9a-f]{64})", head.get("warc-payload-digest", ""))
    digest = named[1] if named else None  # checked already, but of a revisit
    if kind == "revisit":
        size = int(length) if length.isdigit() else None
    else:
        payload = payload_of(head, block)
        size, digest = len(payload), digest or hashlib.sha256(payload).hexdigest()
    return page_of(head.get("warc-record-id")), kind, page_of(head.get("warc-refers-to")), uri and unquote(uri), list(head.items()), size, digest, block


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shape = pa.schema(
        [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("headers", pa.map_(pa.string(), pa.string())),
         ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block", pa.binary())]
    )
    for b in batches:
        for i in range(b.num_rows):
            raw = b.column(1)[i].as_buffer()
            rows, held = [], 0
            for head, block in records(raw.slice(a, min(STEP, raw.size - a)).to_pybytes() for a in range(0, raw.size, STEP)):
                rows.append(described(head, block))
                held += len(block)
                if held >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), shape.types, strict=True)], schema=shape)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), shape.types, strict=True)], schema=shape)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    pages = table(spark, sf_dir, "pages")
    written = write(pages, folder).agg(F.count("*"), F.sum("n_records")).head()
    if not written[0]:
        return pages.limit(0).select(
            F.col("page_id").cast("long").alias("page_id"), F.lit(0).cast("long").alias("payload_bytes"), F.lit("").alias("payload_digest"), F.lit("").alias("record_type"), F.lit(0).cast("long").alias("refers_to")
        )
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first_id = p.page_id THEN NULL ELSE f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
