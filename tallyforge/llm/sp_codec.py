"""SentencePiece models encoded and decoded by the tokenizers library, with parity verified against sentencepiece.

The model file's protobuf is parsed here; the tokenizers pipeline is rebuilt from it: normaliser, metaspace marker,
BPE merges or unigram scores, byte fallback and the matching decoder.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import table

#: Fixed values of the model format: piece types, model types and the marker of a space.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"
#: A code point that is no character, before the names of pieces that must not match.
NEVER = "\U0010ffff"

#: Texts are given to the libraries in runs of about this many bytes, so memory does not follow the batch.
RUN_BYTES = 1 << 18
#: Documents of a task, until there are 200 tasks.
TASK_ROWS = 250


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message: integers for varints, bytes for the rest."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind in (1, 2, 5):
            size = {1: 8, 5: 4}.get(kind) or varint()
            if at + size > end:
                raise ValueError("a field runs past the end of the message")
            yield key >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"unknown wire type {kind}")


@dataclass
class Model:
    """What a model file holds."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False

    @classmethod
    def parse(cls, data: bytes) -> Model:
        out = cls()
        for number, value in fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                out.pieces.append((piece, score, kind))
            elif number == 2:
                spec = dict(fields(value))
                out.kind, out.byte_fallback, out.suffix = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), bool(spec.get(24, 0))
            elif number == 3:
                spec = dict(fields(value))
                out.charsmap, out.dummy_prefix = spec.get(2, b""), bool(spec.get(3, 1))
                out.squeeze, out.escape = bool(spec.get(4, 1)), bool(spec.get(5, 1))
        out.unk_id = next((i for i, (_, _, k) in enumerate(out.pieces) if k == UNKNOWN), 0)
        if out.kind not in (UNIGRAM, BPE) or out.suffix or not out.escape:
            raise ValueError("only unigram and BPE models with a leading space marker are supported")
        return out


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every way to put a piece together from two, pieces of the best score first, equal scores by id."""
    usable = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for p, i in usable.items():
        for cut in range(1, len(p)):
            if p[:cut] in usable and p[cut:] in usable:
                found.append((-pieces[i][1], i, cut, p[:cut], p[cut:]))
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: Model):
    """The tokenizers pipeline of a model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unk = model.pieces[model.unk_id][0]
    if model.kind == BPE:
        core = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(model.pieces)}, merges=merges(model.pieces), unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        # control pieces never match text; a text that spells out a byte piece may differ, which parity then reports
        core = models.Unigram([(f"{NEVER}{p}" if k in (CONTROL, UNKNOWN) else p, s) for p, s, k in model.pieces], model.unk_id, model.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    out.normalizer = normalizers.Sequence(steps)
    out.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="never", split=False)
    own = [AddedToken(p, normalized=False, special=False) for p, _, k in model.pieces if k == USER_DEFINED]
    if own:
        out.add_tokens(own)
    undo = [decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(MARK, " ")]
    if model.dummy_prefix:
        undo.append(decoders.Strip(" ", 1, 0))
    out.decoder = decoders.Sequence(undo)
    return out


class Codec:
    """One process's pipeline and, for parity, the sentencepiece processor of the same model."""

    _made: dict[bytes, Codec] = {}

    def __init__(self, data: bytes):
        import sentencepiece

        self.fast = build(Model.parse(data))
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=data)

    @classmethod
    def of(cls, data: bytes, threads: int) -> Codec:
        if data not in cls._made:
            os.environ["TOKENIZERS_PARALLELISM"] = "true"
            os.environ["RAYON_NUM_THREADS"] = str(threads)
            cls._made[data] = cls(data)
        return cls._made[data]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.fast.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.fast.decode_batch(ids, skip_special_tokens=False)


def runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of about RUN_BYTES each; a longer text is a slice of its own."""
    start = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        held += n
        if held >= RUN_BYTES:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", verify: bool = True, threads: int = 2) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip, parity) for every row; whole texts, in runs of bounded size.

    round_trip: the ids decode to the text again (false where it holds the marker itself, which decodes to a space).
    parity: sentencepiece gives the same ids. Both are null if verify is false. A null text has null ids and n_ids 0 and
    passes both; an empty one has no ids. Repeated rows each keep their row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model, threads)
        for b in batches:
            for a, z in runs(b.column(1)):
                texts = b.column(1).slice(a, z - a).to_pylist()
                part = [t or "" for t in texts]
                ids = codec.encode(part)
                missing = np.array([t is None for t in texts], dtype=bool)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(ends[-1]))
                same = back = [None] * len(part)
                if verify:
                    back = [x == y for x, y in zip(codec.decode(ids), part, strict=True)]
                    other = codec.plain.encode(part, num_threads=threads, return_type="numpy")
                    same = [np.array_equal(x, flat[i:j]) for x, i, j in zip(other, ends[:-1], ends[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(missing))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, z - a), lists, pa.array(np.diff(ends).astype(np.int64)), pa.array(back, pa.bool_()), pa.array(same, pa.bool_())],
                    names=["doc_id", "ids", "n_ids", "round_trip", "parity"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_ids long, round_trip boolean, parity boolean")


def evenly(docs: DataFrame, rows: int) -> DataFrame:
    """All of docs in one task for each TASK_ROWS rows, at most 200, as a file of few row groups is read by few tasks.

    Rows go by their place, so neither copies nor repeated or missing ids meet in one task, and nothing is sorted or held.
    """
    n = min(200, -(-rows // TASK_ROWS))
    return docs.withColumn("_place", F.monotonically_increasing_id()).repartition(n, "_place").drop("_place") if n > 1 else docs


def decode(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids", threads: int = 2) -> DataFrame:
    """(doc_id, text) of rows of ids; null ids have a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model, threads)
        for b in batches:
            for a in range(0, b.num_rows, 64):
                ids = b.column(1).slice(a, 64).to_pylist()
                texts = codec.decode([x or [] for x in ids])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, 64), pa.array([t if x is not None else None for t, x in zip(texts, ids, strict=True)], pa.string())], names=["doc_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def message(values: list[tuple[int, int | bytes]]) -> bytes:
    """A protobuf message of (number, value) fields: integers as varints, bytes with their length."""
    return b"".join(varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | 2) + varint(len(v)) + v for n, v in values)


def as_unigram(data: bytes) -> bytes:
    """A unigram model over the pieces of a BPE one: the score of a piece is minus the logarithm of its rank, in sixteenths.

    Sums of such scores are exact in single precision, in which sentencepiece adds them up over a whole text.
    """
    model, rank, out = Model.parse(data), 0, []
    for piece, _, kind in model.pieces:
        rank += kind == NORMAL
        score = -round(16 * float(np.log(rank + 1))) / 16 if kind == NORMAL else 0.0
        out.append((1, varint(1 << 3 | 2) + varint(len(piece.encode())) + piece.encode() + varint(2 << 3 | 5) + struct.pack("<f", score) + message([(3, kind)])))
    spec = [(n, v) for n, v in fields(next(v for n, v in fields(data) if n == 2)) if isinstance(v, int) and n != 3]
    return message([*out, (2, message([(3, UNIGRAM), *spec])), *[(n, v) for n, v in fields(data) if n == 3]])


def default_model() -> bytes:
    import public_tokenizers

    return read_model(public_tokenizers.path("piece_bpe_32k.model"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"), default_model())
    return coded.select("doc_id", "n_ids", F.xxhash64("ids").alias("ids_digest"), "round_trip", "parity")


def sentencepiece_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codec of a unigram model, with the pieces of the default one, over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(evenly(docs, docs.count()), as_unigram(default_model()))
    return coded.select("doc_id", "n_ids", F.xxhash64("ids").alias("ids_digest"), "round_trip", "parity")
