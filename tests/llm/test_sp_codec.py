import struct

import pytest
import sentencepiece

from tallyforge.llm import sp_codec

ODD = ["", "  a  b ", "\ta\n\nb", "<s> x</s> <unk> <0x41>", "日本語 emoji 😀 \u0000", "  ", "é" * 500 + " x", "a" * 3000, "ab" * 999, "x y z", "the the  the"]


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def msg(number, body):
    return varint(number << 3 | 2) + varint(len(body)) + body


def num(number, value):
    return varint(number << 3) + varint(value)


def unigram_model(byte_fallback):
    """A small unigram model written by hand: nothing is trained."""
    words = ["▁", "▁a", "a", "b", "ab", "▁ab", "the", "▁the", "t", "h", "e", "x", "y", "▁x", "éé", "é"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256) if byte_fallback]
    pieces += [(w, -1.5 - 0.37 * i, 1) for i, w in enumerate(words)]
    out = b"".join(msg(1, msg(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + num(3, k)) for p, s, k in pieces)
    return out + msg(2, num(3, 1) + num(35, int(byte_fallback)) + num(40, 0)) + msg(3, msg(1, b"identity") + num(3, 1) + num(4, 0) + num(5, 1))


@pytest.fixture(scope="module")
def model():
    return sp_codec.default_model()


@pytest.mark.parametrize("which", ["given", "unigram", "unigram with bytes"])
def test_parity_on_odd_texts(which, model):
    data = model if which == "given" else unigram_model("bytes" in which)
    codec = sp_codec.Codec(data)
    plain = sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in ODD:
        text = text if which == "given" else text.replace("<0x41>", "")
        ids = codec.encode([text])[0]
        assert ids == plain.encode(text)
        if which != "unigram":
            assert codec.decode([ids])[0] == text


def test_documents_round_trip_with_parity(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    coded = sp_codec.encode(docs, model).cache()
    assert coded.count() == docs.count()
    assert coded.where("not round_trip or not parity or n_ids <> size(ids)").count() == 0
    back = sp_codec.decode(coded, model)
    assert back.exceptAll(docs.select("doc_id", "text")).count() == 0


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "▁ marker"), (None, "a"), (5, "word " * 60000), (5, "word " * 60000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    got = sp_codec.encode(docs, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and all(r.parity for r in got)
    assert by[1].ids is None and by[1].n_ids == 0 and by[2].ids == [] and not by[3].round_trip and by[5].round_trip
    assert sp_codec.encode(docs.limit(0), model).count() == 0
    assert sp_codec.encode(docs, model, verify=False).where("parity is null and round_trip is null").count() == 6


def test_parser_rejects_cut_and_unknown_models(model):
    with pytest.raises((ValueError, IndexError)):
        sp_codec.Model.parse(model[:1001])
    with pytest.raises(ValueError):
        sp_codec.Model.parse(msg(2, num(3, 4)))


def test_unigram_form_of_the_default_model(spark, sf_dir):
    import sentencepiece

    data = sp_codec.as_unigram(sp_codec.default_model())
    model, old = sp_codec.Model.parse(data), sp_codec.Model.parse(sp_codec.default_model())
    assert model.kind == sp_codec.UNIGRAM and model.byte_fallback == old.byte_fallback and [(p, k) for p, _, k in model.pieces] == [(p, k) for p, _, k in old.pieces]
    assert sentencepiece.SentencePieceProcessor(model_proto=data).encode("hello") == sp_codec.build(model).encode("hello", add_special_tokens=False).ids
    got = sp_codec.sentencepiece_unigram(spark, sf_dir).collect()
    assert all(r.round_trip for r in got) and sum(r.parity for r in got) >= 0.99 * len(got)


def test_rows_of_one_row_group_go_to_many_tasks(spark, tmp_path, monkeypatch):
    """Copies, repeated and missing ids spread too, and every row is encoded as in one task."""
    rows = [(None if i % 3 else 7, "the same text" if i % 2 else f"text {i}") for i in range(1000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = [len(p) for p in sp_codec.evenly(docs, 1000).rdd.glom().collect()]
    assert len(sizes) == 4 and sum(sizes) == 1000 and min(sizes) > 150
    got = sp_codec.sentencepiece_unigram(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 4
    plain = lambda df: sorted(map(str, df.collect()))
    many = plain(got)
    monkeypatch.setattr(sp_codec, "TASK_ROWS", 10_000)
    assert many == plain(sp_codec.sentencepiece_unigram(spark, str(tmp_path))) and len(many) == 1000
