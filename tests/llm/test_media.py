import io
import struct
import wave
import zlib

import pytest
from pyspark.sql import functions as F

from lakesync.llm import media


def wav(samples):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000), w.writeframes(samples)
    return out.getvalue()


def png():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def bmp():
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 58, 0, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd12\xff\x00\xff\xd034\xff\xd9"
OGG = b"OggS\0\x06" + b"\0" * 20 + b"\x01\x03abc"
WHOLE = {"image/png": png(), "image/bmp": bmp(), "image/gif": GIF, "image/jpeg": JPEG, "audio/ogg": OGG, "audio/wav": wav(b"\x80" * 10)}


@pytest.mark.parametrize("kind", WHOLE)
def test_whole_cut_and_embedded(kind):
    value = WHOLE[kind]
    assert media.find_media(value) == [(kind, 0, len(value))]
    assert media.find_media(b"junk BM RIFF" + value + b"tail") == [(kind, 12, len(value))]
    assert media.find_media(value[:-1]) == []


def test_media_inside_media_is_not_carved_twice():
    outer = wav(b"\x01" * 4 + png() + b"\x02" * 3)
    assert media.find_media(outer + GIF) == [("audio/wav", 0, len(outer)), ("image/gif", len(outer), len(GIF))]


def test_rows(spark):
    rows = [(1, "image/png", WHOLE["audio/wav"], 0), (2, "audio/wav", b"xx" + png() + GIF, 0), (3, None, None, 0), (3, "image/gif", b"", 0), (None, "text", b"plain", 0), (4, "x", wav(b"ab" + png() + b"cde"), 0), (5, "x", bmp(), 0)]
    got = {(r.doc_id, r.declared): r for r in media.sniff(spark.createDataFrame(rows, "doc_id long, declared string, media binary, feature int")).collect()}
    assert len(got) == 7 and got[1, "image/png"].true_type == "audio/wav" and bytes(got[1, "image/png"].samples) == b"\x80" * 10
    assert [(e.type, e.offset) for e in got[2, "audio/wav"].embedded] == [("image/png", 2), ("image/gif", 2 + len(png()))]
    assert all(got[k].true_type == media.UNKNOWN and got[k].samples is None for k in ((3, None), (3, "image/gif"), (None, "text")))
    assert [(e.type, e.offset, e.length) for e in got[4, "x"].inside] == [("image/png", 2, len(png()))] and not got[4, "x"].embedded
    assert bytes(got[5, "x"].samples) == b"\0\0\0" and media.sniff(spark.createDataFrame(rows, "doc_id long, declared string, media binary, feature int").limit(0)).count() == 0


def test_very_long_values_of_magic_bytes():
    for magic in (b"BM", b"RIFF", b"GIF89a", b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n"):
        assert media.find_media(magic * 30_000) == []
    assert media.find_media(b"BM" * 50_000 + GIF) == [("image/gif", 100_000, len(GIF))]


def test_both_containers_give_the_payload_back(spark):
    texts = [f"text number {i} " * (i + 1) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", media.pad_payload(F.col("text")).alias("payload"))
    rows = media.sniff(docs.select("doc_id", media.declare(F.col("payload")).alias("declared"), media.contain(F.col("payload")).alias("media"))).collect()
    assert {r.true_type for r in rows} == {"audio/wav", "image/bmp"} and len({r.declared for r in rows}) == 4
    assert all(bytes(r.samples).rstrip().decode() == texts[r.doc_id].rstrip() and not r.embedded for r in rows)


def test_payload_round_trip(spark):
    texts = [None, "", "a", "é" * 96, "x" * 193, "RIFF WAVE BM GIF89a " * 40]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    stored = docs.select("doc_id", F.lit("x").alias("declared"), media.to_wav(media.pad_payload(F.col("text"))).alias("media"))
    for r in media.sniff(stored).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert bytes(r.samples) == raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw)) and r.true_type == "audio/wav"
    for r in stored.collect():
        with wave.open(io.BytesIO(bytes(r.media))) as w:
            assert w.getparams()[:3] == (1, 1, 8000) and w.getnframes() == len(r.media) - 44
