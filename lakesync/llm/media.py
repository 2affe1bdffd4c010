"""Media columns: storing bytes as media, and finding out what stored bytes really are.

`sniff` runs an Aho-Corasick automaton of magic bytes over each value. Every hit is put to a validator of its format,
which walks the structure (chunks, segments, blocks) and returns the length that the format itself claims; hits whose
structure does not hold, or whose claimed length leaves the value, are dropped. The first valid hit at offset 0 corrects
the declared type; valid hits elsewhere, outside one another, are carved as embedded media, and so are those inside the samples of the
file at offset 0 (sound or bitmap), which are read back as its format has them.

`contain` stores bytes as the samples of a WAV file or the pixels of a bitmap; which one, and the type that is declared for it, follow from
the bytes alone. Very long values are read once by the automaton, and by a validator for each hit that is not inside media found before.

Null and empty values have no type (``application/octet-stream``) and nothing embedded. Rows are independent; repeated
rows repeat. Columns other than those named are kept out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "application/octet-stream"
SAMPLE_RATE = 8_000


def _png(b: bytes, at: int) -> int:
    i = at + 8
    while i + 12 <= len(b):
        size = int.from_bytes(b[i : i + 4], "big")
        if i + 12 + size > len(b) or zlib.crc32(b[i + 4 : i + 8 + size]) != int.from_bytes(b[i + 8 + size : i + 12 + size], "big"):
            return 0
        kind, i = b[i + 4 : i + 8], i + 12 + size
        if kind == b"IEND":
            return i - at
    return 0


def _jpeg(b: bytes, at: int) -> int:
    i, scan = at + 2, False
    while i + 4 <= len(b) and b[i] == 0xFF:
        kind = b[i + 1]
        if kind == 0xD9:
            return i + 2 - at if scan else 0
        size = int.from_bytes(b[i + 2 : i + 4], "big")
        if size < 2 or i + 2 + size > len(b):
            return 0
        i += 2 + size
        if kind == 0xDA:
            scan = True
            while True:  # entropy-coded data: up to a marker that is neither stuffing nor a restart
                i = b.find(b"\xff", i)
                if i < 0 or i + 1 >= len(b):
                    return 0
                if b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7:
                    i += 2
                    continue
                break
            if b[i + 1] == 0xD9:
                return i + 2 - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    i = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)

    def blocks(i: int) -> int:
        while i < len(b) and b[i]:
            i += b[i] + 1
        return i + 1

    while i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 < len(b):
            i = blocks(i + 11 + (3 << ((b[i + 9] & 7) + 1) if b[i + 9] & 0x80 else 0))
        else:
            return 0
    return 0


def _bmp(b: bytes, at: int) -> int:
    if at + 54 > len(b):
        return 0
    size, _, _, start, header, width, height, planes, bits = struct.unpack_from("<IHHIIiiHH", b, at + 2)
    if header not in (40, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return 0
    row = (width * bits + 31) // 32 * 4
    return size if start >= 14 + header and start + row * abs(height) <= size <= len(b) - at else 0


def _riff(b: bytes, at: int) -> int:
    if at + 12 > len(b) or b[at + 8 : at + 12] not in (b"WAVE", b"WEBP"):
        return 0
    size = 8 + struct.unpack_from("<I", b, at + 4)[0]
    if at + size > len(b):
        return 0
    i, kinds = at + 12, set()
    while i + 8 <= at + size:
        kinds.add(b[i : i + 4])
        i += 8 + (n := struct.unpack_from("<I", b, i + 4)[0]) + (n & 1)
    need = {b"fmt ", b"data"} if b[at + 8 : at + 12] == b"WAVE" else set()
    return size if i == at + size and need <= kinds and kinds else 0


def _ogg(b: bytes, at: int) -> int:
    i, done = at, False
    while not done and b[i : i + 4] == b"OggS" and i + 27 <= len(b):
        n = b[i + 26]
        if i + 27 + n > len(b):
            return 0
        done = bool(b[i + 5] & 4)
        i += 27 + n + sum(b[i + 27 : i + 27 + n])
    return i - at if done and i <= len(b) else 0


#: Magic bytes, and who confirms them. Fixed values of the formats.
FORMATS: dict[bytes, tuple[str, Callable[[bytes, int], int]]] = {
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"BM": ("image/bmp", _bmp),
    b"RIFF": ("audio/wav", _riff),
    b"OggS": ("audio/ogg", _ogg),
}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic in FORMATS:
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def find_media(value: bytes | None) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the valid media in value, in order and outside one another."""
    if not value:
        return []
    out, free = [], 0
    for last, magic in automaton().iter(value.decode("latin-1")):
        at = last + 1 - len(magic)
        if at < free:
            continue  # inside media that was found already
        kind, validate = FORMATS[magic]
        if length := validate(value, at):
            if kind == "audio/wav" and value[at + 8 : at + 12] == b"WEBP":
                kind = "image/webp"
            out.append((kind, at, length))
            free = at + length
    return out


def wav_payload(value: bytes, at: int) -> bytes:
    """The samples in the data chunk of the WAV file at an offset that find_media has confirmed."""
    i = at + 12
    while True:
        n = struct.unpack_from("<I", value, i + 4)[0]
        if value[i : i + 4] == b"data":
            return value[i + 8 : i + 8 + n]
        i += 8 + n + (n & 1)


def bmp_payload(value: bytes, at: int) -> bytes:
    """The pixels of the bitmap at an offset that find_media has confirmed, in the file's order and without the rows' filling."""
    start, width, height, bits = (*struct.unpack_from("<I", value, at + 10), *struct.unpack_from("<ii", value, at + 18), *struct.unpack_from("<H", value, at + 28))
    row, own, low = (width * bits + 31) // 32 * 4, width * bits // 8, at + start
    if row == own:
        return value[low : low + row * abs(height)]
    return b"".join(value[low + i * row : low + i * row + own] for i in range(abs(height)))


#: Formats whose samples are read back.
PAYLOAD = {"audio/wav": wav_payload, "image/bmp": bmp_payload}


def le(number: Column, octets: int) -> Column:
    """A whole number as so many little-endian bytes."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftrightunsigned(number, 8 * i).bitwiseAND(F.lit(255))), 2, "0")) for i in range(octets)])


def to_wav(payload: Column, rate: int = SAMPLE_RATE) -> Column:
    """Bytes as the 8-bit mono samples of a WAV file. Takes an even number of bytes."""
    n = F.octet_length(payload).cast("long")
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return F.concat(F.lit(b"RIFF"), le(n + 36, 4), F.lit(b"WAVE" + fmt + b"data"), le(n, 4), payload)


def to_bmp(payload: Column, width: int = 8) -> Column:
    """Bytes as the pixels of a bitmap of 24 bits, `width` pixels wide. Takes a multiple of 3 * width bytes; rows need no filling if that is one of 4."""
    n = F.octet_length(payload).cast("long")
    head = F.concat(F.lit(b"BM"), le(n + 54, 4), F.lit(struct.pack("<HHIIi", 0, 0, 54, 40, width)))
    return F.concat(head, le(F.floor(n / (3 * width)), 4), F.lit(struct.pack("<HHI", 1, 24, 0)), le(n, 4), F.lit(b"\0" * 16), payload)


def _draw(payload: Column, digit: int) -> Column:
    """A number from 0 to 15 that the bytes decide."""
    return F.conv(F.substring(F.md5(payload), digit, 1), 16, 10).cast("int")


def contain(payload: Column) -> Column:
    """Bytes (a positive multiple of 24) as a sound or a bitmap."""
    return F.when(_draw(payload, 1) % 2 == 0, to_wav(payload)).otherwise(to_bmp(payload))


def pad_payload(text: Column, unit: int = 192) -> Column:
    """The UTF-8 bytes of a text with spaces up to a positive multiple of `unit`."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    lack = F.greatest(F.ceil(F.octet_length(raw) / unit), F.lit(1)) * unit - F.octet_length(raw)
    return F.concat(raw, F.encode(F.repeat(F.lit(" "), lack.cast("int")), "UTF-8"))


def describe(samples: bytes) -> str:
    """Features of 8-bit samples: number, mean, root mean square, and how often they cross the middle."""
    x = np.frombuffer(samples, np.uint8)
    if not len(x):
        return "n=0"
    counts = np.bincount(x, minlength=256).astype(np.int64)
    value = np.arange(256, dtype=np.int64)
    crossed = int(np.count_nonzero(np.diff(x >= 128)))
    return f"n={len(x)};mean={int((counts * value).sum()) / len(x):.4f};rms={(int((counts * (value - 128) ** 2).sum()) / len(x)) ** 0.5:.4f};crossings={crossed}"


def sniff(media: DataFrame, value: str = "media", declared: str = "declared", key: str = "doc_id") -> DataFrame:
    """key, declared type, true type, embedded [(type, offset, length)], inside (the same within the samples), and the samples of the file at offset 0 with their features."""
    kind = media.schema[key].dataType.simpleString()
    found_type = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                true, inner, inside, samples, digest, feature = [], [], [], [], [], []
                for b in part.column(value).to_pylist():
                    found = find_media(b)
                    at_start = bool(found) and found[0][1] == 0
                    true.append(found[0][0] if at_start else UNKNOWN)
                    inner.append([{"type": t, "offset": o, "length": n} for t, o, n in found[at_start:]])
                    samples.append(PAYLOAD[found[0][0]](b, 0) if at_start and found[0][0] in PAYLOAD else None)
                    # what the samples carry; offsets count from where they begin
                    inside.append([{"type": t, "offset": o, "length": n} for t, o, n in find_media(samples[-1])])
                    digest.append(None if b is None else hashlib.sha256(b).hexdigest())
                    feature.append(None if samples[-1] is None else describe(samples[-1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), part.column(declared), pa.array(true), pa.array(inner, found_type), pa.array(inside, found_type), pa.array(samples, pa.binary()), pa.array(digest, pa.string()), pa.array(feature, pa.string())],
                    names=["key", "declared", "true_type", "embedded", "inside", "samples", "media_sha256", "feature"],
                )

    rows = media.select(F.col(key), F.col(declared), F.col(value))
    out = rows.mapInArrow(run, f"key {kind}, declared string, true_type string, embedded array<struct<type:string,offset:long,length:long>>, inside array<struct<type:string,offset:long,length:long>>, samples binary, media_sha256 string, feature string")
    return out.withColumnRenamed("key", key)


def declare(payload: Column) -> Column:
    """A declared type as crawls carry them, often wrong: decided by the bytes."""
    kinds = ["image/png", "audio/wav", "image/bmp", "audio/ogg"]
    return F.element_at(F.array(*map(F.lit, kinds)), _draw(payload, 2) % len(kinds) + 1)
