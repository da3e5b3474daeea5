"""Media columns: signature sniffing of stored bytes.

An Aho-Corasick automaton over the magic bytes of the known formats locates candidates in one pass, wherever they
stand. A validator for each format then confirms structure and lengths; only a validated candidate counts. The format
found at offset 0 corrects a wrong declared type, and validated media further inside are carved out by offset and
length.

Payloads are stored as 8-bit mono PCM in a RIFF container: lossless, with lengths that the validator can check.

Defined results: null and empty bytes give the type ``application/octet-stream`` and nothing embedded; equal bytes give
equal results; truncated or inconsistent structures are not recognised; an empty table gives an empty one. Work is per
row, without a shuffle.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import slices, stored, table

UNKNOWN = "application/octet-stream"
UNIT = 576
TAIL = 32
#: Magic bytes, their offset from the start of the file, the validator that decides.
MAGIC = (
    (b"RIFF", 0, "riff"),
    (b"\x89PNG\r\n\x1a\n", 0, "png"),
    (b"GIF87a", 0, "gif"),
    (b"GIF89a", 0, "gif"),
    (b"\xff\xd8\xff", 0, "jpeg"),
    (b"BM", 0, "bmp"),
    (b"fLaC", 0, "flac"),
    (b"OggS", 0, "ogg"),
    (b"ftyp", 4, "mp4"),
    (b"%PDF-", 0, "pdf"),
)


@cache
def automaton() -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for magic, offset, kind in MAGIC:
        built.add_word(magic.decode("latin-1"), (len(magic), offset, kind))
    built.make_automaton()
    return built


class Finder:
    """Finds byte strings in a file from rising places on, each stretch read once."""

    def __init__(self, raw: bytes):
        self.raw, self.held = raw, {}

    def __call__(self, wanted: bytes, at: int) -> int:
        asked, found = self.held.get(wanted, (len(self.raw) + 1, 0))
        if not (asked <= at and (found < 0 or at <= found)):
            asked, found = at, self.raw.find(wanted, at)
            self.held[wanted] = asked, found
        return found


def _riff(data: memoryview) -> tuple[str, int] | None:
    if len(data) < 12:
        return None
    end = 8 + struct.unpack_from("<I", data, 4)[0]
    form = bytes(data[8:12])
    if end > len(data) or end < 12 or form not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    at, seen = 12, []
    while at + 8 <= end:
        name, length = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + length > end:
            return None
        seen.append(name)
        at += 8 + length + length % 2
    if form == b"WAVE" and not (seen[:1] == [b"fmt "] and b"data" in seen):
        return None
    return {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}[form], end


def _png(data: memoryview) -> tuple[str, int] | None:
    at, first = 8, True
    while at + 12 <= len(data):
        length, name = struct.unpack_from(">I", data, at)[0], bytes(data[at + 4 : at + 8])
        stop = at + 12 + length
        if stop > len(data) or first != (name == b"IHDR") or zlib.crc32(data[at + 4 : stop - 4]) != struct.unpack_from(">I", data, stop - 4)[0]:
            return None
        if name == b"IEND":
            return "image/png", stop
        at, first = stop, False
    return None


def _gif(data: memoryview) -> tuple[str, int] | None:
    if len(data) < 13:
        return None
    at = 13 + (3 << (data[10] & 7) + 1 if data[10] & 0x80 else 0)

    def blocks(at: int) -> int:
        while at < len(data) and data[at]:
            at += 1 + data[at]
        return at + 1

    while at < len(data):
        if data[at] == 0x3B:
            return "image/gif", at + 1
        if data[at] == 0x21:
            at = blocks(at + 2)
        elif data[at] == 0x2C and at + 10 <= len(data):
            at = blocks(at + 11 + (3 << (data[at + 9] & 7) + 1 if data[at + 9] & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(data: memoryview, start: int, find: Finder) -> tuple[str, int] | None:
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker, length = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if marker < 0xC0 or length < 2 or at + 2 + length > len(data):
            return None
        at += 2 + length
        if marker == 0xDA:
            end = find(b"\xff\xd9", start + at) - start
            return ("image/jpeg", end + 2) if end >= 0 else None
    return None


def _bmp(data: memoryview) -> tuple[str, int] | None:
    if len(data) < 26:
        return None
    size, reserved, start, header = struct.unpack_from("<IIII", data, 2)
    return ("image/bmp", size) if not reserved and header in (12, 40, 52, 56, 108, 124) and 14 + header <= start <= size <= len(data) else None


def _flac(data: memoryview) -> tuple[str, int] | None:
    return ("audio/flac", len(data)) if len(data) >= 42 and data[4] & 0x7F == 0 and int.from_bytes(data[5:8], "big") == 34 else None


def _ogg(data: memoryview, start: int = 0, dead: set[int] | None = None) -> tuple[str, int] | None:
    """``dead``: places of pages from which no last page is reached; those of this walk are added."""
    at, walked = 0, []
    while at + 27 <= len(data) and bytes(data[at : at + 4]) == b"OggS" and data[at + 4] == 0:
        if dead is not None and start + at in dead:
            break
        walked.append(start + at)
        n = data[at + 26]
        stop = at + 27 + n + sum(data[at + 27 : at + 27 + n])
        if stop > len(data):
            break
        if data[at + 5] & 4:
            return "application/ogg", stop
        at = stop
    if dead is not None:
        dead.update(walked)
    return None


def _mp4(data: memoryview) -> tuple[str, int] | None:
    at, seen = 0, []
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I", data, at)[0], bytes(data[at + 4 : at + 8])
        if size < 8 or at + size > len(data) or not name.isalnum():
            break
        seen.append(name)
        at += size
    return ("video/mp4", at) if b"ftyp" in seen[:1] and b"moov" in seen else None


def _pdf(data: memoryview, start: int, find: Finder) -> tuple[str, int] | None:
    end = find(b"%%EOF", start) - start
    return ("application/pdf", end + 5) if end >= 0 else None


VALIDATORS = {"riff": _riff, "png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "flac": _flac, "ogg": _ogg, "mp4": _mp4, "pdf": _pdf}


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of all validated media in ``data``, outermost first, none inside another of its own start.

    A page of a validated Ogg file is no file of its own; every page is walked once.
    """
    view, find, found, seen, dead, pages_end = memoryview(data), Finder(data), [], set(), set(), 0
    for last, (length, offset, kind) in automaton().iter(data.decode("latin-1")):
        start = last - length + 1 - offset
        if start >= 0 and (start, kind) not in seen:
            seen.add((start, kind))
            if kind == "ogg" and start < pages_end:
                continue
            more = (start, find) if kind in ("jpeg", "pdf") else (start, dead) if kind == "ogg" else ()
            if valid := VALIDATORS[kind](view[start:], *more):
                found.append((start, valid[1], valid[0]))
                if kind == "ogg":
                    pages_end = start + valid[1]
    return sorted(found, key=lambda x: (x[0], -x[1]))


def wav(payload: bytes) -> bytes:
    """The payload as samples of an 8-bit mono sound at 8 kHz."""
    pad = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def samples(media: bytes) -> bytes:
    """The samples of a stored sound; raises if it is not one."""
    valid = _riff(memoryview(media)) if media[:4] == b"RIFF" else None
    if not valid or valid[0] != "audio/wav":
        raise ValueError("not a valid sound")
    at = 12
    while at + 8 <= valid[1]:
        length = struct.unpack_from("<I", media, at + 4)[0]
        if media[at : at + 4] == b"data":
            return media[at + 8 : at + 8 + length]
        at += 8 + length + length % 2
    raise ValueError("no samples")


def padded(text: bytes, unit: int = UNIT) -> bytes:
    """``text`` with bytes 255 appended up to a positive multiple of ``unit``."""
    return text + b"\xff" * (max(unit, -(-len(text) // unit) * unit) - len(text))


def encode(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, declared (what the column claims: ``text/plain`` for a text, unknown without any) and media of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                raw = [x or b"" for x in part.column(text).to_pylist()]
                n = pa.array([len(x) for x in raw], pa.int64())
                media = pa.array([wav(padded(x)) for x in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, pa.array(["text/plain" if x else UNKNOWN for x in raw]), media], ["doc_id", "n_bytes", "declared", "media"])

    return docs.select("doc_id", F.col(text).cast("binary").alias(text)).mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary")


def examine(media: DataFrame) -> DataFrame:
    """The stored media with ``media_type`` (corrected), ``corrected``, ``embedded`` (offset, length, type) and the payload's digests."""
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
        "feature string, media_type string, corrected boolean, embedded array<struct<offset:long,length:long,media_type:string>>"
    )
    kinds = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("media_type", pa.string())]))
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), kinds)

    def row(data: bytes, declared: str) -> tuple:
        found = sniff(data)
        outer = next((x for x in found if x[0] == 0), None)
        kind = outer[2] if outer else UNKNOWN
        inner = [dict(offset=o, length=n, media_type=t) for o, n, t in found if o]
        payload = samples(data) if kind == "audio/wav" else data
        level = int(np.frombuffer(payload, np.uint8).sum(dtype=np.int64)) / len(payload) if payload else 0.0
        feature = f"{kind};samples={len(payload)};mean={level:.4f};embedded={len(inner)}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(data), hashlib.sha256(data).hexdigest(), feature, kind, kind != declared, inner

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                rows = [row(m or b"", d) for m, d in zip(part.column("media").to_pylist(), part.column("declared").to_pylist(), strict=True)]
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], schema=_schema(types))

    return media.mapInArrow(run, schema)


def _schema(types: tuple) -> pa.Schema:
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected", "embedded")
    return pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), *zip(names, types, strict=True)])


def carve(media: DataFrame) -> DataFrame:
    """One row for each embedded medium of (doc_id, media): doc_id, offset, media_type and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                for doc_id, data in zip(part.column("doc_id").to_pylist(), part.column("media").to_pylist(), strict=True):
                    found = [(o, n, t) for o, n, t in sniff(data or b"") if o]
                    for k in range(0, len(found), 1000):
                        some = found[k : k + 1000]
                        columns = [pa.array([doc_id] * len(some), pa.int64()), pa.array([o for o, _, _ in some], pa.int64()), pa.array([t for _, _, t in some], pa.string()), pa.array([data[o : o + n] for o, n, _ in some], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "offset", "media_type", "media"])

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, "doc_id long, offset long, media_type string, media binary")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every document as a medium, read the stored column back, sniff and digest it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = examine(stored(encode(docs), "media"))
    return found.withColumn("n_embedded", F.size("embedded").cast("long")).drop("embedded")


QUERIES = {"op9_media_columns": op9_media_columns}
ORACLE_SQL: dict[str, str] = {}
