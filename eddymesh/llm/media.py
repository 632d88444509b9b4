"""Media columns: ISO base media files (MP4) as binary values.

`describe` walks the nested boxes of a file, decodes the sample tables of its first track and gives codec, timescale,
duration, samples and the byte ranges of its key frames, without decoding or copying the media data: it reads box
headers and tables only. `store` makes such a file from bytes, losslessly: uncompressed grey frames of FRAME 8-bit
samples (codec "raw "), in chunks of FRAMES_A_CHUNK frames. `payload` reads the bytes of the track's samples back by
the tables.

Null and empty payloads are stored as one frame of spaces. A value that is null, truncated or no ISO file gives nulls
in every described column and a message in `error`; so does a file of movie fragments, whose samples aren't read. Rows
are handled each for itself, in runs of at most CHUNK bytes or one longer value; repeated rows give equal values, an
empty table an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddymesh.llm.common import batch, column, tidied
from eddymesh.llm.tokens import chunks

#: Bytes of a frame (16 x 12 grey samples), frames of a chunk, frames a second.
FRAME, WIDTH, HEIGHT, FRAMES_A_CHUNK, RATE = 192, 16, 12, 64, 25
#: Bytes of texts or files that are worked on at once; a longer one is alone.
CHUNK = 4 << 20
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex"}
UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def store(data: bytes) -> bytes:
    """The ISO file of a payload whose length is a positive multiple of FRAME."""
    frames, sizes = len(data) // FRAME, len(data)
    chunks = -(-frames // FRAMES_A_CHUNK)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2", b"mp41")
    last = frames - (chunks - 1) * FRAMES_A_CHUNK
    runs = [(1, FRAMES_A_CHUNK)] if chunks > 1 else []
    runs += [(chunks, last)] if chunks == 1 or last != FRAMES_A_CHUNK else []
    entry = struct.pack(">6xH16xHHIIIH32sHh", 1, WIDTH, HEIGHT, 72 << 16, 72 << 16, 0, 1, b"", 8, -1)
    large = sizes + 8 > 0xFFFFFFFF

    def moov(first: int) -> bytes:
        at = range(first, first + sizes, FRAME * FRAMES_A_CHUNK)
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), box(b"raw ", entry)),
            full(b"stts", struct.pack(">3I", 1, frames, 1)),
            full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">3I", a, n, 1) for a, n in runs]),
            full(b"stsz", struct.pack(">2I", FRAME, frames)),
            full(b"co64" if large else b"stco", struct.pack(">I", chunks), np.array(at, ">u8" if large else ">u4").tobytes()),
        )
        head = struct.pack(">4I", 0, 0, RATE, frames)
        return box(
            b"moov",
            full(b"mvhd", head, struct.pack(">IH10x", 0x10000, 0x100), UNITY, bytes(24), struct.pack(">I", 2)),
            box(
                b"trak",
                full(b"tkhd", struct.pack(">5I8x4H", 0, 0, 1, 0, frames, 0, 0, 0, 0), UNITY, struct.pack(">2I", WIDTH << 16, HEIGHT << 16), flags=3),
                box(
                    b"mdia",
                    full(b"mdhd", head, struct.pack(">HH", 0x55C4, 0)),
                    full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"payload\0"),
                    box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
                ),
            ),
        )

    mdat = struct.pack(">I4sQ", 1, b"mdat", sizes + 16) if large else struct.pack(">I4s", 8 + sizes, b"mdat")
    return b"".join((ftyp, moov(len(ftyp) + len(moov(0)) + len(mdat)), mdat, data))


def walk(view: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the body of each box, and of the boxes in those that nest."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", view, at)
        body = at + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", view, body)[0], body + 8
        size = size or end - at
        if size < body - at or at + size > end:
            raise ValueError(f"box {kind!r} at {at} reaches past its parent")
        yield kind, body, at + size
        if kind in NESTED:
            yield from walk(view, body, at + size)
        at += size


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    key: np.ndarray

    def ranges(self, which: np.ndarray | None = None) -> list[tuple[int, int]]:
        """First byte and past-the-last byte of runs of samples that lie one after another; of key frames only."""
        which = self.key if which is None else which
        first, past = self.offsets[which], (self.offsets + self.sizes)[which]
        if not len(first):
            return []
        new = np.flatnonzero(np.concatenate([[True], first[1:] != past[:-1]]))
        return list(zip(first[new].tolist(), past[np.concatenate([new[1:] - 1, [len(past) - 1]])].tolist()))


def compact_sizes(view: memoryview, at: int, end: int) -> np.ndarray:
    """Sample sizes of 4, 8 or 16 bits."""
    bits, n = view[at + 7], struct.unpack_from(">I", view, at + 8)[0]
    at += 12
    if bits not in (4, 8, 16) or at + -(-n * bits // 8) > end:
        raise ValueError("b'stz2' is shorter than its count, or of another width")
    if bits == 4:
        pairs = np.frombuffer(view, np.uint8, -(-n // 2), at)
        return np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[:n].astype(np.int64)
    return np.frombuffer(view, f">u{bits // 8}", n, at).astype(np.int64)


def track(data: bytes) -> Track:
    """The first video track that has sample tables, else the first track that has. Samples in movie fragments aren't
    read: such a file is an error."""
    view, tracks = memoryview(data), [{}]
    for kind, at, end in walk(view, 0, len(view)):
        if kind == b"moof":
            raise ValueError("movie fragments (moof) aren't read")
        if kind == b"trak":
            tracks.append({})
        tracks[-1].setdefault(kind, (at, end))
    tabled = [t for t in tracks if b"stsz" in t or b"stz2" in t]
    video = [t for t in tabled if b"hdlr" in t and bytes(view[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12]) == b"vide"]
    found = [*video, *tabled, tracks[-1]][0]
    need = [b"mdhd", b"stsd", b"stts", b"stsc", b"stz2" if b"stz2" in found else b"stsz"]
    if missing := [k.decode() for k in need if k not in found]:
        raise ValueError(f"no {', '.join(missing)} box")

    def table(kind: bytes, columns: int, skip: int = 0, form: str = ">u4") -> np.ndarray:
        at, end = found[kind]
        n = struct.unpack_from(">I", view, at + 4 + skip)[0]
        at += 8 + skip
        if at + n * columns * int(form[-1]) > end:
            raise ValueError(f"{kind!r} is shorter than its count")
        return np.frombuffer(view, form, n * columns, at).astype(np.int64).reshape(-1, columns)

    at, _ = found[b"mdhd"]
    timescale, duration = struct.unpack_from(">IQ", view, at + 20) if view[at] == 1 else struct.unpack_from(">II", view, at + 12)
    at, _ = found[b"stsd"]
    codec = bytes(view[at + 12 : at + 16]).decode("latin-1")
    if b"stsz" in found:
        at, _ = found[b"stsz"]
        each, n = struct.unpack_from(">II", view, at + 4)
        sizes = np.full(n, each, np.int64) if each else table(b"stsz", 1, 4)[:, 0]
    else:
        sizes = compact_sizes(view, *found[b"stz2"])
        n = len(sizes)
    chunks = table(b"co64", 1, form=">u8")[:, 0] if b"co64" in found else table(b"stco", 1)[:, 0]
    runs = table(b"stsc", 3)
    per_chunk = np.zeros(len(chunks), np.int64)
    for first, count, past in zip(runs[:, 0] - 1, runs[:, 1], [*(runs[1:, 0] - 1), len(chunks)]):
        per_chunk[first:past] = count
    if int(per_chunk.sum()) != n:
        raise ValueError("stsc and stsz disagree")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    held = per_chunk > 0
    offsets = np.repeat(chunks[held] - before[first[held]], per_chunk[held]) + before
    if n and int((offsets + sizes).max()) > len(view):
        raise ValueError("samples reach past the file")
    key = np.ones(n, bool)
    if b"stss" in found:  # without it every sample is a key frame
        key[:] = False
        key[table(b"stss", 1)[:, 0] - 1] = True
    return Track(codec, timescale, duration or int(table(b"stts", 2).prod(axis=1).sum()), offsets, sizes, key)


def payload(data: bytes, of: Track) -> bytes:
    return b"".join(data[a:b] for a, b in of.ranges(np.ones(len(of.sizes), bool)))


def padded(text: str | None) -> tuple[int, bytes]:
    """Length in UTF-8, and these bytes with spaces up to a positive multiple of FRAME."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(FRAME, -(-len(data) // FRAME) * FRAME), b" ")


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def stored_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names, at = column(b, "doc_id"), 0
        for part in chunks(column(b, "text"), CHUNK):
            made = [padded(t) for t in part.to_pylist()]
            yield batch(STORED, doc_id=names.slice(at, len(part)), n_bytes=[n for n, _ in made], media=[store(x) for _, x in made])
            at += len(part)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the text as an ISO file) of documents(doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda bs: tidied(stored_texts(bs)), "doc_id long, n_bytes long, media binary")


FOUND = {"codec": pa.string(), "timescale": pa.int64(), "duration": pa.int64(), "samples": pa.int64(), "key_ranges": pa.list_(pa.list_(pa.int64())), "error": pa.string()}
FOUND_DDL = "codec string, timescale long, duration long, samples long, key_ranges array<array<long>>, error string"
DIGEST = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string()}
DIGEST_DDL = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def described(batches: Iterator[pa.RecordBatch], names: list[str], digest: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = 0
        for part in chunks(column(b, "media"), CHUNK):
            rows: list[dict] = []
            for value in part:
                data, row = value.as_py(), {}
                try:
                    of = track(data)
                    row |= {"codec": of.codec, "timescale": of.timescale, "duration": of.duration, "samples": len(of.sizes), "key_ranges": of.ranges()}
                    if digest:
                        own = payload(data, of)
                        row |= {"payload_bytes": len(own), "payload_sha256": hashlib.sha256(own).hexdigest(), "tail_crc32": zlib.crc32(own[-16:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
                except (ValueError, struct.error, IndexError, TypeError) as e:
                    row["error"] = str(e) or "no media"
                rows.append(row)
            kinds = FOUND | (DIGEST if digest else {})
            kept = [b.column(b.schema.get_field_index(n)).slice(at, len(part)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()]], names=[*names, *kinds])
            at += len(part)


def describe(df: DataFrame, digest: bool = False) -> DataFrame:
    """All columns but `media`, and what the file in `media` holds; key_ranges: [first byte, past-the-last byte].
    With digest also the sizes and hashes of the payload, read back by the sample tables, and of the stored file."""
    names = [c for c in df.columns if c != "media"]
    ddl = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes if c != "media"), FOUND_DDL, *([DIGEST_DDL] if digest else [])])
    return df.mapInArrow(lambda bs: tidied(described(bs, names, digest)), ddl)
