"""ISO media containers: a writer for raw 8-bit samples and a reader that never decodes payloads.

The reader walks nested boxes, expands the sample tables (sizes, chunks, times, sync samples) and gives each track's
codec, duration and the byte ranges of its keyframes. The writer stores a payload as 16 x 12 frames of 8-bit grey, a
sample of 192 bytes each, every twelfth a keyframe, with the movie box before the data.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, read_table, release, slices, text_buffer

#: Fixed values of the container format: boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: The unity transformation matrix of movie and track headers.
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

WIDTH, HEIGHT, RATE, KEY_EVERY, CHUNK = 16, 12, 25, 12, 16
FRAME = WIDTH * HEIGHT


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def pad_payload(data: bytes) -> bytes:
    """``data`` and then spaces up to a positive multiple of the frame size."""
    return data.ljust(max(1, -(-len(data) // FRAME)) * FRAME, b" ")


def write_media(payload: bytes) -> bytes:
    """A file whose one video track holds ``payload`` (a positive multiple of 192 bytes) as raw grey frames."""
    frames = len(payload) // FRAME
    if frames < 1 or len(payload) % FRAME:
        raise ValueError("the payload must be a positive multiple of a frame")
    chunks = -(-frames // CHUNK)
    rest = frames - (chunks - 1) * CHUNK
    runs = [(1, CHUNK), (chunks, rest)] if rest != CHUNK and chunks > 1 else [(1, rest if chunks == 1 else CHUNK)]
    keys = np.arange(1, frames + 1, KEY_EVERY, dtype=">u4")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")

    def movie(first: int) -> bytes:
        places = first + np.arange(chunks, dtype=np.int64) * CHUNK * FRAME
        wide = places[-1] >= 1 << 32
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, frames, 1)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", at, n, 1) for at, n in runs]),
            full(b"stsz", struct.pack(">II", FRAME, frames)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), places.astype(">u8" if wide else ">u4").tobytes()),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0))
        hdlr = full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0")
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, frames, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    size = len(payload) + 8
    head = struct.pack(">I4s", size, b"mdat") if size < 1 << 32 else struct.pack(">I4sQ", 1, b"mdat", size + 8)
    lead = len(ftyp) + len(head)
    moov = movie(lead + len(movie(0)))
    moov = movie(lead + len(moov))
    return ftyp + moov + head + payload


def walk(data: memoryview, start: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Path, first and last byte of the body of each box, depth first. A broken size raises ValueError."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a box header is cut off")
            (size,), body = struct.unpack_from(">Q", data, body), start + 16
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} at {start} reaches out of its parent")
        yield (*path, kind), body, stop
        if kind in CONTAINERS:
            yield from walk(data, body, stop, (*path, kind))
        start = stop


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    width: int = 0
    height: int = 0
    timescale: int = 0
    ticks: int = 0
    sizes: np.ndarray | None = None
    offsets: np.ndarray | None = None
    keys: np.ndarray | None = None


def _table(data: memoryview, at: int, end: int, kind: str, columns: int = 1) -> np.ndarray:
    (count,) = struct.unpack_from(">I", data, at + 4)
    if at + 8 + count * columns * np.dtype(kind).itemsize > end:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, kind, count * columns, at + 8).astype(np.int64).reshape(-1, columns)


def read_media(raw: bytes) -> list[Track]:
    """The tracks of a file. Sample bytes are located, not decoded; a malformed file raises ValueError."""
    data, tracks, chunks, runs = memoryview(raw), [], None, None
    try:
        for path, at, end in walk(data, 0, len(data)):
            kind, now = path[-1], tracks[-1] if tracks else None
            if kind == b"trak":
                tracks.append(Track())
                chunks = runs = None
            elif b"trak" not in path:
                continue
            elif kind == b"mdhd":
                now.timescale, now.ticks = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
            elif kind == b"hdlr":
                now.handler = bytes(data[at + 8 : at + 12]).decode("latin-1")
            elif kind == b"stsd":
                now.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
                if now.handler == "vide":
                    now.width, now.height = struct.unpack_from(">HH", data, at + 40)
            elif kind == b"stts":
                times = _table(data, at, end, ">u4", 2)
                now.ticks = int((times[:, 0] * times[:, 1]).sum()) or now.ticks
            elif kind == b"stss":
                now.keys = _table(data, at, end, ">u4")[:, 0]
            elif kind == b"stsz":
                one, count = struct.unpack_from(">II", data, at + 4)
                now.sizes = np.full(count, one, np.int64) if one else _table(data, at + 4, end, ">u4")[:, 0]
            elif kind == b"stsc":
                runs = _table(data, at, end, ">u4", 3)
            elif kind in (b"stco", b"co64"):
                chunks = _table(data, at, end, ">u4" if kind == b"stco" else ">u8")[:, 0]
            if now is not None and now.offsets is None and now.sizes is not None and runs is not None and chunks is not None:
                now.offsets = _locate(now.sizes, runs, chunks)
                if len(now.sizes) and int((now.offsets + now.sizes).max()) > len(data):
                    raise ValueError("a sample lies outside the file")
                if now.keys is not None and len(now.keys) and not 1 <= now.keys.min() <= now.keys.max() <= len(now.sizes):
                    raise ValueError("a sync sample does not exist")
    except (struct.error, IndexError) as error:
        raise ValueError(f"malformed file: {error}") from None
    return tracks


def _locate(sizes: np.ndarray, runs: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Each sample's place in the file from the chunks' places and the runs of equal chunk lengths."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    if not len(runs) or runs[0, 0] != 1:
        raise ValueError("the chunk runs do not start at the first chunk")
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
    chunk = np.repeat(np.arange(len(chunks)), per)[: len(sizes)]
    if len(chunk) < len(sizes):
        raise ValueError("the chunks hold too few samples")
    before = np.cumsum(sizes) - sizes
    first = np.searchsorted(chunk, np.arange(len(chunks)))
    return chunks[chunk] + before - before[np.minimum(first, len(sizes) - 1)][chunk]


def sample_bytes(raw: bytes, track: Track) -> bytes:
    """The bytes of all samples in order, read through the sample tables."""
    if not len(track.sizes):
        return b""
    ends = track.offsets + track.sizes
    cuts = np.flatnonzero(ends[:-1] != track.offsets[1:]) + 1
    starts = track.offsets[np.concatenate([[0], cuts])]
    stops = ends[np.concatenate([cuts - 1, [len(ends) - 1]])]
    return b"".join(raw[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True))


TRACK_FIELDS = fields(media="binary", payload="binary", codec="string", width="int", height="int", samples="long", duration="double", keyframe_starts=T.ArrayType(T.LongType()), keyframe_bytes=T.ArrayType(T.LongType()), error="string")


def _rows(payloads: Iterator[bytes], given: bool) -> Iterator[tuple]:
    for data in payloads:
        media = data if given else write_media(pad_payload(data))
        try:
            track = next((t for t in read_media(media) if t.offsets is not None), None)
            if track is None:
                raise ValueError("no track with samples")
        except ValueError as error:
            yield media, None, None, None, None, None, None, None, None, str(error)
            continue
        keys = np.arange(len(track.sizes)) if track.keys is None else track.keys - 1
        seconds = track.ticks / track.timescale if track.timescale else None
        yield media, sample_bytes(media, track), track.codec, track.width, track.height, len(track.sizes), seconds, track.offsets[keys].tolist(), track.sizes[keys].tolist(), None


def store_media(df: DataFrame, column: str, given: bool = False) -> DataFrame:
    """``df`` without ``column``, plus the stored file and what its sample tables say (TRACK_FIELDS).

    ``given`` False: the column is text or bytes (null: empty) and is stored as a new file. True: the column holds
    files. ``payload`` is read back from the stored bytes. A file that cannot be walked has ``error`` and nulls; nothing
    is dropped. Other columns pass through; a column with one of the new names raises ValueError.
    """
    rest = [c for c in df.columns if c != column]
    if clash := set(rest) & set(TRACK_FIELDS.fieldNames()):
        raise ValueError(f"column names in use: {sorted(clash)}")
    schema = T.StructType([df.schema[c] for c in rest] + TRACK_FIELDS.fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(TRACK_FIELDS)

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(batch.num_columns - 1))
            for a, b in slices(offsets):
                found = list(_rows((data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)), given))
                made = [pa.array([r[k] for r in found], field.type) for k, field in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], *made], names=[*rest, *arrow.names])
            release()

    return df.select(*rest, F.col(column)).mapInArrow(run, schema)


def op4_iso_media(spark, sf_dir: str) -> DataFrame:
    """Every text of documents as a stored file, and the digest of what is read back from it."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    out = store_media(docs, "text")
    keys = F.aggregate(F.zip_with("keyframe_starts", "keyframe_bytes", lambda a, b: a * 31 + b), F.lit(0).cast("long"), lambda s, x: s + x)
    feature = F.format_string("%s %dx%d samples=%d duration=%.2f keyframes=%d ranges=%d", "codec", "width", "height", "samples", "duration", F.size("keyframe_starts"), keys)
    tail = F.crc32(F.substring("payload", -16, 16))
    return out.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
