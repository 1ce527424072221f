import hashlib
import random
import struct
import zlib

import pytest

from sparkloom.llm.media import FRAME, box, full, op4_iso_media, pad_payload, read_media, sample_bytes, store_media, walk, write_media


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 192 * 12, 192 * 16 + 1, 192 * 33, 100_000])
def test_round_trip(size):
    data = random.Random(size).randbytes(size)
    payload = pad_payload(data)
    assert len(payload) % FRAME == 0 and len(payload) > 0 and payload[:size] == data and set(payload[size:]) <= {32}
    media = write_media(payload)
    (track,) = read_media(media)
    assert sample_bytes(media, track) == payload
    assert (track.codec, track.width, track.height, len(track.sizes)) == ("raw ", 16, 12, len(payload) // FRAME)
    assert track.ticks / track.timescale == len(track.sizes) / 25
    assert track.keys.tolist() == list(range(1, len(track.sizes) + 1, 12))
    first = track.offsets[track.keys[-1] - 1]
    assert media[first : first + FRAME] == payload[(track.keys[-1] - 1) * FRAME :][:FRAME]


def test_boxes_nest():
    media = write_media(pad_payload(b"text"))
    paths = [b"/".join(p) for p, _, _ in walk(memoryview(media), 0, len(media))]
    assert b"moov/trak/mdia/minf/stbl/stsz" in paths and paths[0] == b"ftyp" and paths[-1] == b"mdat"


def other_file(wide=False, samples=((3, b"abc"), (5, b"defgh"), (2, b"ij"), (4, b"klmn"))):
    """A file by hand: samples of different sizes in two chunks with a gap, no sync table, times in two runs."""
    ftyp = box(b"ftyp", b"qt  ", bytes(4))
    first, second = b"".join(s for _, s in samples[:3]), samples[3][1]
    at = len(ftyp) + 8 + 8 * wide
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(24), struct.pack(">HH", 640, 360), bytes(50))),
        full(b"stts", struct.pack(">IIIII", 2, 3, 100, 1, 700)),
        full(b"stsz", struct.pack(">II", 0, 4), *[struct.pack(">I", n) for n, _ in samples]),
        full(b"stsc", struct.pack(">I", 2), struct.pack(">III", 1, 3, 1), struct.pack(">III", 2, 1, 1)),
        full(b"co64", struct.pack(">IQQ", 2, at, at + len(first) + 7)),
    )
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), full(b"hdlr", bytes(4), b"vide", bytes(13)), box(b"minf", stbl))
    body = first + b"-------" + second
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(body) + 16) + body if wide else box(b"mdat", body)
    return ftyp + mdat + box(b"moov", box(b"trak", mdia))


@pytest.mark.parametrize("wide", [False, True])
def test_other_layouts(wide):
    media = other_file(wide)
    (track,) = read_media(media)
    assert sample_bytes(media, track) == b"abcdefghijklmn" and track.ticks / track.timescale == 1.0
    assert (track.codec, track.width, track.height, track.keys) == ("avc1", 640, 360, None)


def test_broken_files_have_an_error(spark):
    good = other_file()
    broken = [good[:-30], b"\0\0\0\x04ftyp", good.replace(struct.pack(">II", 0, 4), struct.pack(">II", 0, 9)), b"", b"no media at all"]
    rows = spark.createDataFrame([(k, m) for k, m in enumerate([*broken, good])], "id int, file binary")
    out = {r["id"]: r for r in store_media(rows, "file", given=True).collect()}
    assert all(out[k]["error"] and out[k]["payload"] is None for k in range(len(broken)))
    last = out[len(broken)]
    assert last["error"] is None and last["samples"] == 4 and list(last["keyframe_bytes"]) == [3, 5, 2, 4]
    with pytest.raises(ValueError, match="in use"):
        store_media(rows.selectExpr("id AS codec", "file"), "file")


def test_query(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r for r in op4_iso_media(spark, str(tmp_path)).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    for r in rows:
        payload = pad_payload((r["text"] or "").encode())
        media = write_media(payload)
        wanted = (len((r["text"] or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
        assert tuple(found[r["doc_id"]])[1:7] == wanted
    assert len({r["feature"] for r in found.values()}) > 3
