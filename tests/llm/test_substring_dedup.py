import hashlib
import re

import numpy as np
import pytest

from sparkloom.llm.blocks import answers, cut_points, told
from sparkloom.llm.common import pack_sorted, slices, unpack_sorted, word_hashes, word_spans
from sparkloom.llm.substring_dedup import op9_rabin_karp_dedup, substring_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, size=13):
    key = lambda k: float("inf") if k is None else k
    said, first = [WORD.findall((t or "").encode()) for _, t in rows], {}
    for (k, _), w in zip(rows, said, strict=True):
        for i in range(len(w) - size + 1):
            window = tuple(w[i : i + size])
            first[window] = min(first.get(window, key(k)), key(k))
    out = []
    for (k, _), w in zip(rows, said, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < key(k):
                gone[i : i + size] = [True] * size
        spans = [(i, next((j for j in range(i, len(w)) if not gone[j]), len(w)) - i) for i in range(len(w)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((k, len(w), sum(gone), spans, b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


def found(df, key="doc_id"):
    return sorted(((r[key], r["n_words"], r["n_removed"], [tuple(s) for s in r["removed"]], r["kept"]) for r in df.collect()), key=repr)


def test_equals_brute_force(spark, docs, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(substring_dedup(docs, "doc_id", "text")) == brute(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: tuple(r)[1:5] for r in op9_rabin_karp_dedup(spark, str(tmp_path)).collect()}
    assert out == {k: (n, lost, hashlib.sha256(kept.encode()).hexdigest(), len(spans)) for k, n, lost, spans, kept in brute(rows)}


def test_edges(spark):
    text = " ".join(str(k) for k in range(20))
    rows = [(1, text), (1, text), (None, text), (None, "x " + text), (-5, " ".join(str(k) for k in range(3, 16))), (9, "a " * 30), (2, "a " * 13), (3, None), (4, "")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, extra string").repartition(3)
    out = substring_dedup(df, "doc_id", "text")
    assert found(out) == brute(rows) and out.columns[:3] == ["doc_id", "text", "extra"]
    assert found(substring_dedup(df, "doc_id", "text", size=2)) == brute(rows, 2)
    assert substring_dedup(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError, match="in use"):
        substring_dedup(df.withColumnRenamed("extra", "kept"), "doc_id", "text")


def test_words_and_hashes():
    texts = [b"a  b\x0bc", b"", b" lead", b"trail\n", b"x" * 300, "é è".encode(), b"a b"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    starts, ends, first = word_spans(data, offsets)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [w for t in texts for w in WORD.findall(t)]
    assert np.diff(first).tolist() == [len(WORD.findall(t)) for t in texts]
    said = [w for t in texts for w in WORD.findall(t)]
    hashes = word_hashes(data, starts, ends).tolist()
    assert len(set(hashes)) == len(set(said)) and all((a == b) == (x == y) for a, x in zip(hashes, said, strict=True) for b, y in zip(hashes, said, strict=True))


def test_blobs():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000):
        values = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (unpack_sorted(pack_sorted(values)) == values).all() and len(unpack_sorted(pack_sorted(values))) == len(values)
    assert unpack_sorted(pack_sorted(np.array([5, 5, 5], np.uint64))).tolist() == [5, 5, 5]
    values = np.sort(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    cut = cut_points(values, 7)
    assert cut[0] == 0 and cut[-1] == 5000 and np.diff(cut).min() > 500
    table = answers(np.array([2, 1, 2]), np.array([9, 5, 3], np.uint64), np.array([1, 2, 3], np.uint8))
    hashes, extra = told(table.filter(table.column("block").to_numpy() == 2), np.uint8)
    assert hashes.tolist() == [3, 9] and extra.tolist() == [3, 1]
    assert answers(np.zeros(0, int), np.zeros(0, np.uint64)).num_rows == 0
    assert slices(np.array([0, 5, 5, 100, 101]), 10) == [(0, 2), (2, 3), (3, 4)]


@pytest.mark.parametrize("block_bytes, ranges", [(2000, 3), (300, 1), (4000, 50)])
def test_ranges_of_several_blocks(spark, docs, block_bytes, ranges):
    """Ranges with more bytes than a block: hashes that only blocks of one range share are settled by a second exchange."""
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(substring_dedup(docs, "doc_id", "text", 13, block_bytes, ranges)) == brute(rows)


def test_a_third_of_all_rows_under_one_id_or_none(spark):
    rng = np.random.default_rng(7)
    shared = " ".join(f"s{k}" for k in range(40))
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, 30)) + (" " + shared if k % 3 else "") for k in range(240)]
    rows = [(7 if k % 3 == 0 else None if k % 3 == 1 else k, t) for k, t in enumerate(texts)] + [(7, texts[0])] * 5 + [(None, shared)] * 3 + [(3, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for block_bytes in (1000, 4 << 20):
        assert found(substring_dedup(df, "doc_id", "text", 13, block_bytes)) == brute(rows)


def test_one_very_long_text_and_columns_of_any_name(spark):
    long = " ".join(f"{k * k % 1009}" for k in range(300_000))
    rows = [(1, " ".join(str(k * k % 1009) for k in range(1000))), (2, long), (0, "a b c")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, `__block` string, column_1 string, kind string")
    out = substring_dedup(df, "doc_id", "text", block_bytes=5000)
    assert found(out) == brute(rows) and {(r["__block"], r["column_1"], r["kind"]) for r in out.collect()} == {("x", "y", "z")}
