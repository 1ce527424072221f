import hashlib
import random

import numpy as np
import pytest

from sparkloom.llm import suffix_dedup as module
from sparkloom.llm.suffix_dedup import Rolling, contexts, merge_transforms, op8_suffix_dedup, repeated_windows, shard_transform, sort_suffixes, suffix_dedup, window_minima


def brute(texts, size):
    """Removed runs and kept bytes of each text."""
    count = {}
    for t in texts:
        for k in range(len(t) - size + 1):
            count[t[k : k + size]] = count.get(t[k : k + size], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - size + 1):
            if count[t[k : k + size]] > 1:
                gone[k : k + size] = [True] * size
        spans = [(i, next((j for j in range(i, len(t)) if not gone[j]), len(t)) - i) for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def found(df):
    return sorted(((r["doc_id"], (r["n_bytes"], r["n_removed"], [tuple(s) for s in r["removed"]], bytes(r["kept"]))) for r in df.collect()), key=repr)


def wanted(rows, size):
    return sorted(zip([r[0] for r in rows], brute([(r[1] or "").encode() for r in rows], size), strict=True), key=repr)


@pytest.mark.parametrize("family", [0, 3, 64])
def test_equals_brute_force(spark, docs, monkeypatch, family):
    monkeypatch.setattr(module, "FAMILY", family)  # 0: windows are counted everywhere; 64: transforms are merged
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for size in (400, 64):
        assert found(suffix_dedup(docs, "doc_id", "text", size)) == wanted(rows, size)


def test_query(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = {r["doc_id"]: tuple(r)[1:] for r in op8_suffix_dedup(spark, str(tmp_path)).collect()}
    assert out == {k: (n, lost, len(spans), hashlib.sha256(kept).hexdigest()) for k, (n, lost, spans, kept) in wanted(rows, 400)}


def test_low_entropy_and_edges(spark):
    rng = random.Random(6)
    texts = ["ab" * 40, "ab" * 20 + "c" + "ab" * 30, "a" * 70, None, "", "x", "".join(rng.choice("ab") for _ in range(300)), "".join(rng.choice("ab") for _ in range(300))]
    rows = [(None if k == 2 else 3 if k > 5 else k, t) for k, t in enumerate(texts)] + [(3, texts[6])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int").repartition(2)
    for size in (16, 24, 40):
        out = suffix_dedup(df, "doc_id", "text", size)
        assert found(out) == wanted(rows, size) and out.columns[:3] == ["doc_id", "text", "n"]
    assert suffix_dedup(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError, match="in use"):
        suffix_dedup(df.withColumnRenamed("n", "kept"), "doc_id", "text")
    with pytest.raises(ValueError, match="multiple"):
        suffix_dedup(df, "doc_id", "text", 33)


def test_whole_characters(spark):
    shared = "éè" * 30
    df = spark.createDataFrame([(1, "ß" + shared + "ü"), (2, "à" + shared + "û")], "doc_id long, text string")
    bare = {r["doc_id"]: r for r in suffix_dedup(df, "doc_id", "text", 64).collect()}
    out = {r["doc_id"]: r for r in suffix_dedup(df, "doc_id", "text", 64, whole_characters=True).collect()}
    assert {k: bytes(r["kept"]).decode() for k, r in out.items()} == {1: "ßü", 2: "àû"}
    assert all(out[k]["n_removed"] <= bare[k]["n_removed"] for k in out)


def naive_order(strings, step):
    """Suffixes of each chain as tuples of symbols."""
    return [tuple(s[i : i + step] for i in range(p, len(s) - step + 1, step)) for s in strings for p in range(len(s) - step + 1)]


def test_transforms_merge_to_the_order_of_all_suffixes():
    rng = np.random.default_rng(4)
    chains = [rng.integers(0, 3, rng.integers(1, 40)) for _ in range(9)]
    shards = [chains[:4], chains[4:5], chains[5:]]
    transforms, ends, suffixes = [], [], []
    for shard in shards:
        symbols = np.concatenate(shard).astype(np.int32)
        length = np.array([len(c) for c in shard])
        last = np.cumsum(length) - 1
        after = np.arange(1, len(symbols) + 1)
        after[last] = len(symbols)
        before = np.arange(-1, len(symbols) - 1)
        before[np.cumsum(length) - length] = -1
        rows, transform = shard_transform(symbols, after, before)
        transforms.append(transform)
        ends.append(len(shard))
        whole = [tuple(c[k:].tolist()) for c in shard for k in range(len(c))] + [()] * len(shard)
        suffixes.append([whole[r] for r in rows])
    depth = 8
    assert [s[:depth] for s in suffixes[0]] == sorted(s[:depth] for s in suffixes[0])
    merged, block = merge_transforms(transforms, ends, depth)
    at, order = [0, 0, 0], []
    for shard in merged.tolist():
        order.append(suffixes[shard][at[shard]][:depth])
        at[shard] += 1
    assert order == sorted(order)
    assert all((block[k] == block[k + 1]) == (order[k] == order[k + 1]) for k in range(len(order) - 1))


def test_repeated_windows():
    rng = random.Random(2)
    shared = bytes(rng.randrange(256) for _ in range(90))
    strings = [[b"abc" + shared + b"d", b"zz" + shared[10:]], [shared[:63], b"q" * 50], [b"q" * 70 + shared[5:80]]]
    shards = [(np.frombuffer(b"".join(s), np.uint8), np.cumsum([0, *map(len, s)])) for s in strings]
    marks = repeated_windows(shards, 64)
    flat = [t for s in strings for t in s]
    count = {}
    for t in flat:
        for k in range(len(t) - 63):
            count[t[k : k + 64]] = count.get(t[k : k + 64], 0) + 1
    assert np.concatenate(marks).tolist() == [k + 64 <= len(t) and count[t[k : k + 64]] > 1 for t in flat for k in range(len(t))]


def test_anchors_and_hashes(monkeypatch):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    wanted_places = [k + int(np.argmin(values[k : k + 37] >> np.uint64(24))) for k in range(5000 - 36)]
    assert window_minima(values, 37).tolist() == wanted_places
    monkeypatch.setattr(module, "PLACE_BITS", 8)  # inputs longer than the place has room for
    small = values[:1000]
    assert window_minima(small, 37).tolist() == [k + int(np.argmin(small[k : k + 37] >> np.uint64(8))) for k in range(1000 - 36)]
    data = rng.integers(0, 256, 700).astype(np.uint8)
    twice = np.concatenate([data, data])
    assert (Rolling(twice).every(300)[:401] == Rolling(twice).every(300)[700:1101]).all()
    lo, hi, anchor, context = contexts(twice, np.array([0, 700, 1400]), 400)
    half = len(lo) // 2
    assert (hi - lo + 1).sum() == 2 * 301 and (anchor[:half] == anchor[half:]).all() and (context[:half] == context[half:]).all()
    assert sort_suffixes(np.array([2, 1, 2, 1]), np.array([1, 2, 3, 4])).tolist() == [3, 1, 2, 0]


def test_one_very_long_text_and_columns_of_any_name(spark):
    """Ten million bytes in one row, with repeats inside it and with others."""
    rng = random.Random(9)
    part = "".join(rng.choice("abcdefgh ") for _ in range(700))
    long = "".join(f"{k} {k * k % 10007} " for k in range(900_000)) + part
    rows = [(1, long[5_000_000:5_003_000] + "x"), (2, long), (0, "y" + part), (3, part[:399])]
    assert len(long) > 9_000_000
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, `__block` string, column_0 string")
    out = {r["doc_id"]: r for r in suffix_dedup(df, "doc_id", "text").collect()}
    assert [(out[k]["n_bytes"], out[k]["n_removed"]) for k in (0, 1, 3)] == [(701, 700), (3001, 3000), (399, 0)]
    assert [tuple(s) for s in out[2]["removed"]] == [(5_000_000, 3000), (len(long) - 700, 700)]
    assert {(r["__block"], r["column_0"]) for r in out.values()} == {("x", "y")}
