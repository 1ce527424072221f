import random
import re

import numpy as np
import pytest

from sparkloom.llm import ngram_jaccard
from sparkloom.llm.components import connected_components
from sparkloom.llm.ngram_jaccard import jaccard_components, linked_roots, op6_ngram_jaccard, overlaps

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    said = WORD.findall((text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    if len(said) < 5:
        return frozenset([tuple(said)] if said else [])
    return frozenset(tuple(said[k : k + 5]) for k in range(len(said) - 4))


def brute(rows):
    """(n_shingles, component) of each (id, text), by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[find(k)] = min(least.get(find(k), key), key)
    return sorted(((key, len(sets[k]), least.get(find(k))) for k, (key, _) in enumerate(rows)), key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert found(op6_ngram_jaccard(spark, str(tmp_path))) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def chain(n, length=60, step=6, seed=3):
    """Texts that each differ from the one before by a few words: neighbours link, ends do not."""
    rng = random.Random(seed)
    said, out = [f"w{rng.random()}" for _ in range(length)], []
    for k in range(n):
        if k % 3 == 0:
            said = said[:-1] + [f"w{rng.random()}"]
        else:
            said = [f"w{rng.random()}"] + said[1:]
        if k % step == step - 1:  # a break now and then
            said = [f"w{rng.random()}" if i % 9 == 0 else w for i, w in enumerate(said)]
        out.append(" ".join(said))
    return out


def test_large_components_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "TILE", 6)
    monkeypatch.setattr(ngram_jaccard, "PIVOTS", 2)
    rng = random.Random(8)
    texts = chain(45) + chain(30, step=4, seed=5)
    rows = [(k, t) for k, t in enumerate(texts)] + [(500 + k, texts[0]) for k in range(40)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(jaccard_components(df, "doc_id", "text")) == brute(rows)


def test_groups_of_one_candidate_component(spark, monkeypatch):
    """Texts of several kinds and sizes that a common passage makes one candidate component: links across tiles, bands and
    groups are found, and kinds stay apart."""
    monkeypatch.setattr(ngram_jaccard, "TILE", 5)
    monkeypatch.setattr(ngram_jaccard, "PIVOTS", 1)
    monkeypatch.setattr(ngram_jaccard, "CHUNK", 3)
    monkeypatch.setattr(ngram_jaccard, "BROADCAST_ROWS", 2)
    rng = random.Random(11)
    passage, texts = [f"p{k}" for k in range(9)], []
    for kind in range(6):
        base = [f"k{kind}w{k}" for k in range(40 + 9 * kind)] + passage
        for _ in range(14):
            said = list(base)
            for _ in range(rng.randrange(4)):
                said[rng.randrange(len(said) - 9)] = f"n{rng.random()}"
            texts.append(" ".join(said[: len(said) - rng.randrange(3)]))
    texts += [" ".join(passage + [f"x{rng.random()}" for _ in range(n)]) for n in range(0, 30, 2)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = brute(rows)
    assert len({c for _, _, c in out}) > 10 and found(jaccard_components(df, "doc_id", "text")) == out


def test_columns_of_any_name(spark):
    rows = [(k, "one two three four five six" + " more" * (k % 2), "x", "y", "z", "w") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `__block` string, `key` string, `label` string, column_0 string")
    out = jaccard_components(df, "doc_id", "text")
    assert found(out) == brute([r[:2] for r in rows]) and {(r["__block"], r["key"], r["label"], r["column_0"]) for r in out.collect()} == {("x", "y", "z", "w")}


def test_edges(spark):
    rows = [(None, "same words here"), (4, "Same  words\nhere"), (4, "other words"), (None, None), (5, ""), (6, " \t"), (7, "one"), (8, "ONE"), (9, "É é"), (10, "é é"), (10, "é é")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    out = jaccard_components(df, "doc_id", "text")
    assert out.columns == ["doc_id", "n", "n_shingles", "set_id", "component_id"]
    assert found(out) == brute(rows)
    assert jaccard_components(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError, match="in use"):
        jaccard_components(df.selectExpr("doc_id", "text", "n AS set_id"), "doc_id", "text")


def test_product_counts_overlaps():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 3000, rng.integers(1, 900)).astype(np.uint64)) for _ in range(30)]
    rows, others = np.arange(10), np.arange(10, 30)
    assert overlaps(sets, rows, others).astype(int).tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in others] for i in rows]
    assert linked_roots([sets[0], sets[1], sets[0]]).tolist() == [0, 1, 0]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(k, 1000) for k in range(500, 560)] + [(2000 + k, 2001 + k) for k in range(64)] + [(None, 3), (9, 9)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    out = connected_components(spark.createDataFrame(edges, "u long, v long").repartition(5))
    assert {r["v"]: r["label"] for r in out.collect()} == {x: find(x) for x in list(root)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
