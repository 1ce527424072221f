import math
import os
import random

import numpy as np
import pytest

from sparkloom.llm.common import mix64, word_hashes
from sparkloom.llm.toxicity import BITS, apply_chain, fit_chain, fit_link, op3_toxicity_chain, train_chain

CATEGORIES = ["rude", "toxic"]


def corpus(seed, n):
    """rude: a rude word. toxic: a rude word and a threat; the second category depends on the first."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        said = [f"word{rng.randrange(300)}" for _ in range(rng.randrange(5, 80))]
        rude, threat = rng.random() < 0.3, rng.random() < 0.3
        if rude:
            said[rng.randrange(len(said))] = rng.choice(["clod", "Clods", "oafish", "oaf"])
        if threat:
            said[rng.randrange(len(said))] += " " + rng.choice(["beware", "Beware!", "bewared"])
        rows.append((k, " ".join(said), int(rude), int(rude and threat)))
    return rows


def test_learns_a_dependent_category(spark):
    rows = corpus(1, 900)
    docs = spark.createDataFrame([r[:2] for r in rows], "id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows] + [(None, 1, 1), (5, None, None)], "id long, rude int, toxic int")
    chain = train_chain(docs, labels, "id", "text", CATEGORIES)
    assert len(chain) == 2 and len(chain[1].earlier) == 1
    test = corpus(2, 400)
    odd = [(1000, None), (1001, ""), (1002, "clod beware " * 20000)]
    df = spark.createDataFrame([r[:2] for r in test] + odd, "id long, text string")
    out = {r["id"]: (r["p_rude"], r["p_toxic"]) for r in apply_chain(df, chain, "text", CATEGORIES).collect()}
    for k in (0, 1):
        assert sum((out[r[0]][k] >= 0.5) == bool(r[2 + k]) for r in test) >= 0.95 * len(test)
    assert out[1000] == out[1001] and out[1000][1] < 0.5 and out[1002][0] > 0.5


def test_later_links_see_out_of_fold_predictions():
    rng = np.random.default_rng(0)
    rows = 200
    first = rng.integers(0, 2, rows)
    row, feature = np.arange(rows), np.arange(rows) + 10  # a feature for each row: nothing to learn but by heart
    chain = fit_chain(row, feature, np.column_stack([first, first]))
    assert abs(chain[1].earlier[0]) < 1.5  # by-heart predictions of the first link would get a large weight


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    none = train_chain(docs, spark.createDataFrame([], "id long, rude int, toxic int"), "id", "text", CATEGORIES)
    assert {r["p_toxic"] for r in apply_chain(docs, none, "text", CATEGORIES).collect()} == {0.5}
    one = train_chain(docs, spark.createDataFrame([(1, 0, 0), (2, 0, 0), (2, 0, 0)], "id long, rude int, toxic int"), "id", "text", CATEGORIES)
    assert all(r["p_rude"] < 0.5 for r in apply_chain(docs, one, "text", CATEGORIES).collect())
    assert apply_chain(docs.limit(0), one, "text", CATEGORIES).count() == 0
    with pytest.raises(ValueError, match="in use"):
        apply_chain(docs.selectExpr("text", "id AS p_rude"), one, "text", CATEGORIES)
    link = fit_link(np.array([0, 1]), np.array([3, 4]), 2, np.array([0.0, 0.0]), np.zeros((2, 0)), 10)
    assert link.bias < 0 and not len(link.features)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the test tables are not here")
def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").selectExpr("doc_id", "cast(quality = 0 AS int) AS low_quality", "toxic")
    seen, unseen = labels.where("doc_id % 3 != 0"), labels.where("doc_id % 3 = 0")
    chain = train_chain(docs, seen, "doc_id", "text", ["low_quality", "toxic"])
    out = apply_chain(docs.join(unseen, "doc_id"), chain, "text", ["low_quality", "toxic"]).selectExpr("toxic", "p_toxic >= 0.5 AS said").collect()
    caught = [r["said"] for r in out if r["toxic"]]
    clean = [r["said"] for r in out if not r["toxic"]]
    assert sum(caught) >= 0.8 * len(caught) and sum(clean) <= 0.02 * len(clean)  # some labels are noise: no such word in the text


def test_query_columns(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, 1, 0), (14, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = op3_toxicity_chain(spark, str(tmp_path))
    assert out.columns == ["doc_id", "p_low_quality", "p_toxic", "low_quality", "toxic"] and out.count() == docs.count()


def plain_score(text, chain):
    """The chain's probabilities of one text: words one by one, sums over a set of features."""
    said, features = (text or "").encode(), set()
    for k, ends in enumerate((lambda w: w, lambda w: w[:4])):
        for w in bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in said).split():
            features.add(feature_number(ends(w), k + 1))
    for w in bytes(b + 32 if 65 <= b <= 90 else b for b in said).translate(bytes(32 if b in b"\t\n\v\f\r" else b for b in range(256))).split(b" "):
        if w:
            features.add(feature_number(w[-2:], 3))
    odds, out = [], []
    for link in chain:
        weight = dict(zip(link.features.tolist(), link.weights.tolist(), strict=True))
        total = sum(weight.get(f, 0.0) for f in features) + sum(a * b for a, b in zip(odds, link.earlier.tolist(), strict=True)) + link.bias
        odds.append(min(20.0, max(-20.0, total)))
        out.append(1 / (1 + math.exp(-odds[-1])))
    return out


def feature_number(word, kind):
    data = np.frombuffer(word, np.uint8)
    return int(mix64(word_hashes(data, np.array([0]), np.array([len(data)])) + np.uint64(kind))[0] >> np.uint64(64 - BITS))


def test_query_against_plain_scores(spark, docs, tmp_path):
    """Whole texts, null and odd ones, scored one by one by the chain that the query learns."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = docs.collect()
    labels = [(r["doc_id"], int(len(r["text"] or "") % 2), int("a1" in (r["text"] or ""))) for r in rows if r["doc_id"] % 3]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame.write.parquet(str(tmp_path / "labels.parquet"))
    low = frame.selectExpr("doc_id", "cast(quality = 0 AS int) AS low_quality", "toxic")
    chain = train_chain(docs.select("doc_id", "text"), low, "doc_id", "text", ["low_quality", "toxic"])
    out = {r["doc_id"]: r for r in op3_toxicity_chain(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    for r in rows:
        found, wanted = out[r["doc_id"]], plain_score(r["text"], chain)
        assert all(abs(x - y) < 1e-6 for x, y in zip((found["p_low_quality"], found["p_toxic"]), wanted, strict=True))
        assert (found["low_quality"], found["toxic"]) == (found["p_low_quality"] >= 0.5, found["p_toxic"] >= 0.5)


def test_folds_in_tasks_give_what_the_driver_gives(spark):
    rng = np.random.default_rng(3)
    row, feature = np.repeat(np.arange(120), 8), rng.integers(0, 60, 960)
    pairs = np.unique(np.column_stack([row, feature]), axis=0)
    targets = np.column_stack([(rng.random(120) < 0.4), (rng.random(120) < 0.3)]).astype(float)
    here, there = (fit_chain(pairs[:, 0], pairs[:, 1], targets, spark=s) for s in (None, spark))
    for a, b in zip(here, there, strict=True):
        assert a.features.tolist() == b.features.tolist() and np.allclose(a.weights, b.weights) and np.allclose(a.earlier, b.earlier)
