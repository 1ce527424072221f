import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm.common import text_buffer
from sparkloom.llm.language_id import grams, identify, learn, most_frequent, op10_language_id, score


def test_grams_stay_inside_rows():
    import pyarrow as pa

    texts = ["abcdef", "", "abc", None, "Wxyz", "1\t2 3", "é"]
    values, count = grams(*text_buffer(pa.array(texts)))
    wanted = [[t.encode()[k : k + 4] for k in range(len(t.encode()) - 3)] for t in (x or "" for x in texts)]
    assert count.tolist() == [len(w) for w in wanted]
    fold = bytes(32 if chr(b) in " \t" else 48 if chr(b).isdigit() and b < 128 else b + 32 if 65 <= b <= 90 else b for b in range(256))
    assert values.tolist() == [int.from_bytes(g.translate(fold), "big") for w in wanted for g in w]


def speak(rng, language, n):
    sounds = {"aa": ["ka", "ro", "mi", "ten"], "bb": ["sch", "lug", "wer", "ung"], "cc": ["eau", "quoi", "ment", "è"]}[language]
    return " ".join("".join(rng.choice(sounds) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(2)
    rows = [(speak(rng, x, 40), x) for x in ("aa", "bb", "cc") for _ in range(40)] + [(None, "aa"), ("", "bb"), ("text without a language", None)]
    return learn(spark.createDataFrame(rows, "text string, lang string").repartition(5), "text", "lang", size=1 << 12)


def test_filter_holds_every_gram_and_counts_false_hits(trained):
    assert trained.languages == ["aa", "bb", "cc"] and (trained.chance < 0.2).all()
    rng = random.Random(9)
    for k, language in enumerate(trained.languages):
        data = np.frombuffer(speak(rng, language, 200).encode(), np.uint8)
        best, sure, _ = score(trained, data, np.array([0, len(data)]))
        assert best[0] == k and sure[0] > 0.8
    noise = np.frombuffer(rng.randbytes(20000), np.uint8)
    best, sure, _ = score(trained, noise, np.array([0, len(noise)]))
    assert best[0] == -1 or sure[0] < 0.9  # chance hits are taken off


def test_edges(spark, trained):
    texts = [None, "", "123 ... !!", "ka", "日本", speak(random.Random(1), "bb", 5000)]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "id int, text string, lang string")
    out = [(r["lang_pred"], r["score"]) for r in identify(df, trained, "text").orderBy("id").collect()]
    assert out[:3] == [("und", 0.0)] * 3
    assert out[3] == (trained.fallback, 0.0) and out[4] == (trained.fallback, 0.0)
    assert out[5][0] == "bb" and 0.8 < out[5][1] <= 1
    empty = learn(df.limit(0), "text", "lang")
    assert {(r["lang_pred"], r["score"]) for r in identify(df, empty, "text").collect()} == {("und", 0.0)}
    assert identify(df.limit(0), trained, "text").count() == 0
    with pytest.raises(ValueError, match="in use"):
        identify(df.selectExpr("text", "id AS score"), trained, "text")


def plain_model(rows, top=6000, ratio=0.5):
    """(language: its n-grams as a set of bytes) and n-grams a language, without a filter, hashes or Spark. Where a language
    has more than ``top`` the sets would differ."""
    fold = bytes(32 if b in b" \t\n\v\f\r" else 48 if 48 <= b < 58 else b + 32 if 65 <= b <= 90 else b for b in range(256))
    counts = {}
    for text, lang in rows:
        if text is not None and lang is not None:
            folded = text.encode().translate(fold)
            counts.setdefault(lang, Counter()).update(folded[k : k + 4] for k in range(len(folded) - 3))
    whole = {x: sum(c.values()) for x, c in counts.items()}
    most = {}
    for x, c in counts.items():
        for g, n in c.items():
            most[g] = max(most.get(g, 0), n / whole[x])
    sets = {x: {g for g, n in c.items() if n / whole[x] >= ratio * most[g]} for x, c in counts.items()}
    assert all(len(s) <= top for s in sets.values())
    return sets, whole, fold


def plain_answer(model, text):
    """Language, its share of all hits, and its share of the text's n-grams."""
    sets, whole, fold = model
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0, 0.0
    folded = text.encode().translate(fold)
    found = [folded[k : k + 4] for k in range(len(folded) - 3)]
    hits = {x: sum(g in sets[x] for g in found) for x in sorted(sets)}
    if not any(hits.values()):
        return max(sorted(sets), key=lambda x: (whole[x], x)), 0.0, 0.0
    best = max(hits, key=lambda x: hits[x])
    return best, hits[best] / sum(hits.values()), hits[best] / len(found)


def test_query_against_plain_sets(spark, docs, tmp_path):
    """The filter gives what sets of n-grams give, but for what chance hits and their correction leave."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = docs.collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows}
    model = plain_model([(r["text"], r["lang"]) for r in rows if not held[r["doc_id"]]])
    out = {r["doc_id"]: r for r in op10_language_id(spark, str(tmp_path)).collect()}
    assert out.keys() == held.keys()
    for r in rows:
        lang, share, known = plain_answer(model, r["text"])
        found = out[r["doc_id"]]
        assert found["held_out"] == held[r["doc_id"]]
        assert abs(found["score"] - share) < 0.02 and abs(found["coverage"] - known) < 0.02
        assert found["lang_pred"] == lang or abs(share - 0.5) < 0.02  # a near tie of the two languages


def test_top_is_cut_by_class_and_hash(spark):
    """Whole frequency classes from the greatest down, then a part of one class by hash: near ``top``, nothing rarer."""
    rows = [("aa", g, 1000 // (g + 1) + 1) for g in range(400)] + [("bb", g, 7) for g in range(1000, 3000)]
    df = spark.createDataFrame(rows, "lang string, gram long, n long").repartition(5)
    for top in (30, 200):
        kept = most_frequent(df, top)
        assert sorted(kept) == sorted(most_frequent(df.repartition(2), top))
        mine = sorted(r["gram"] for r in kept if r["lang"] == "aa")
        assert mine[: top // 2] == list(range(top // 2)) and abs(len(mine) - top) <= top // 4
        assert abs(sum(r["lang"] == "bb" for r in kept) - top) < 6 * top**0.5
    assert len(most_frequent(df, 10_000)) == len(rows) and most_frequent(df.limit(0), 5) == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the test tables are not here")
def test_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = op10_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(out) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    tested = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in tested) >= 0.98 * len(tested)
