"""The pipeline against a version without Spark, stage by stage on each stage's own input."""

import os
import zlib

import test_language_id
import test_mixing
import test_ngram_jaccard
import test_packing
import test_suffix_dedup
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm.language_id import held_out
from sparkloom.llm.mixing import water_fill


def test_stages(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    frame, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), docs.columns
    rows = [tuple(r) for r in frame.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        found = [tuple(r) for r in frame.collect()]
        if name != "packing":
            assert frame.columns == columns
        if name == "language_id":
            model = test_language_id.plain_model([(r[1], r[2]) for r in rows if zlib.crc32(str(r[0]).encode()) % 5])
            said = [test_language_id.plain_answer(model, r[1]) for r in rows]
            assert all(abs(known - 0.1) > 0.02 for _, _, known in said)  # none near the floor
            gone = [r[1] for r, (_, _, known) in zip(rows, said, strict=True) if r[1] and len(r[1]) > 3 and any(c.isalpha() for c in r[1]) and known < 0.1]
            assert gone  # the filter decides, not the letters
            either = {r[0]: r[2] for r in found}  # of two languages that are nearly tied, the filter may name the other
            kept = [(r, either.get(r[0]) if abs(share - 0.5) < 0.02 else lang) for r, (lang, share, known) in zip(rows, said, strict=True) if lang != "und" and (known > 0.1 or len(r[1].encode()) < 4)]
            wanted = [(*r[:2], r[2] or lang, *r[3:]) for r, lang in kept]
            assert {r[2] for r in wanted} <= {"en", "de"}
        elif name == "ngram_jaccard":
            keep = {(k, c) for k, _, c in test_ngram_jaccard.brute([r[:2] for r in rows])}
            wanted = [r for r in rows if (r[0], r[0]) in keep]
        elif name == "suffix_dedup":
            wanted = []
            for r, (_, lost, spans, _) in zip(rows, test_suffix_dedup.brute([r[1].encode() for r in rows], corpus_pipeline.PASSAGE_BYTES), strict=True):
                at, text, kept = 0, r[1], []
                gone = {b for start, n in spans for b in range(start, start + n)}
                for c in text:
                    size = len(c.encode())
                    if not all(b in gone for b in range(at, at + size)):
                        kept.append(c)
                    at += size
                wanted.append((r[0], "".join(kept), r[2], r[3], len(kept) if lost else r[4]))
        elif name == "mixing":
            taken = test_mixing.expected(rows)
            wanted = [r for r in rows for _ in range(taken[r[0]][1] // taken[r[0]][0] if taken[r[0]][0] else 0)]
            found_words = [r for r in found if r[1].split()]
            assert {r[0] for r in found} >= {r[0] for r in wanted}
            found = found_words
        else:
            wanted = [(r[0], *p) for r in rows for p in test_packing.brute_pieces(r[1])]
            test_packing.check_layout(frame.collect())
            found = [r[:5] for r in found]
        assert sorted(found, key=repr) == sorted(wanted, key=repr), name
        rows = [tuple(r) for r in frame.collect()]


def test_run_and_repeated_rows(spark, tmp_path):
    text = " ".join(f"word{k}" for k in range(30))
    data = [(4, text, "en", "a", 9)] * 3 + [(9, text, "en", "a", 9), (2, text + " more", "en", "b", 9), (None, text, "en", "a", 9), (5, None, None, None, None), (6, "12 34", "en", "a", 5)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicate_stage(spark, df, "").collect()
    assert sorted((r["doc_id"] for r in kept), key=repr) == [2, 5, 6]
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    df.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_groups_of_repeated_and_missing_ids(spark):
    """A group is what links join, not what shares a least doc_id; copies without an id are reduced to one as well."""
    one, two, three, four = (" ".join(f"{w}{k}" for k in range(30)) for w in ("north", "south", "east", "west"))
    data = [(5, one), (5, two), (5, two + " more"), (8, two), (None, three), (None, three), (None, three + " more"), (None, four), (None, None), (None, None), (5, ""), (7, "12 34"), (7, "12 34")]
    df = spark.createDataFrame([(i, t, "en", "a", 9) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()]
    assert kept.count((5, one)) == 1 and kept.count((None, four)) == 1
    assert len([k for k in kept if k in [(5, two), (5, two + " more")]]) == 1 and (8, two) not in kept
    assert len([k for k in kept if k[1] and k[1].startswith(three)]) == 1
    assert kept.count((None, None)) == 2 and kept.count((5, "")) == 1 and kept.count((7, "12 34")) == 1
    assert len(kept) == 8


def test_language_stage_without_labels(spark):
    """Where no row to learn from has a language, documents with letters stay."""
    rows = [(1, "some words", None), (2, None, None), (3, "12 34", None), (4, "日本", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_stage(spark, df, "").collect()) == [1, 4]
    out = df.where("doc_id in (1, 2)").withColumn("doc_id", F.lit(6)).withColumn("lang", F.lit("en"))  # 6 is held out
    assert out.where(held_out("doc_id")).count() == 2
    assert [r["text"] for r in corpus_pipeline.language_stage(spark, out, "").collect()] == ["some words"]


def test_mixing_cuts_inside_a_repeated_or_missing_id(spark):
    """Rows of one id, or of none, are taken up to the target and not all or none."""
    rows = [(None if source == "b" else 7 if k % 3 else 1000 + k, f"{source} text{k} " + "word " * 8, "en", source) for source in ("a", "b", "c") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    out = corpus_pipeline.mixing_stage(spark, df, "")
    assert out.columns == df.columns
    taken = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    targets = water_fill([(s, 600) for s in ("a", "b", "c")], (5, 2, 1), (3, 2), 2)
    assert targets["b"] % 600 and targets["c"] % 600
    assert all(abs(taken[s] - targets[s]) <= 5 for s in targets)


def test_further_columns_of_any_name_pass_through(spark, tmp_path):
    """Columns named like those that operators add or work with neither stop the stages nor change."""
    names = ["score", "Lang_Pred", "kept", "times", "removed", "n_removed", "component_id", "set_id", "elements", "__block", "__at", "hash", "tie", "text_hash", "column_0", "lead", "id", "group", "size"]
    words = " ".join(f"word{k}" for k in range(60))
    data = [(k, words + f" end{k} and more of it" * (k % 4), "en" if k % 3 else None, "a" if k % 2 else "b", 9, *[f"{n} of {k}" for n in names]) for k in range(12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "documents.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns and out.dtypes == frame.dtypes
        out.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        rows = frame.collect()
        assert rows and all(r[n] == f"{n} of {r['doc_id']}" for r in rows for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).count() > 0


def test_run_leaves_no_folder(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert not [x for x in os.listdir(folder) if x.startswith("pipeline-")]
    assert out.count() > 0
