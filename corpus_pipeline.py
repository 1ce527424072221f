"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. What a
stage returns is written as Parquet and read again as the next one's documents, so a lost executor never sends the job back
further than one stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import checkpoint, read_table, remove_folder, shared_folder, small_side, trim_executors
from sparkloom.llm.language_id import N, has_letter, held_out, identify, learn
from sparkloom.llm.mixing import apply_mix, plan_mix, row_hash, word_count
from sparkloom.llm.ngram_jaccard import jaccard_components
from sparkloom.llm.packing import pack_documents
from sparkloom.llm.suffix_dedup import suffix_dedup


#: Share of a text's n-grams that its language must know, beyond chance. What has less is no text of a learned language.
LANGUAGE_FLOOR = 0.1
#: Bytes of the shortest repeated string that goes: 50 words of 4.8 bytes, separators included. A multiple of 8.
PASSAGE_BYTES = 240


def neutral(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under column names that no operator uses, and the new name of each old one: whatever further columns the
    documents have, they clash with nothing and come out as they went in."""
    names = {c: f"column_{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*names.values()).toDF(*names)


def lean(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``stage`` on executors that have given back what the jobs before it left in their memory."""

    @wraps(stage)
    def trimmed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        trim_executors(spark)
        return stage(spark, docs, sf_dir)

    return trimmed


@lean
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what language ID rejects, and give documents without a ``lang`` the predicted one; a given lang stays.

    Rejected are null texts, texts without a letter, and texts whose best language knows less than LANGUAGE_FLOOR of their
    n-grams. A text with a letter that is too short for an n-gram says nothing against itself and stays. If no row has both
    a text and a lang to learn from, every text with a letter stays, as it is. An empty table gives no rows.
    """
    rows, at = neutral(docs)
    text, lang = at["text"], at["lang"]
    model = learn(rows.where(~held_out(at["doc_id"])).select(text, lang), text, lang)
    if not model.languages:
        return named(rows.where(has_letter(text)), at)
    spoken = (F.col("coverage") >= LANGUAGE_FLOOR) | (F.octet_length(text) < N)
    kept = identify(rows, model, text).where((F.col("lang_pred") != "und") & spoken)
    return named(kept.withColumn(lang, F.coalesce(lang, "lang_pred")), at)


@lean
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of linked ones: the least doc_id (null last), of several such rows the least text hash.

    Documents with an empty set of shingles link with nothing and stay. Rows of one doc_id are one group only if links join them.
    An empty table gives no rows.
    """
    rows, at = neutral(docs)
    key, text, hashed = at["doc_id"], at["text"], "text_hash"
    rows = rows.withColumn(hashed, F.xxhash64(text))
    found = jaccard_components(rows.select(key, text, hashed), key, text, label="group")
    grouped = checkpoint(found.select(key, hashed, "component_id", "group")).where("group is not null")
    least = F.col(key).eqNullSafe(F.col("component_id"))  # both null where no row of the group has an id
    lead = grouped.where(least).groupBy("group").agg(F.min(hashed).alias("lead"))
    gone = grouped.join(lead, "group").where(~(least & (F.col(hashed) == F.col("lead"))))
    gone = checkpoint(gone.select(F.col(key).alias("id"), F.col(hashed).alias("hash")).distinct())
    same = F.col(key).eqNullSafe(F.col("id")) & (F.col(hashed) == F.col("hash"))
    kept = rows.join(small_side(gone, gone.count()), same, "left_anti")
    repeated = grouped.groupBy(F.col(key).alias("id"), F.col(hashed).alias("hash")).count().where("count > 1")
    if not repeated.isEmpty():  # the very same row several times
        whole = kept.join(repeated, same, "left_anti")
        once = kept.join(repeated, same, "left_semi").dropDuplicates([key, hashed])
        kept = whole.union(once)
    return named(kept, at)


@lean
def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove every repeated string of PASSAGE_BYTES, by whole characters; n_chars follows the text. Null texts stay null; an
    empty table gives no rows. A document that is a repeat from end to end stays, with an empty text."""
    rows, at = neutral(docs)
    text = at["text"]
    out = suffix_dedup(rows, at["doc_id"], text, size=PASSAGE_BYTES, whole_characters=True)
    out = out.withColumn(text, F.when(F.col(text).isNotNull(), F.col("kept").cast("string")))
    if "n_chars" in at:
        length = at["n_chars"]
        out = out.withColumn(length, F.when(F.col("n_removed") > 0, F.length(text).cast(rows.schema[length].dataType)).otherwise(F.col(length)))
    return named(out, at)


@lean
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents by their source's target: a document stands as many times as the mix takes it. Only rows of equal
    doc_id and text stand or fall together. A null source is a source, a null text has no words; an empty table gives no rows."""
    rows, at = neutral(docs)
    source = at["source"]
    rows = rows.withColumn("hash", row_hash(F.col(at["doc_id"]))).withColumn("tie", F.shiftrightunsigned(F.xxhash64(at["text"]), 4))
    narrow = checkpoint(rows.select(source, word_count(F.col(at["text"])).alias("size"), "hash", "tie"))
    plan = plan_mix(narrow, source, "size", "hash", tie="tie")
    taken = apply_mix(rows, plan, source, "hash", tie="tie")
    return named(taken.where("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), "times"))), at)


@lean
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 1024 tokens. A null text counts as empty; an empty table
    gives no rows. Only doc_id and text are read."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("suffix_dedup", suffix_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: No stage but the mixing can be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared checkpoint folder, and removed once the
    last stage, whose rows come from checkpoints of its own, has been made."""
    docs, folder = read_table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        remove_folder(spark, folder)
