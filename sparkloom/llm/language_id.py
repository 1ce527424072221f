"""Language identification by bit-sliced Bloom filters over byte n-grams.

Every language owns one bit slice of a common filter: position p holds a mask with bit l set if some n-gram of
language l hashes to p. One lookup, the AND of a few positions, returns all languages that contain an n-gram. For each
text the masks' bits are counted by language, the count that the slice's fill would give by chance is taken off, and
the language with most n-grams left wins.

Learning counts n-grams over all training rows in Spark (partial sums for each Arrow batch, then one aggregation by
n-gram). The driver and the broadcast hold ``top`` n-grams a language at most and the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, checkpoint, fields, mix64, read_table, refuse, release, slices, text_buffer

N = 4
#: Bytes as the n-grams see them: A-Z lower-cased, separators as spaces, digits alike.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[SPACE] = 32
FOLD[48:58] = 48


@dataclass(frozen=True)
class Model:
    """Languages by code point, the filter's masks (positions x words of 64 languages), and each slice's chance of a hit."""

    languages: list[str]
    masks: np.ndarray
    chance: np.ndarray
    hashes: int
    fallback: str | None


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the rows' folded bytes as 32-bit numbers, and how many each row has; none cross rows."""
    folded = FOLD[data].astype(np.uint32)
    count = np.maximum(np.diff(offsets) - (N - 1), 0)
    if not count.sum():
        return np.zeros(0, np.uint32), count
    at = len(folded) - N + 1
    value = folded[:at].copy()
    for k in range(1, N):
        value = (value << np.uint32(8)) | folded[k : k + at]
    keep = np.ones(at, bool)
    for k in range(1, N):  # the last starts of each row reach into the next
        last = offsets[1:-1] - k
        keep[last[(last >= 0) & (last < at)]] = False
    short = np.flatnonzero(np.diff(offsets) < N)
    for i in short:
        keep[offsets[i] : offsets[i + 1]] = False
    return value[keep], count


def positions(values: np.ndarray, size: int, hashes: int) -> Iterator[np.ndarray]:
    """Filter positions of the n-grams: parts of one mixed hash."""
    mixed = mix64(values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for k in range(hashes):
        yield (mixed >> np.uint64(k * 64 // hashes)) & np.uint64(size - 1)


#: Stands for all n-grams of a language in ``count_grams``.
EVERY = -1
#: Frequency classes for each doubling of a count: counts up to 45 have a class each.
CLASSES = 32


def count_grams(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n): how often each language's rows contain each n-gram, and under ``EVERY`` how many they have in all
    (a language whose texts are too short has that row only)."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist(), object)
            for a, b in slices(offsets, 500_000):
                values, count = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows = np.repeat(langs[a:b], count)
                for name in sorted(set(langs[a:b])):
                    found, n = np.unique(values[rows == name], return_counts=True)
                    gram, n = np.append(found.astype(np.int64), EVERY), np.append(n, n.sum()).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"lang": [name] * len(gram), "gram": gram, "n": n})
            release()

    parts = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null").mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def most_frequent(held: DataFrame, top: int) -> list:
    """(lang, gram) rows: about the ``top`` most frequent n-grams of each language.

    They are cut by frequency class (a 32nd of a doubling): whole classes from the greatest down, and of the class that
    would exceed ``top`` the n-grams with the least hashes. A class is counted like any group, so no task sees all n-grams
    of a language, and the driver holds some 2,000 numbers a language.
    """
    classed = held.withColumn("class", F.floor(F.log2("n") * CLASSES).cast("int"))
    limits = []
    sizes = classed.groupBy("lang", "class").count().collect()
    for name in sorted({r["lang"] for r in sizes}):
        room = top
        for r in sorted((r for r in sizes if r["lang"] == name), key=lambda r: -r["class"]):
            limits.append((name, r["class"], min(1.0, max(room, 0) / r["count"])))
            room -= r["count"]
            if room <= 0:
                break
    if not limits:
        return []
    parts = held.sparkSession.createDataFrame(limits, "lang string, class int, part double")
    draw = F.shiftrightunsigned(F.xxhash64("gram"), 11) / F.lit(float(1 << 53))
    return classed.join(F.broadcast(parts), ["lang", "class"]).where(draw < F.col("part")).select("lang", "gram").collect()


def learn(df: DataFrame, text: str, lang: str, top: int = 6000, size: int = 1 << 18, hashes: int = 3, ratio: float = 0.5) -> Model:
    """Learn from all rows with a text and a language, in one pass over the texts.

    A language's filter takes its ``top`` most frequent n-grams (see ``most_frequent``) of those whose share in the language
    is at least ``ratio`` of their greatest share in any language. No rows: a model without languages.
    """
    counted = checkpoint(count_grams(df, text, lang))
    whole = {r["lang"]: r["n"] for r in counted.where(F.col("gram") == EVERY).collect()}  # a row a language
    languages = sorted(whole, key=str.encode)
    if not languages:
        return Model([], np.zeros((size, 1), np.uint64), np.zeros(0), hashes, None)
    share = F.col("n") / F.create_map(*[F.lit(x) for kv in whole.items() for x in kv])[F.col("lang")]
    shares = counted.where(F.col("gram") != EVERY).withColumn("share", share)
    held = shares.withColumn("most", F.max("share").over(Window.partitionBy("gram"))).where(F.col("share") >= ratio * F.col("most"))
    kept = most_frequent(checkpoint(held.select("lang", "gram", "n")), top)
    masks = np.zeros((size, (len(languages) + 63) // 64), np.uint64)
    for k, name in enumerate(languages):
        own = np.array([r[1] for r in kept if r[0] == name], np.int64)
        for at in positions(own, size, hashes):
            masks[at, k // 64] |= np.uint64(1 << (k % 64))
    fill = np.array([np.mean((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)) for k in range(len(languages))])
    return Model(languages, masks, fill**hashes, hashes, max(languages, key=lambda x: (whole[x], x)))


def score(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the best language's number (-1: no n-gram is known), its share of all corrected counts, and the share of
    the row's n-grams that it knows beyond chance; ties go to the first language."""
    values, count = grams(data, offsets)
    hits = np.zeros((len(count), len(model.languages)))
    if len(values):
        mask = None
        for at in positions(values, len(model.masks), model.hashes):
            mask = model.masks[at] if mask is None else mask & model.masks[at]
        ends = np.concatenate([[0], np.cumsum(count)])
        for k in range(len(model.languages)):
            bit = np.concatenate([[0], np.cumsum((mask[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1), dtype=np.int64)])
            hits[:, k] = bit[ends[1:]] - bit[ends[:-1]]
    left = np.maximum((hits - count[:, None] * model.chance) / np.maximum(1 - model.chance, 1e-9), 0)
    best = left.argmax(axis=1)
    total = left.sum(axis=1)
    most = left.max(axis=1)
    return np.where(total > 0, best, -1), np.where(total > 0, most / np.where(total > 0, total, 1), 0.0), np.minimum(most / np.maximum(count, 1), 1.0)


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


NEW = fields(lang_pred="string", score="double", coverage="double")


def identify(df: DataFrame, model: Model, text: str) -> DataFrame:
    """``df`` with ``lang_pred`` (string), ``score`` (double, 0 to 1: the language's share of all languages' corrected counts)
    and ``coverage`` (double, 0 to 1: the share of the text's n-grams that the language knows beyond chance).

    A null text and one without a letter are `und` with score and coverage 0, as is everything when no language was
    learned; a text with letters but no known n-gram has the language with most training n-grams, score and coverage 0.
    Whole texts are read. The table's other columns pass through; columns of the three names raise ValueError.
    """
    refuse(df, NEW.fieldNames())
    held = df.sparkSession.sparkContext.broadcast(astuple(model))  # plain values: workers need no copy of the package
    schema = T.StructType([*df.schema.fields, *NEW.fields])
    names = df.columns

    def run(batches):
        model = Model(*held.value)
        for batch in batches:
            data, offsets = text_buffer(batch.column(names.index(text)))
            letter = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in slices(offsets, 500_000):
                if model.languages:
                    best, sure, known = score(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                else:
                    best, sure, known = np.full(b - a, -1), np.zeros(b - a), np.zeros(b - a)
                said = ["und" if not ok or not model.languages else model.languages[k] if k >= 0 else model.fallback for k, ok in zip(best, letter[a:b], strict=True)]
                made = [pa.array(said, pa.string()), *[pa.array(np.where(letter[a:b], x, 0.0)) for x in (sure, known)]]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], *made], names=[*names, *NEW.fieldNames()])
            release()

    return df.select(*[F.col(c) for c in names], has_letter(text).alias("__letters")).mapInArrow(run, schema)


def held_out(key: str):
    """Whether a document is kept from training: a fifth by the CRC of its id's text."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out("doc_id")).select("text", "lang"), "text", "lang")
    return identify(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model, "text").drop("text")
