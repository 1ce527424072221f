"""Toxicity by classifier chains of sparse linear models.

The categories have an order. The first model sees a document's features only; each later one also sees the log-odds
that the earlier models gave. A later model is trained on out-of-fold predictions of the earlier ones (each training row
is scored by models that did not see it), so it meets the same kind of inputs when it is applied.

Training uses at most ``max_rows`` labelled documents, the least by a hash of their id (a documented bound); the fits of a
link and of its folds are tasks beside each other. Applying the chain is one pass over all rows without a shuffle; the broadcast holds ``max_features`` weights a
category at most.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, read_table, release, slices, text_buffer, word_hashes, word_spans

#: Feature numbers are hashes of this many bits.
BITS = 20
#: Bytes as the features see them: A-Z lower-cased; ASCII punctuation ends a word in the first view.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORDS = LOWER.copy()
WORDS[[b for b in range(128) if not chr(b).isalnum()]] = 32


@dataclass(frozen=True)
class Link:
    """One model of the chain: sorted feature numbers, their weights, the weight of each earlier log-odds, a bias."""

    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


def document_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once, sorted: words, their first four bytes, and the last two bytes of raw words."""
    found = []
    for view, kind in ((WORDS, 0), (LOWER, 2)):
        seen = view[data]
        starts, ends, first = word_spans(seen, offsets)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        cuts = ((starts, ends), (starts, np.minimum(starts + 4, ends))) if kind == 0 else ((np.maximum(ends - 2, starts), ends),)
        for k, (a, b) in enumerate(cuts):
            hashed = mix64(word_hashes(seen, a, b) + np.uint64(kind + k + 1)) >> np.uint64(64 - BITS)
            found.append((row.astype(np.uint64) << np.uint64(BITS)) | hashed)
    pairs = np.unique(np.concatenate(found))
    return (pairs >> np.uint64(BITS)).astype(np.int64), (pairs & np.uint64((1 << BITS) - 1)).astype(np.int64)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_link(row: np.ndarray, feature: np.ndarray, rows: int, target: np.ndarray, earlier: np.ndarray, max_features: int, rounds: int = 150, l1: float = 2e-4, l2: float = 1e-4) -> Link:
    """Sparse logistic regression by accelerated proximal gradient on the features with the largest chi-square."""
    positive = target.sum()
    if positive in (0, rows):  # nothing to tell apart
        odds = np.log((positive + 0.5) / (rows - positive + 0.5))
        return Link(np.zeros(0, np.int64), np.zeros(0), np.zeros(earlier.shape[1]), float(odds))
    have = np.bincount(feature, minlength=1 << BITS)
    hit = np.bincount(feature, weights=target[row], minlength=1 << BITS)
    rate = positive / rows
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(have >= 2, (hit - have * rate) ** 2 / (have * rate * (1 - rate) * np.maximum(1 - have / rows, 1e-3)), 0)
    chosen = np.sort(np.argsort(-gain, kind="stable")[:max_features])
    chosen = chosen[gain[chosen] > 0]
    slot = np.full(1 << BITS, -1)
    slot[chosen] = np.arange(len(chosen))
    keep = slot[feature] >= 0
    row, col, n = row[keep], slot[feature[keep]], len(chosen)
    scale = 1 / np.sqrt(np.maximum(have[chosen], 1))  # rare features count as much as common ones
    ahead = earlier / 4
    size = n + ahead.shape[1] + 1
    weight = np.zeros(size)
    weight[-1] = np.log(rate / (1 - rate))
    look, pace = weight.copy(), 1.0
    balance = np.where(target == 1, 0.5 / rate, 0.5 / (1 - rate))
    norm = np.sqrt(rows)

    def margin(w):
        return np.bincount(row, weights=(w[:n] * scale)[col] * norm / 8, minlength=rows) + ahead @ w[n:-1] + w[-1]

    step = 2.0
    for _ in range(rounds):
        slope = (logistic(margin(look)) - target) * balance / rows
        grad = np.concatenate([np.bincount(col, weights=slope[row], minlength=n) * scale * norm / 8, slope @ ahead, [slope.sum()]])
        new = look - step * (grad + l2 * look)
        new[:n] = np.sign(new[:n]) * np.maximum(np.abs(new[:n]) - step * l1, 0)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        look, weight, pace = new + (pace - 1) / faster * (new - weight), new, faster
    own = weight[:n] * scale * norm / 8
    used = own != 0
    return Link(chosen[used], own[used], weight[n:-1] / 4, float(weight[-1]))


def log_odds(link: Link, row: np.ndarray, feature: np.ndarray, rows: int, earlier: np.ndarray) -> np.ndarray:
    at = np.searchsorted(link.features, feature)
    known = at < len(link.features)
    known[known] = link.features[at[known]] == feature[known]
    out = np.bincount(row[known], weights=link.weights[at[known]], minlength=rows) if known.any() else np.zeros(rows)
    return np.clip(out + earlier @ link.earlier + link.bias, -20, 20)


def subset(row: np.ndarray, feature: np.ndarray, rows: int, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (row, feature) pairs of some rows, which are numbered anew."""
    place = np.full(rows, -1)
    place[part] = np.arange(len(part))
    inside = place[row] >= 0
    return place[row[inside]], feature[inside]


def fit_fold(row: np.ndarray, feature: np.ndarray, target: np.ndarray, earlier: np.ndarray, fold: np.ndarray, f: int, max_features: int) -> tuple[Link | None, np.ndarray]:
    """Fold -1: the link of all rows. Else the log-odds of the fold's rows by a link of the other rows."""
    rows = len(target)
    if f < 0:
        return fit_link(row, feature, rows, target, earlier, max_features), np.zeros(0)
    train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
    if not len(train) or not len(test):
        return None, np.zeros(len(test))
    link = fit_link(*subset(row, feature, rows, train), len(train), target[train], earlier[train], max_features)
    return None, log_odds(link, *subset(row, feature, rows, test), len(test), earlier[test])


def fit_chain(row: np.ndarray, feature: np.ndarray, targets: np.ndarray, folds: int = 4, max_features: int = 4000, spark: SparkSession | None = None) -> list[Link]:
    """A link for each column of ``targets`` (rows x categories, 0 or 1). Row k is in fold k modulo ``folds``.

    With a session, the fits of one link are tasks of one job: they get the sample's features by a broadcast.
    """
    rows, chain, earlier = len(targets), [], np.zeros((len(targets), 0))
    fold = np.arange(rows) % folds
    have = np.bincount(feature, minlength=1 << BITS)
    keep = have[feature] > 1  # no fit uses the others
    row, feature = row[keep].astype(np.int32), feature[keep].astype(np.int32)
    for k in range(targets.shape[1]):
        last = k + 1 == targets.shape[1]
        work = (row, feature, targets[:, k].astype(float), earlier, fold)
        parts = [-1, *([] if last else range(folds))]
        if spark is None or last:
            made = [(f, *fit_fold(*work, f, max_features)) for f in parts]
        else:
            held = spark.sparkContext.broadcast(work)

            def run(batches, held=held):
                for batch in batches:
                    for f in batch.column(0).to_pylist():
                        link, odds = fit_fold(*held.value, f - 1, max_features)
                        yield pa.RecordBatch.from_pydict({"f": [f - 1], "blob": [pickle.dumps((link and astuple(link), odds))]})

            tasks = spark.range(0, len(parts), 1, len(parts)).mapInArrow(run, "f long, blob binary")
            said = [(r["f"], *pickle.loads(bytes(r["blob"]))) for r in tasks.collect()]  # a link, and numbers for each row
            made = [(f, link and Link(*link), odds) for f, link, odds in said]
            held.destroy()
        chain.append(next(link for f, link, _ in made if f < 0))
        if not last:
            unseen = np.zeros(rows)
            for f, _, odds in made:
                if f >= 0:
                    unseen[fold == f] = odds
            earlier = np.column_stack([earlier, unseen])
    return chain


def train_chain(docs: DataFrame, labels: DataFrame, key: str, text: str, categories: Sequence[str], max_rows: int = 6000) -> list[Link]:
    """Learn from labelled documents: ``labels`` has ``key`` and a 0/1 column for each category.

    Rows with a null key or label are left out; of several labels of a key the greatest counts. At most ``max_rows``
    labelled documents are used, the least by a hash of the key. Without any, every probability is one half.
    """
    spark = docs.sparkSession
    named = labels.dropna(subset=[key, *categories]).groupBy(key).agg(*[F.max(F.col(c).cast("int")).alias(f"__y{k}") for k, c in enumerate(categories)])
    sample = named.orderBy(F.xxhash64(key), key).limit(max_rows)
    rows = docs.select(F.col(key), F.col(text).alias("__text")).join(F.broadcast(sample), key)
    ys = [f"__y{k}" for k in range(len(categories))]

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets):
                row, feature = document_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                cut = np.searchsorted(row, np.arange(b - a + 1))
                blobs = [feature[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(blobs, pa.binary()), *[c.slice(a, b - a) for c in batch.columns[2:]]], names=["key", "blob", *ys])

    fields = [T.StructField("key", docs.schema[key].dataType), T.StructField("blob", T.BinaryType()), *[T.StructField(y, T.IntegerType()) for y in ys]]
    found = rows.select(key, "__text", *ys).mapInArrow(run, T.StructType(fields)).collect()
    found.sort(key=lambda r: (str(r[0]), bytes(r[1])))
    if not found:
        return [Link(np.zeros(0, np.int64), np.zeros(0), np.zeros(k), 0.0) for k in range(len(categories))]
    features = [np.frombuffer(r[1], np.int32) for r in found]
    row = np.repeat(np.arange(len(found)), [len(x) for x in features])
    return fit_chain(row, np.concatenate(features).astype(np.int64), np.array([[r[2 + k] > 0 for k in range(len(categories))] for r in found]), spark=spark)


def apply_chain(df: DataFrame, chain: list[Link], text: str, categories: Sequence[str]) -> DataFrame:
    """``df`` with ``p_<category>`` (double) for each category, predicted in order from the whole text.

    A null or empty text has no features: it gets what the biases alone say. Columns of these names raise ValueError.
    """
    new = [f"p_{c}" for c in categories]
    if clash := set(new) & set(df.columns):
        raise ValueError(f"column names in use: {sorted(clash)}")
    held, names = df.sparkSession.sparkContext.broadcast([astuple(link) for link in chain]), df.columns  # plain values
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in new]])

    def run(batches):
        chain = [Link(*link) for link in held.value]
        for batch in batches:
            data, offsets = text_buffer(batch.column(names.index(text)))
            for a, b in slices(offsets):
                row, feature = document_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                earlier = np.zeros((b - a, 0))
                for link in chain:
                    earlier = np.column_stack([earlier, log_odds(link, row, feature, b - a, earlier)])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *[pa.array(logistic(earlier[:, k])) for k in range(len(chain))]], names=[*names, *new])
            release()

    return df.mapInArrow(run, schema)


CATEGORIES = ("low_quality", "toxic")


def op3_toxicity_chain(spark, sf_dir: str) -> DataFrame:
    """Probabilities of low quality and toxicity for every document, and whether each is more likely than not."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"), "toxic")
    out = apply_chain(docs, train_chain(docs, labels, "doc_id", "text", CATEGORIES), "text", CATEGORIES)
    return out.select("doc_id", *[f"p_{c}" for c in CATEGORIES], *[(F.col(f"p_{c}") >= 0.5).alias(c) for c in CATEGORIES])
