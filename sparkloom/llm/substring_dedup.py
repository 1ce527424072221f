"""Substring dedup: Rabin-Karp hashes of every window of 13 words; repeated windows merge into removal intervals.

Blocks of documents are cut by ascending id. Each block sends its distinct window hashes, a bucket of a hash range tells
every block which of them stand in an earlier range of ids, and the block itself knows which stand in an earlier document
of its own. A range that a repeated or missing id makes too large has several blocks; hashes that several blocks of one
range share, and no earlier one, are exchanged once more with the least id that each block has them under. A word that
any such window covers is removed; adjacent and overlapping windows make one interval. Hashes have 64 bits: among n
distinct windows an equal pair of different ones is expected n*n / 2**65 times.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import ANSWER, BLOCK, BLOCK_BYTES, HASHES, RANGES, Blocks, answers, gathered, lookup, per_group, text_column, to_buckets, told
from .common import fields, mix64, read_table, refuse, slices, text_buffer, word_hashes, word_spans

#: Multiplier of the rolling hash over word hashes.
WINDOW_BASE = np.uint64(0xD6E8FEB86659FD93)
#: How an id-less document sorts: after all others.
NO_ID = np.iinfo(np.int64).max


def window_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``size`` words that lies in one row, and the index of its first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rolled = words[:n].copy()
    for k in range(1, size):
        rolled = rolled * WINDOW_BASE + words[k : k + n]
    ends = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + size <= ends[:n])
    return mix64(rolled[at]), at


def _windows(data: np.ndarray, offsets: np.ndarray, size: int):
    """Of each slice of rows: its bounds, bytes, word starts and ends, first words, window hashes and starts."""
    for a, b in slices(offsets):
        part, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = word_spans(part, local)
        hashes, at = window_hashes(word_hashes(part, starts, ends), first, size)
        yield a, b, part, local, starts, ends, first, hashes, at


def kept_words(part: np.ndarray, local: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and lengths of each row's kept words joined by one space."""
    edge = np.zeros(len(part) + 1, np.int8)
    edge[starts[keep]] += 1
    edge[ends[keep]] -= 1
    mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    kept = np.flatnonzero(keep)
    row = np.searchsorted(first, kept, "right")
    between = kept[:-1][row[:-1] == row[1:]]  # a later word of the row follows
    out = part.copy()
    out[ends[between]] = 0x20
    mask[ends[between]] = True
    total = np.concatenate([[0], np.cumsum(mask)])
    return out[mask], np.diff(total[local])


SPANS = fields(n_words="long", n_removed="long", removed=T.ArrayType(fields(word="long", length="long")), kept="string")


#: What a bucket says of a hash: an earlier range has it; no earlier one, but another block of the same range.
EARLIER, SHARED = 1, 2


def substring_dedup(df: DataFrame, key: str, text: str, size: int = 13, block_bytes: int = BLOCK_BYTES, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``n_words``, ``n_removed``, ``removed`` (maximal intervals of removed words) and ``kept`` (text).

    A word is removed if a window of ``size`` words that covers it also starts in a row with a smaller key. Words are
    [^\\x20\\x09-\\x0D]+ of the whole text, unchanged. ``key`` is an integer column. A null text has no words and an
    empty ``kept``; a text of fewer words than a window loses none; rows of equal keys never cause each other's removal;
    a null key counts as larger than any other. An empty table gives no rows. Columns of the new names raise ValueError;
    other columns may have any name.
    """
    refuse(df, SPANS.fieldNames())
    given, names = df.schema, [f"column_{k}" for k in range(len(df.columns))]
    key, text, df = names[given.names.index(key)], names[given.names.index(text)], df.toDF(*names)
    blocks = Blocks(df, text, key, True, block_bytes, ranges)
    buckets, first = blocks.buckets(0.17), blocks.first

    def emit(table: pa.Table) -> pa.Table:
        data, offsets = text_buffer(table.column(text))
        parts = [np.unique(x[7]) for x in _windows(data, offsets, size)]
        return to_buckets(table.column(BLOCK)[0].as_py(), np.unique(np.concatenate(parts)), buckets)

    def meet(table: pa.Table) -> pa.Table:
        hashes, block, _, _ = gathered(table)
        order = np.argsort(hashes, kind="stable")  # blocks ascend among equal hashes
        hashes, block = hashes[order], block[order]
        part = np.searchsorted(first, block, "right")
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = hashes[1:] != hashes[:-1]
        lead = part[fresh][np.cumsum(fresh) - 1] if len(part) else part
        same = ~fresh & (part == lead)
        shared = same.copy()
        shared[:-1] |= same[1:]  # the first of them too
        flag = np.where(part > lead, EARLIER, np.where(shared, SHARED, 0)).astype(np.uint8)
        return answers(block[flag > 0], hashes[flag > 0], flag[flag > 0])

    def owners(found: list, keys: np.ndarray) -> np.ndarray:
        return np.concatenate([keys[x[0] + np.searchsorted(x[6], x[8], "right") - 1] for x in found])

    def emit_least(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return to_buckets(0, np.zeros(0, np.uint64), 1, least=np.zeros(0, np.int64))
        known, flag = told(answer, np.uint8)
        known = known[flag == SHARED]
        data, offsets = text_buffer(table.column(text))
        found = list(_windows(data, offsets, size))
        every, owner = np.concatenate([x[7] for x in found]), owners(found, table.column(key).fill_null(NO_ID).to_numpy().astype(np.int64))
        use = lookup(every, known)[0]
        order = np.lexsort((owner[use], every[use]))
        hashes, owner = every[use][order], owner[use][order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = hashes[1:] != hashes[:-1]
        return to_buckets(table.column(BLOCK)[0].as_py(), hashes[fresh], buckets, least=owner[fresh])

    def meet_least(table: pa.Table) -> pa.Table:
        hashes, block, order, _ = gathered(table)
        column = table.column("least")
        least = np.concatenate([np.frombuffer(column[i].as_buffer(), np.int64) for i in order])
        _, group = np.unique(hashes, return_inverse=True)  # SHARED hashes stand in one range only
        lowest = np.full(group.max() + 1, NO_ID)
        np.minimum.at(lowest, group, least)
        return answers(block, hashes, lowest[group])

    def finish(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return no_rows(table, names)
        second = np.array([kind == 1 for kind in answer.column("kind").to_pylist()], bool)
        known, flag = told(answer.filter(pa.array(~second)), np.uint8)
        known = known[flag == EARLIER]
        data, offsets = text_buffer(table.column(text))
        found = list(_windows(data, offsets, size))
        every, owner = np.concatenate([x[7] for x in found]), owners(found, table.column(key).fill_null(NO_ID).to_numpy().astype(np.int64))
        repeated, _ = lookup(every, known)
        if second.any():
            known, lowest = told(answer.filter(pa.array(second)), np.int64)
            has, at = lookup(every, known)
            repeated[has] |= lowest[at[has]] < owner[has]
        order = np.argsort(every, kind="stable")
        same = every[order][1:] == every[order][:-1]
        twice = np.zeros(len(every), bool)
        twice[1:] |= same
        twice[:-1] |= same
        order = order[twice]
        if len(order):
            order = order[np.lexsort((owner[order], every[order]))]
            new = np.ones(len(order), bool)
            new[1:] = every[order][1:] != every[order][:-1]
            least = owner[order][new][np.cumsum(new) - 1]
            repeated[order] |= least < owner[order]
        n_words, n_removed, spans, kept, done = [], [], [], [], 0
        for a, b, part, local, starts, ends, first, hashes, at in found:
            cover = np.zeros(len(starts) + 1, np.int64)
            hit = at[repeated[done : done + len(at)]]
            done += len(at)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + size, -1)
            gone = np.cumsum(cover[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            n_words.append(np.diff(first))
            n_removed.append(np.diff(total[first]))
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            heads = first[:-1][first[:-1] < first[1:]]
            begin[heads] = gone[heads]
            begin = np.flatnonzero(begin)
            row = np.searchsorted(first, begin, "right") - 1
            free = np.append(np.flatnonzero(~gone), len(gone))
            stop = np.minimum(free[np.searchsorted(free, begin)], first[row + 1])
            cut = np.searchsorted(row, np.arange(b - a + 1))
            structs = pa.StructArray.from_arrays([pa.array(begin - first[row], pa.int64()), pa.array(stop - begin, pa.int64())], names=["word", "length"])
            spans.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), structs))
            kept.append(kept_words(part, local, starts, ends, first, ~gone))
        made = [pa.array(np.concatenate(n_words), pa.int64()), pa.array(np.concatenate(n_removed), pa.int64()), pa.chunked_array(spans), text_column(kept, pa.string())]
        return pa.table([*[table.column(c) for c in names], *made], names=[*names, *SPANS.fieldNames()])

    met = per_group(blocks.emit(emit, HASHES), "bucket", meet, ANSWER, buckets)
    said = met.withColumn("kind", F.lit(0))
    if blocks.count > len(first) - 1:  # some range has several blocks
        least = per_group(blocks.answer(met, emit_least, HASHES + ", least binary"), "bucket", meet_least, ANSWER, buckets)
        said = said.union(least.withColumn("kind", F.lit(1)))
    return blocks.answer(said, finish, T.StructType([*df.schema.fields, *SPANS.fields])).toDF(*given.names, *SPANS.fieldNames())


def no_rows(table: pa.Table, names: list[str]) -> pa.Table:
    """The result of a block without rows."""
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("word", pa.int64()), ("length", pa.int64())])), pa.string()]
    return pa.table([*[table.column(c) for c in names], *[pa.array([], k) for k in kinds]], names=[*names, *SPANS.fieldNames()])


def op9_rabin_karp_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that an earlier document has."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup(docs, "doc_id", "text")
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("removed").cast("long").alias("n_spans"))


#: The same in SQL, windows as texts.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT k, min(doc_id) AS least FROM s GROUP BY k),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT s.doc_id, s.i, unnest(range(0, 13)) AS j FROM s JOIN m ON s.k = m.k WHERE m.least < s.doc_id)),
o AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
r AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM o ANTI JOIN c USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE (doc_id, p - 1) NOT IN (SELECT (doc_id, p) FROM c)) AS n_spans FROM c GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n.n_removed, 0) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256, coalesce(n.n_spans, 0) AS n_spans
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN n USING (doc_id)
"""
