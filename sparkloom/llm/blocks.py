"""Finding hashes that occur in several places, for operators that look at every window of every text.

Rows are dealt to blocks of a few megabytes of text. A block turns its hashes into one sorted, difference-coded blob
for each hash range (bucket), so a hash costs about six bytes in the shuffle and a repeated one counts once a block: a
passage that a third of all rows share sends no more than a block's worth of it from each block. A bucket meets the
blobs of all blocks and answers each block with what it needs to know. The next step reads the same blocks together
with the answers; Spark reuses the exchange that dealt the texts, so they are shuffled once.

Blocks and buckets both grow with the root of the input beyond 64 GB, up to 16 times (64 MB of text, 32 million hashes), so
a blob holds some hundreds of hashes up to 16 TB and still about twenty at 100 TB, where a hash costs some nine bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, pack_sorted, refuse, released, shuffle_partitions, unpack_sorted

BLOCK = "__block"
#: Bytes of text in a block and hashes in a bucket, about, as long as the input is no larger than STEADY bytes.
BLOCK_BYTES, BUCKET_HASHES, STEADY, GROWTH = 4 << 20, 2_000_000, 64 << 30, 16
#: Most ranges of an ordered key: the driver holds a few numbers for each.
RANGES = 8192


class Blocks:
    """``rows``: the table with its block number; ``count``: how many blocks; ``buckets(per_byte)``: how many hash ranges.
    ``first``: of ordered blocks the first one of each range of keys, and their number."""

    def __init__(self, df: DataFrame, text: str, key: str, ordered: bool = False, block_bytes: int = BLOCK_BYTES, ranges: int = RANGES):
        """``ordered``: blocks belong to ranges of the key; a smaller key is in no later range, and equal keys share one.
        Null keys are the last range. A range of much more than a block's bytes has several blocks."""
        refuse(df, [BLOCK])
        self.spark = df.sparkSession
        narrow = checkpoint(df.select(F.col(key), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"))) if ordered else df.select(F.octet_length(text).alias("size"))
        rows, self.size = narrow.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        self.parts = shuffle_partitions(self.spark)
        self.growth = min(GROWTH, max(1.0, (self.size / STEADY) ** 0.5))
        block_bytes = int(block_bytes * self.growth)
        self.count = max(1, -(-self.size // block_bytes), min(-(-rows // 200), 4 * self.parts))
        spread = F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key, F.octet_length(text)))
        if ordered:
            wanted = min(self.count, ranges)
            cuts = narrow.approxQuantile(key, [k / wanted for k in range(1, wanted)], 0.2 / wanted) if wanted > 1 else []
            cuts = sorted({int(x) for x in cuts})
            last = len(cuts) + 1
            sizes = {r[0]: r[1] for r in narrow.groupBy(_steps(F.col(key), cuts, last)).agg(F.sum("size")).collect()}  # a row a range
            parts = [1 if sizes.get(k, 0) <= 4 * block_bytes else -(-sizes[k] // block_bytes) for k in range(last + 1)]
            self.first = np.concatenate([[0], np.cumsum(parts)]).astype(np.int64)
            self.count = int(self.first[-1])
            place = _steps(F.col(key), cuts, last)
            if max(parts) > 1:
                at = F.get(_numbers(self.first.tolist()), place)
                place = at + F.pmod(F.xxhash64(key, text), F.get(_numbers(parts), place))
            place = place.cast("int")
        else:
            place = F.pmod(spread, F.lit(self.count)).cast("int")
        self.rows = df.withColumn(BLOCK, place)

    def buckets(self, hashes_per_byte: float) -> int:
        return max(self.parts, int(self.size * hashes_per_byte / (BUCKET_HASHES * self.growth)))

    def emit(self, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        return per_group(self.rows, BLOCK, run, schema)

    def answer(self, answers: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
        return per_pair(self.rows, answers, run, schema)


#: More tasks than that in one stage are left to Spark's own dealing.
MOST_TASKS = 100_000


def by_number(df: DataFrame, key: str, count: int) -> DataFrame:
    """``df`` with a task for each value of ``key``, a number from 0 to count - 1: work on such groups is not in proportion to
    their bytes, by which Spark would put several into one task."""
    return df.repartitionById(count, F.col(key)) if count <= MOST_TASKS else df


def per_group(df: DataFrame, key: str, run: Callable[[pa.Table], pa.Table], schema, count: int | None = None) -> DataFrame:
    """``run`` for the rows of each key; ``count``: see ``by_number``."""
    step = released(run)
    dealt = by_number(df, key, count) if count else df
    return dealt.groupBy(key).applyInArrow(lambda table: step(table), schema)


def per_pair(rows: DataFrame, answers: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """Each block's rows together with its answers."""
    step = released(run)
    return rows.groupBy(BLOCK).cogroup(answers.groupBy("block")).applyInArrow(lambda left, right: step(left, right), schema)


def _numbers(values: list[int]) -> Column:
    """An array of longs as one constant, however many they are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _steps(column: Column, cuts: list[int], last: int) -> Column:
    """How many of the sorted cuts are at most the column's value, by binary search; ``last`` for null."""
    if not cuts:
        return F.when(column.isNull(), F.lit(last)).otherwise(F.lit(0))
    bounds, bits = _numbers(cuts), F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    found = F.aggregate(bits, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= column, at + step).otherwise(at))
    return F.when(column.isNull(), F.lit(last)).otherwise(found)


def cut_points(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts in sorted hashes: buckets are equal ranges of the upper 32 bits."""
    edges = ((np.arange(buckets, dtype=np.uint64) << np.uint64(32)) + np.uint64(buckets - 1)) // np.uint64(buckets)
    return np.append(np.searchsorted(hashes >> np.uint64(32), edges), len(hashes))


HASHES = "bucket int, block int, hashes binary"


def to_buckets(block: int, hashes: np.ndarray, buckets: int, **more: np.ndarray) -> pa.Table:
    """One row for each bucket that has any of the block's sorted distinct hashes; ``more``: arrays cut alike."""
    cut = cut_points(hashes, buckets)
    used = np.flatnonzero(np.diff(cut))
    out = {"bucket": pa.array(used.astype(np.int32)), "block": pa.array(np.full(len(used), block, np.int32)), "hashes": pa.array([pack_sorted(hashes[cut[b] : cut[b + 1]]) for b in used], pa.binary())}
    out |= {name: pa.array([x[cut[b] : cut[b + 1]].tobytes() for b in used], pa.binary()) for name, x in more.items()}
    return pa.table(out)


def gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    """All hashes of a bucket in the order of their blocks, each one's block, the rows' order, and the rows' ends."""
    blocks = table.column("block").to_numpy()
    order = np.argsort(blocks, kind="stable")
    column = table.column("hashes")
    parts = [unpack_sorted(column[int(i)].as_buffer()) for i in order]
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.repeat(blocks[order], sizes), order.tolist(), np.cumsum(sizes)


ANSWER = "block int, hashes binary, extra binary"


def answers(blocks: np.ndarray, hashes: np.ndarray, extra: np.ndarray | None = None) -> pa.Table:
    """A row for each block with its hashes (sorted here) and an array beside them."""
    order = np.lexsort((hashes, blocks))
    blocks, hashes = blocks[order], hashes[order]
    names, first = np.unique(blocks, return_index=True)
    ends = np.append(first, len(blocks))[1:]
    extra = None if extra is None else extra[order]
    return pa.table(
        {
            "block": pa.array(names.astype(np.int32)),
            "hashes": pa.array([pack_sorted(hashes[a:b]) for a, b in zip(first, ends, strict=True)], pa.binary()),
            "extra": pa.array([None if extra is None else extra[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()),
        }
    )


def told(table: pa.Table, kind=None) -> tuple[np.ndarray, np.ndarray | None]:
    """All hashes of a block's answers, sorted, and the arrays beside them (of type ``kind``)."""
    column = table.column("hashes")
    parts = [unpack_sorted(column[i].as_buffer()) for i in range(len(column))]
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    order = np.argsort(hashes, kind="stable")
    if kind is None:
        return hashes[order], None
    beside = table.column("extra")
    more = [np.frombuffer(beside[i].as_buffer(), kind) for i in range(len(beside))]
    return hashes[order], (np.concatenate(more) if more else np.zeros(0, kind))[order]


def lookup(wanted: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each wanted hash is among the sorted known ones, and where."""
    at = np.searchsorted(known, wanted)
    at[at == len(known)] = 0
    return (known[at] == wanted) if len(known) else np.zeros(len(wanted), bool), at


def text_column(parts: Iterable[tuple[np.ndarray, np.ndarray]], kind: pa.DataType) -> pa.ChunkedArray:
    """A string or binary column from (bytes, lengths) pairs."""

    def chunks() -> Iterator[pa.Array]:
        for data, lengths in parts:
            ends = np.concatenate([[0], np.cumsum(lengths)])
            wide = ends[-1] >= 1 << 31
            raw = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int64 if wide else np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
            yield raw.cast(kind)

    return pa.chunked_array(list(chunks()), type=kind)
