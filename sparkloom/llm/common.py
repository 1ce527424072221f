"""Helpers that several operators share: session settings, checkpoints, byte and word views of Arrow text."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = (1 << 64) - 1
#: Fixed odd multipliers of the hashes; any odd 64-bit values would do.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BYTE_BASE = 0x9E3779B97F4A7C15


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one that the session names in spark.checkpoint.dir. Where it names none, a
    temporary folder is set in local mode (tests); on a cluster that raises ValueError."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sparkloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few numbers each that a join may send to every executor: some tens of megabytes.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are within the bound; a side of more rows is left to be shuffled."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def release() -> None:
    """Give freed memory back: a Python worker lives on between tasks, and what it holds counts against its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """``run`` for a group of rows, followed by ``release``."""

    def wrapped(*tables: pa.Table) -> pa.Table:
        out = run(*tables)
        del tables
        release()
        return out

    return wrapped


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that nothing refers to any more. It does so when the driver collects garbage,
    which may be long after a checkpoint has taken the place of a large shuffle. Later rounds find what the finalisers of
    earlier ones have let go."""
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def trim_executors(spark: SparkSession) -> None:
    """Let every executor collect its garbage in full, which gives unused heap, direct buffers and generated code back to the
    system; otherwise its process only grows from one job to the next. A task a core does it, and an idle cluster deals those
    to all executors; one that is missed costs memory, never rows."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits (splitmix64's)."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have += more
    return out


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the n+1 offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):  # no chunk at all
            return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


#: The six separators of a word: space and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the index of its first word (n+1 values)."""
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BYTE_BASE) -> np.ndarray:
    """A mixed 64-bit polynomial hash of each word's bytes; equal words have equal hashes wherever they stand.

    Bytes are added in groups that share a length position (first bytes, second bytes and so on), so the work
    is one vector step for each position and no more than the bytes in all.
    """
    size = ends - starts
    out = size.astype(np.uint64)
    left = np.arange(len(starts))
    step, mult = 0, np.uint64(base | 1)
    while len(left) and step < 48:
        out[left] = out[left] * mult + data[starts[left] + step] + np.uint64(1)
        step += 1
        left = left[size[left] > step]
    for i in left:  # words of more than 48 bytes
        word = data[starts[i] + step : ends[i]].astype(np.uint64) + np.uint64(1)
        weight = powers(int(mult), len(word) + 1)
        out[i] = (int(out[i]) * int(weight[-1]) + int((word * weight[:-1][::-1]).sum(dtype=np.uint64))) & MASK
    return mix64(out)


def slices(offsets: np.ndarray, limit: int = 2_000_000) -> list[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each, so that the arrays made from them stay small; a longer row stands alone."""
    out, row, rows = [], 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), rows)
        out.append((row, end))
        row = end
    return out


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as the first one and byte planes of their differences, without the upper planes that are all zero."""
    if not len(values):
        return b""
    steps = np.diff(values)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 0
    planes = steps.view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + values[:1].tobytes() + np.ascontiguousarray(planes.T).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width = blob[0]
    first = np.frombuffer(blob, np.uint64, 1, 1)
    if not width:
        return first
    planes = np.frombuffer(blob, np.uint8, offset=9).reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :width] = planes.T
    out = np.empty(len(steps) + 1, np.uint64)
    out[0] = first[0]
    np.cumsum(steps.view(np.uint64)[:, 0], out=out[1:])
    out[1:] += first[0]
    return out


KINDS = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType()}


def fields(**kinds: str | T.DataType) -> T.StructType:
    """A schema of nullable columns; unlike a DDL string it needs no running session."""
    return T.StructType([T.StructField(name, KINDS[kind] if isinstance(kind, str) else kind) for name, kind in kinds.items()])


def refuse(df: DataFrame, names: Iterable[str]) -> None:
    """Raise ValueError if ``df`` has a column of one of these names (in any case, as Spark resolves them)."""
    own = {c.lower() for c in df.columns}
    if clash := sorted(n for n in names if n.lower() in own):
        raise ValueError(f"column names in use: {clash}")
