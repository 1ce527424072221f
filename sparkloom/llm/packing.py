"""Best-fit packing by a configuration linear program over the length histogram.

Texts become token pieces of at most the capacity. The histogram of piece lengths (as many rows as the capacity, however
large the corpus) goes to the driver. A linear program over configurations - multisets of lengths that fit one sequence -
is solved by multiplicative weights: each round prices the lengths by how far their coverage lags, a knapsack dynamic
program finds the configurations of greatest price, and the prices scaled by that value are a feasible dual, so their worth
is a lower bound. The mean of the rounds is rounded down and the program of the rest solved again, several times; what is
left then is placed by best fit. Every piece finds its place from its rank among the pieces of its length.

Ranks come from a range exchange over (length, piece), so one length shared by a third of all pieces is spread over
partitions like any other run; only a row for each (partition, length) is broadcast, at most partitions + capacity.
"""

from __future__ import annotations

import json
import pickle
import sys
import types
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, fields, read_table, refuse, release, shuffle_partitions, slices, text_buffer

#: First bytes of code points from U+0280 on. Texts without them (ASCII and Latin letters, whose classes all Unicode
#: versions agree on) may take the fast encoder.
BEYOND = np.arange(256) >= 0xCA
#: The split pattern of the byte-level pre-tokeniser: a fixed value of the vocabulary's format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The vocabulary's character for each byte: itself if printable, else the next free code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Token ids of a byte-level vocabulary file as the ``tokenizers`` library gives them.

    Texts of ASCII and Latin letters go through ``tiktoken`` with the same vocabulary as ranks, which gives the same ids in
    a quarter of the time; texts with other code points or a special token's name go through ``tokenizers`` itself, as do
    all if the vocabulary is not of the kind that both read alike (one split pattern, ids in merge order).
    """

    def __init__(self, vocabulary: bytes):
        self.vocabulary, self.exact, self.fast = vocabulary, None, None
        said = json.loads(vocabulary)
        model, split, self.special = said["model"], said.get("pre_tokenizer") or {}, [t["content"] for t in said.get("added_tokens", [])]
        plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        if plain and said.get("normalizer") is None and not model.get("dropout"):
            alphabet = byte_alphabet()
            names = {name: at for name, at in model["vocab"].items() if name not in self.special}
            ranks = {bytes(alphabet[c] for c in name): at for name, at in names.items() if all(c in alphabet for c in name)}
            pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            order = [names.get("".join(pair)) for pair in pairs]
            if len(ranks) == len(names) == 256 + len(order) and None not in order and order == sorted(order):
                import tiktoken

                self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str], simple: list[bool]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers; ``simple``: no code point lies beyond Latin letters."""
        out: list[bytes] = [b""] * len(texts)
        slow = []
        for i, (text, fine) in enumerate(zip(texts, simple, strict=True)):
            if fine and self.fast and not any(name in text for name in self.special):
                out[i] = self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            else:
                slow.append(i)
        if slow:
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_buffer(self.vocabulary)
            for i, made in zip(slow, self.exact.encode_batch([texts[i] for i in slow], add_special_tokens=False), strict=True):
                out[i] = np.array(made.ids, "<u4").tobytes()
        return out


def worker_encoder(vocabulary: bytes) -> Encoder:
    """The encoder of this Python process: a worker that runs several tasks keeps it."""
    state = sys.modules.setdefault("sparkloom_worker_state", types.ModuleType("sparkloom_worker_state"))
    name = f"encoder_{zlib.crc32(vocabulary)}"
    if not hasattr(state, name):
        setattr(state, name, Encoder(vocabulary))
    return getattr(state, name)


PIECE = fields(piece="int", start="long", length="long", ids="binary")


def tokenize(df: DataFrame, text: str, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """A row for each piece of each row: the other columns, ``piece`` (from 0), ``start`` (ids before it), ``length`` and
    ``ids`` (little-endian unsigned 32-bit numbers).

    A row's ids are those of its whole text (null: none) and then ``end_id``. Rows of more than ``capacity`` ids are cut
    into pieces of that many; the first piece may be shorter. ``vocabulary`` is a file on the driver, which broadcasts it.
    """
    rest = [c for c in df.columns if c != text]
    refuse(df.select(*rest), PIECE.fieldNames())
    with open(vocabulary, "rb") as file:
        held = df.sparkSession.sparkContext.broadcast(file.read())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = worker_encoder(held.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            data, offsets = text_buffer(column)
            for a, b in slices(offsets, 1_000_000):
                beyond = np.concatenate([[0], np.cumsum(BEYOND[data[offsets[a] : offsets[b]]])])
                simple = (np.diff(beyond[offsets[a : b + 1] - offsets[a]]) == 0).tolist()
                row, piece, start, length, ids = [], [], [], [], []
                texts = [str(data[offsets[i] : offsets[i + 1]], "utf-8") for i in range(a, b)]
                for i, made in enumerate(encoder.encode(texts, simple)):
                    made += end
                    count = len(made) // 4
                    cuts = [0, *range(count % capacity or capacity, count + 1, capacity)]
                    for k in range(len(cuts) - 1):
                        row.append(a + i)
                        piece.append(k)
                        start.append(cuts[k])
                        length.append(cuts[k + 1] - cuts[k])
                        ids.append(made[4 * cuts[k] : 4 * cuts[k + 1]])
                given = [c.take(pa.array(row, pa.int64())) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*given, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=[*rest, *PIECE.fieldNames()])
            release()

    return df.select(*rest, F.col(text).cast("string")).mapInArrow(run, T.StructType([*[df.schema[c] for c in rest], *PIECE.fields]))


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences that each hold ``counts[k]`` pieces of length ``lengths[k]``, in this order."""

    lengths: tuple[int, ...]
    counts: tuple[int, ...]
    times: int


def best_values(lengths: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """The knapsack dynamic program: for each room from 0 to the capacity the greatest value of a multiset that fits it."""
    best, single = np.zeros(capacity + 1), np.full(capacity + 1, -np.inf)
    single[lengths] = values
    for room in range(int(lengths[0]), capacity + 1):
        best[room] = max(best[room - 1], (single[1 : room + 1] + best[room - 1 :: -1]).max())
    return best


def configuration(lengths: np.ndarray, values: np.ndarray, best: np.ndarray, supply: np.ndarray, capacity: int, first: int | None = None) -> dict[int, int]:
    """{number of a length: count}: a multiset of greatest value by the table ``best`` of those that hold ``first``. While
    supplies last it is exact; a length that runs out is replaced by the next best. Of equal ones the longest comes first."""
    counts: dict[int, int] = {}
    gone = supply <= 0
    room = capacity
    while True:
        if first is not None:
            k, first = first, None
        else:
            fits = int(np.searchsorted(lengths, room, "right"))
            if not fits:
                return counts
            gain = np.where(gone[:fits], -np.inf, values[:fits] + best[room - lengths[:fits]])
            k = fits - 1 - int(gain[::-1].argmax())
            if gain[k] == -np.inf:
                return counts
        counts[k] = counts.get(k, 0) + 1
        room -= int(lengths[k])
        if counts[k] + 1 > supply[k]:
            if not gone[k]:
                gone = gone.copy() if len(counts) == 1 and counts[k] == 1 else gone
                gone[k] = True


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of each length (ascending) in the multiset of greatest value that fits the capacity."""
    counts = np.zeros(len(lengths), np.int64)
    for k, n in configuration(lengths, values, best_values(lengths, values, capacity), np.full(len(lengths), capacity + 1), capacity).items():
        counts[k] = n
    return counts


def fractional(lengths: np.ndarray, wanted: np.ndarray, capacity: int, step: float, rounds: int = 100, near: float = 1e-3) -> tuple[dict[tuple, float], float]:
    """A fractional solution of the configuration program, {configuration: sequences}, and a lower bound of any packing.

    A length's price starts as its size, which proves the area bound. Each round the knapsack's greatest value scales the
    prices to a feasible dual, whose value is a lower bound. Every length is asked for the best configuration that holds it;
    those of (nearly) the greatest value share the round's sequences, as many as the bound. The price of a length that
    they hold too often is divided, that of one that they hold too rarely multiplied, by up to e**step. The solution is the
    mean of the rounds, without their first quarter; its configurations keep to the supplies.
    """
    log_price, found, bound, skip = np.log(lengths), {}, 0.0, rounds // 4
    for turn in range(rounds):
        price = np.exp(log_price - log_price.max())
        best = best_values(lengths, price, capacity)
        least = float(price @ wanted) / best[capacity]
        bound = max(bound, least)
        firsts = np.flatnonzero(price + best[capacity - lengths] >= best[capacity] * (1 - near))
        chosen = [configuration(lengths, price, best, wanted, capacity, k) for k in firsts.tolist()]
        held = np.zeros(len(lengths))
        for counts in chosen:
            for k, n in counts.items():
                held[k] += n
            if turn >= skip:
                name = tuple(sorted(counts.items()))
                found[name] = found.get(name, 0.0) + least / len(chosen) / (rounds - skip)
        lag = 1 - held * (least / len(chosen)) / wanted
        log_price += step / np.sqrt(1 + turn / 20) * np.clip(lag, -1, 1)
    return found, bound


def longest_first(lengths: np.ndarray, wanted: np.ndarray, capacity: int, again: int = 64) -> dict[tuple, int]:
    """{configuration: times} for all pieces: each configuration holds the longest piece left and fills its room best."""
    left, made = wanted.copy(), {}
    while left.any():
        live = np.flatnonzero(left)
        own, some = lengths[live], left[live]
        price = own.astype(float)
        best = best_values(own, price, capacity)
        for _ in range(again):  # with one table, as long as supplies last
            last = np.flatnonzero(some)
            if not len(last):
                break
            counts = configuration(own, price, best, some, capacity, int(last[-1]))
            times = min(int(some[k] // n) for k, n in counts.items())
            name = tuple(sorted((int(live[k]), n) for k, n in counts.items()))
            made[name] = made.get(name, 0) + times
            for k, n in counts.items():
                some[k] -= n * times
        left[live] = some
    return made


@dataclass(frozen=True)
class Solution:
    """``patterns`` hold every piece once; no packing has fewer than ``bound`` sequences; ``rounded`` is the share of the
    tokens that rounded configurations of the linear program hold."""

    patterns: list[Pattern]
    bound: int
    rounded: float

    @property
    def used(self) -> int:
        return sum(p.times for p in self.patterns)


#: Sizes of the weights' steps, each of which is tried: which one rounds best depends on the histogram.
STEPS = (0.02, 0.006, 0.002)


def solve(histogram: dict[int, int], capacity: int, steps: Sequence[float] = STEPS, passes: int = 6) -> Solution:
    """Pack every piece of the histogram.

    The configuration program is solved, its counts are rounded down, and the program of what is left is solved again, up
    to ``passes`` times. After each pass the rest is also packed whole, longest pieces first and by best fit; of all
    these packings, over all ``steps``, the one with the fewest sequences counts, of equal ones the one that owes more to
    the program. Plain best fit is among the packings, so there are never more sequences than it needs.
    """
    lengths = np.array(sorted(x for x, n in histogram.items() if n > 0), np.int64)
    wanted = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    if not len(lengths):
        return Solution([], 0, 0.0)
    if lengths[0] < 1 or lengths[-1] > capacity:
        raise ValueError("a length lies outside 1 to the capacity")
    best, area = Solution(best_fit(histogram, capacity), 1, 0.0), int(lengths @ wanted)

    def pattern(counts: tuple, times: int) -> Pattern:
        return Pattern(tuple(int(lengths[k]) for k, _ in counts), tuple(n for _, n in counts), times)

    for step in steps:
        left, made = wanted.copy(), {}
        for turn in range(passes):
            live = np.flatnonzero(left)
            if not len(live):
                break
            found, least = fractional(lengths[live], left[live], capacity, step)
            if not turn:
                best = replace(best, bound=max(best.bound, int(np.ceil(least - 1e-6))))
            before = left.copy()
            for counts, share in sorted(found.items(), key=lambda x: -x[1]):
                at, n = live[[k for k, _ in counts]], np.array([n for _, n in counts])
                times = int(min(np.floor(share + 1e-6), (left[at] // n).min()))
                if times > 0:
                    left[at] -= n * times
                    name = tuple(zip(at.tolist(), n.tolist(), strict=True))
                    made[name] = made.get(name, 0) + times
            rest = np.flatnonzero(left)
            longest = longest_first(lengths[rest], left[rest], capacity)
            tails = [[pattern(tuple((int(rest[k]), n) for k, n in counts), times) for counts, times in longest.items()], best_fit({int(lengths[k]): int(left[k]) for k in rest}, capacity)]
            for tail in tails:
                packing = Solution([*[pattern(*x) for x in made.items()], *tail], best.bound, 1 - int(lengths @ left) / area)
                best = min(best, packing, key=lambda x: (x.used, -x.rounded))
            if (left == before).all():
                break
    return best


def solve_in_tasks(spark: SparkSession, histogram: dict[int, int], capacity: int) -> Solution:
    """``solve`` with a task for each step of the weights. A task gets the histogram and returns one packing's patterns."""

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                made = solve(histogram, capacity, STEPS[k : k + 1])
                rows = [(p.lengths, p.counts, p.times) for p in made.patterns]
                yield pa.RecordBatch.from_pydict({"blob": [pickle.dumps((rows, made.bound, made.rounded))]})

    found = spark.range(0, len(STEPS), 1, len(STEPS)).mapInArrow(run, "blob binary").collect()
    made = [pickle.loads(bytes(r["blob"])) for r in found]
    bound = max(b for _, b, _ in made)
    return min((Solution([Pattern(*p) for p in rows], bound, share) for rows, _, share in made), key=lambda x: (x.used, -x.rounded))


def best_fit(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit decreasing on counts: bins of one filling are a group, so equal pieces cost one step."""
    groups: list[list] = []  # spare room, contents, how many
    for length in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        left = histogram[length]
        groups.sort(key=lambda g: g[0])
        made = []
        for group in groups:
            if not left:
                break
            fit = group[0] // length
            if not fit or not group[2]:
                continue
            full = min(group[2], left // fit)
            if full:
                made.append([group[0] - fit * length, [*group[1], (length, fit)], full])
                group[2] -= full
                left -= full * fit
            if left and group[2] and left < fit:
                made.append([group[0] - left * length, [*group[1], (length, left)], 1])
                group[2] -= 1
                left = 0
        fit = capacity // length
        if left // fit:
            made.append([capacity - fit * length, [(length, fit)], left // fit])
        if left % fit:
            made.append([capacity - (left % fit) * length, [(length, left % fit)], 1])
        groups = [g for g in groups if g[2]] + made
    return [Pattern(tuple(x for x, _ in g[1]), tuple(n for _, n in g[1]), g[2]) for g in groups]


def places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length its runs of places: first rank, first sequence, pieces a sequence, offset of the first piece."""
    found: dict[int, list] = {}
    sequence, before = 0, {}
    for p in patterns:
        offset = 0
        for length, count in zip(p.lengths, p.counts, strict=True):
            found.setdefault(length, []).append((before.get(length, 0), sequence, count, offset))
            before[length] = before.get(length, 0) + count * p.times
            offset += length * count
        sequence += p.times
    return {length: np.array(rows, np.int64) for length, rows in found.items()}


def pack(pieces: DataFrame, length: str, ties: list[str], capacity: int = 1024) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (both long): no two overlap, no sequence exceeds the capacity, and
    the pieces of a sequence lie without gaps from 0.

    ``ties`` should tell pieces apart; equal ones are interchangeable, and each repeated row has its own place. Lengths
    outside 1 to the capacity raise ValueError; an empty table gives no rows. The table is sorted with all its columns,
    so keep them narrow.
    """
    new = fields(sequence_id="long", offset="long")
    refuse(pieces, new.fieldNames())
    spark, given, names = pieces.sparkSession, pieces.schema, [f"column_{k}" for k in range(len(pieces.columns))]
    length, ties = names[pieces.columns.index(length)], [names[pieces.columns.index(t)] for t in ties]
    pieces = pieces.toDF(*names)
    order = [F.col(length), *[F.col(t) for t in ties]]
    sorted_ = pieces.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    ranked = checkpoint(sorted_.withColumn("__at", F.monotonically_increasing_id()))
    runs = ranked.groupBy(F.shiftright("__at", 33).alias("__run"), F.col(length).alias("__length")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__length").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = checkpoint(runs.withColumn("__before", before))
    histogram = {int(r[0]): int(r[1]) for r in runs.groupBy("__length").agg(F.sum("__n")).collect()}
    held = spark.sparkContext.broadcast(places(solve_in_tasks(spark, histogram, capacity).patterns))
    rows = ranked.join(F.broadcast(runs), (F.shiftright("__at", 33) == F.col("__run")) & (F.col(length) == F.col("__length")))
    rows = rows.select(*names, (F.col("__before") + F.col("__at") - F.col("__first")).alias("__rank"))

    def run(batches):
        for batch in batches:
            size = batch.column(names.index(length)).to_numpy()
            rank = batch.column(batch.num_columns - 1).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(size):
                at = np.flatnonzero(size == x)
                table = held.value[int(x)]
                row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                inside = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + inside // row[:, 2]
                offset[at] = row[:, 3] + inside % row[:, 2] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*names, *new.fieldNames()])

    return rows.mapInArrow(run, T.StructType([*pieces.schema.fields, *new.fields])).toDF(*given.names, *new.fieldNames())


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = 1024) -> DataFrame:
    """Where each piece of each document lies: key, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenize(docs.select(key, text), text, vocabulary or default_vocabulary(), capacity)
    narrow = checkpoint(pieces.select(key, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))  # encoded once
    return pack(narrow, "length", ["ids_crc32", key, "piece"], capacity)


def op7_config_lp_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
