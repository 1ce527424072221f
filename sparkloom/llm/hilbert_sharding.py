"""Hilbert-curve ordering: rows near each other in several metadata columns go to the same file.

Each column is quantised to 2**bits cells, numbers evenly between the least and greatest value and texts evenly by
their rank among the distinct values. The cells are turned into an index on a Hilbert curve, the rows are sorted by it
and cut into runs. A reader that filters on any of the columns then skips most shards by their minimum and maximum.
All of it is DataFrame and SQL functions.

Shuffles: one range exchange of the key columns (never of the text), and one of each text column's distinct values. The
sort key ends in columns that tell rows apart, so a value shared by a third of all rows is cut like any other run. Ranks
come from each range partition's row count: one row for each partition, which is broadcast. The cells of a text column's
values are broadcast too if they are few.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, read_table, refuse, shuffle_partitions, small_side


@dataclass(frozen=True)
class Dimension:
    """A metadata column. ``log`` spreads sizes by their logarithm; text counts by the rank of its whole value."""

    column: str
    log: bool = False


def hilbert_table(dims: int) -> list[int]:
    """The curve as an automaton: entry [state * 2**dims + cell bits] holds next state * 2**dims + index digits.

    A state is the sub-cube's entry corner and main direction (state = corner * dims + direction).
    """
    size = 1 << dims

    def turn(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & (size - 1)

    def ones(x: int) -> int:
        return (~x & (x + 1)).bit_length() - 1

    def rank(gray: int) -> int:
        out = 0
        while gray:
            out ^= gray
            gray >>= 1
        return out

    out = []
    for state in range(size * dims):
        corner, way = divmod(state, dims)
        for cell in range(size):
            digit = rank(turn(cell ^ corner, dims - (way + 1) % dims))
            low = max(0, 2 * ((digit - 1) // 2)) if digit else 0
            corner2 = corner ^ turn(low ^ (low >> 1), way + 1)
            along = 0 if digit == 0 else ones(digit - 1) if digit % 2 == 0 else ones(digit)
            way2 = (way + along % dims + 1) % dims
            out.append((corner2 * dims + way2) * size + digit)
    return out


def hilbert_index(cells: Sequence[Column], bits: int) -> Column:
    """Index on the Hilbert curve of integer cell numbers below 2**bits, as a long."""
    dims = len(cells)
    if dims < 2 or dims * bits > 62:
        raise ValueError("needs two dimensions or more, and an index of 62 bits at most")
    table = F.array(*[F.lit(x) for x in hilbert_table(dims)])
    shift = lambda x, by: F.call_function("shiftright", x, by)

    def step(state: Column, bit: Column) -> Column:
        corner = F.lit(0)
        for k, cell in enumerate(cells):
            corner = corner + shift(cell, bit).bitwiseAND(F.lit(1)) * F.lit(1 << k)
        entry = F.get(table, state["s"] * F.lit(1 << dims) + corner)
        digit = entry.bitwiseAND(F.lit((1 << dims) - 1)).cast("long")
        return F.struct((state["h"] * F.lit(1 << dims) + digit).alias("h"), F.shiftright(entry, dims).alias("s"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["h"]


def _number(dim: Dimension) -> Column:
    """A numeric column as a double; null becomes null."""
    value = F.col(dim.column).cast("double")
    value = F.when(~F.isnan(value), value)
    return F.log2(F.greatest(value, F.lit(0.0)) + 1) if dim.log else value


def _ranked(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` checkpointed in a global order, with ``__rank`` (gapless from 0) and ``__all``, the number of rows."""
    cut = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    cut = checkpoint(cut.withColumn("__at", F.monotonically_increasing_id()))  # partition number * 2**33 + row
    parts = cut.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count("*").alias("__rows"))
    before = F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = parts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"), whole.alias("__all"))  # a row a partition
    rank = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return cut.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(parts), "__part").withColumn("__rank", rank)


def _text_cells(df: DataFrame, placed: DataFrame, column: str, cell: str, bits: int) -> DataFrame:
    """``placed`` (the rows of ``df``) with the cell of a text column: its values' ranks, cut into 2**bits even runs.
    Up to 2**bits values have a cell each."""
    values = _ranked(df.where(F.col(column).isNotNull()).select(F.col(column).alias("__value")).distinct(), [F.col("__value")])
    values = values.select("__value", F.expr(f"cast((__rank * {1 << bits}) div __all as int)").alias(cell))
    return placed.join(small_side(values, values.count()), F.col(column) == F.col("__value"), "left").drop("__value")


def hilbert_shards(df: DataFrame, dims: Sequence[Dimension], shards: int, ties: Sequence[str], bits: int = 8) -> DataFrame:
    """``df`` with ``curve`` (long), ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard).

    Shards are runs in the order of (curve, ties, nulls first); their row counts differ by one at most. ``ties`` should
    tell rows apart; rows equal in all of them are interchangeable. A null metadata value lies in cell 0, as does a
    column with a single value. Pass the columns to keep only: all of ``df`` is sorted, so leave texts out.
    An empty table gives no rows. Columns of these three names in ``df`` raise ValueError; others may have any name.
    """
    new = ["curve", "shard", "slot"]
    refuse(df, new)
    if shards < 1:
        raise ValueError("shards must be positive")
    given, names = df.columns, [f"column_{k}" for k in range(len(df.columns))]
    at = dict(zip(given, names, strict=True))
    df, dims, ties = df.toDF(*names), [replace(d, column=at[d.column]) for d in dims], [at[t] for t in ties]
    texts = [dict(df.dtypes)[d.column] in ("string", "binary") for d in dims]
    numbers = [k for k, text in enumerate(texts) if not text]
    ends = df.agg(F.count("*"), *[f(_number(dims[k])).alias(f"{n}{k}") for k in numbers for n, f in (("lo", F.min), ("hi", F.max))]).first()
    placed = df
    for k, dim in enumerate(dims):
        if texts[k]:
            placed = _text_cells(df, placed, dim.column, f"__c{k}", bits)
            continue
        low, high = ends[f"lo{k}"], ends[f"hi{k}"]
        wide = (high - low) if low is not None and high > low else None
        scaled = F.floor((_number(dim) - F.lit(low)) * F.lit((1 << bits) / wide)) if wide else F.lit(0)
        placed = placed.withColumn(f"__c{k}", F.least(scaled, F.lit((1 << bits) - 1)).cast("int"))
    named = [F.coalesce(f"__c{k}", F.lit(0)) for k in range(len(dims))]
    placed = placed.withColumn("curve", hilbert_index(named, bits)).drop(*[f"__c{k}" for k in range(len(dims))])
    out = _ranked(placed, [F.col("curve"), *[F.col(t) for t in ties]])
    out = out.withColumn("shard", F.expr(f"cast((__rank * {shards}) div __all as int)"))
    out = out.withColumn("slot", F.expr(f"__rank - (shard * __all + {shards - 1}) div {shards}"))
    return out.select(*names, *new).toDF(*given, *new)


def write_shards(df: DataFrame, assigned: DataFrame, key: str, path: str) -> None:
    """Write the rows of ``df`` with a ``shard=`` folder each, in slot order; ``assigned`` has key, shard and slot."""
    rows = df.join(assigned.select(key, "shard", "slot"), key)
    rows.repartitionByRange(shuffle_partitions(df.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


#: Production parameters of the query: metadata columns of ``documents``.
DOCUMENT_DIMENSIONS = (Dimension("source"), Dimension("lang"), Dimension("n_chars", log=True))
SHARDS = 40


def op2_hilbert_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law `rows`."""
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", "lang", "n_chars", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = hilbert_shards(rows, DOCUMENT_DIMENSIONS, SHARDS, ["text_crc32", "size", "doc_id", "source", "lang", "n_chars"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def _cell_sql(column: str) -> str:
    return f"(SELECT {column} AS v, ((row_number() OVER (ORDER BY {column}) - 1) * 256 // count(*) OVER ())::INTEGER AS cell FROM (SELECT DISTINCT {column} FROM documents WHERE {column} IS NOT NULL))"


#: The same in SQL: checksums by the byte table of the reflected polynomial, the curve by the automaton, one step a bit.
OP2_SQL = f"""
WITH RECURSIVE p AS (SELECT i AS n, i::BIGINT AS v, 0 AS step FROM range(256) r(i)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM p WHERE step < 8),
c AS MATERIALIZED (SELECT list(v ORDER BY n) AS crc_table, {hilbert_table(3)} AS curve_table FROM p WHERE step = 8),
e AS (SELECT min(ln(greatest(n_chars, 0) + 1) / ln(2)) AS low, max(ln(greatest(n_chars, 0) + 1) / ln(2)) AS high FROM documents),
d AS MATERIALIZED (SELECT doc_id, source, lang, n_chars, (octet_length(encode(coalesce(text, ''))) + 16)::BIGINT AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes,
  coalesce(s.cell, 0) AS a, coalesce(l.cell, 0) AS b,
  CASE WHEN n_chars IS NULL OR high <= low THEN 0 ELSE least(floor((ln(greatest(n_chars, 0) + 1) / ln(2) - low) * (256 / (high - low))), 255)::INTEGER END AS c
  FROM documents LEFT JOIN {_cell_sql("source")} s ON source = s.v LEFT JOIN {_cell_sql("lang")} l ON lang = l.v, e),
h AS (SELECT doc_id, source, lang, n_chars, size,
  xor(list_reduce(bytes, lambda crc, byte: xor(crc >> 8, crc_table[(xor(crc, byte) & 255) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32,
  list_reduce([7, 6, 5, 4, 3, 2, 1, 0]::BIGINT[], lambda now, bit: (now // 24 * 8 + (curve_table[now % 24 * 8 + ((a >> bit) & 1) + 2 * ((b >> bit) & 1) + 4 * ((c >> bit) & 1) + 1] & 7)) * 24
    + (curve_table[now % 24 * 8 + ((a >> bit) & 1) + 2 * ((b >> bit) & 1) + 4 * ((c >> bit) & 1) + 1] >> 3), 0::BIGINT) // 24 AS curve FROM d, c),
r AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, size, doc_id NULLS FIRST, source NULLS FIRST, lang NULLS FIRST, n_chars NULLS FIRST) - 1 AS place, count(*) OVER () AS whole FROM h)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * {SHARDS} // whole)::INTEGER AS shard, place - (place * {SHARDS} // whole * whole + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INTEGER AS grown_shard, curve FROM r
"""
