"""Suffix-array dedup: every byte that a repeated string of 400 bytes covers, from merged shard Burrows-Wheeler transforms.

Only texts that can hold a repeat reach the transforms. The windows of 400 bytes that share their least-hashed substring
of 240 bytes (their anchor) form a run; a run's bytes are its context. Equal windows have equal anchors at equal places, so
1. blocks of documents exchange anchor hashes, and a context whose anchor occurs once holds no repeat;
2. equal contexts are one string with a multiplicity: blocks exchange the hashes of the contexts that are left, and one copy
   of each goes on, marked if there are more;
3. contexts of one anchor meet in a bucket by its hash. Those that one block sends are a shard: its suffixes are sorted and
   give the shard's transform, over symbols of 100 bytes (a context's chains of every 100th position are its strings, so a
   400-byte prefix is four symbols). The shards' transforms are merged by iterative interleave refinement: each round
   sorts the interleave stably by the transform's symbols and carries the boundaries of equal prefixes along, so after
   four rounds the interleave's blocks are the sets of suffixes with a common prefix of 400 bytes. Suffixes are never
   sorted again. Blocks that count two or more, multiplicities included, are the repeated intervals;
4. each block of documents marks its repeated windows, and the bytes they cover go.

An anchor with more than FAMILY different contexts lies in a passage that very many different texts share; all of them in
one task would be an unbounded group, so their windows are counted one by one by their hashes, spread over all buckets.

Symbols and contexts are compared by mixed 64-bit polynomial hashes. The texts are shuffled once; blocks read the same
exchange in all four steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BLOCK, HASHES, Blocks, answers, cut_points, gathered, lookup, per_group, text_column, to_buckets, told
from .common import BYTE_BASE, fields, mix64, pack_sorted, powers, read_table, refuse, slices, text_buffer, unpack_sorted

#: Symbols in a window.
DEPTH = 4


class Rolling:
    """Polynomial hashes of any substrings of some bytes, modulo 2**64."""

    def __init__(self, data: np.ndarray):
        weight = powers(BYTE_BASE, len(data) + 1)
        self.back = powers(pow(BYTE_BASE, -1, 1 << 64), len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * weight[:-1], out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        """The hash of each substring of ``size`` bytes."""
        n = len(self.sums) - size
        return mix64((self.sums[size:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)

    def some(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hashes of substrings of different lengths; the length counts too."""
        return mix64((self.sums[end] - self.sums[start]) * self.back[start] + mix64((end - start).astype(np.uint64)))


#: Minima are found by the upper 40 bits; the lower 24 hold the place, so longer inputs are cut into overlapping pieces.
PLACE_BITS = 24


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value in each run of ``width`` values, the first of equal ones (by their upper 40 bits)."""
    piece = (1 << PLACE_BITS) - width
    if len(values) - width + 1 > piece:
        return np.concatenate([at + window_minima(values[at : at + piece + width - 1], width) for at in range(0, len(values) - width + 1, piece)])
    low = (values >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(values), dtype=np.uint64)
    have = 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    return (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)


def contexts(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first and last window start, hash of the anchor, hash of the run's bytes."""
    core = size * 3 // 5
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(data) < size:
        return empty
    rolling = Rolling(data)
    grams = rolling.every(core)
    anchor = window_minima(grams, size - core + 1)
    whole = np.zeros(len(anchor) + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= size)
    whole[offsets[long]] += 1
    whole[offsets[long + 1] - size + 1] -= 1
    whole = np.cumsum(whole[:-1]) > 0
    first = whole.copy()
    first[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1])
    last = whole.copy()
    last[:-1] &= ~whole[1:] | (anchor[1:] != anchor[:-1])
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    return lo, hi, mix64(grams[anchor[lo]]), rolling.some(lo, hi + size)  # minima crowd at the low end; mixed, they spread


def sort_suffixes(symbols: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Rows by the symbols that follow from each (``after``: the next row, or the number of rows for the chain's end).

    Doubling: after round r rows are ranked by 2**r symbols; equal ones keep their place.
    """
    n = len(symbols)
    rank, ahead = np.append(np.unique(symbols, return_inverse=True)[1] + 1, 0), np.append(after, n)
    for _ in range(DEPTH.bit_length()):
        pair = rank[:n] * (n + 2) + rank[ahead[:n]]
        order = np.argsort(pair)  # ties are one rank, whatever their order
        rank[order] = np.cumsum(np.append(1, pair[order][1:] != pair[order][:-1]))
        ahead = ahead[ahead]
    return stable_order(rank[:n])


def stable_order(values: np.ndarray) -> np.ndarray:
    """Stable order of integers from 0 to 2**31: a plain sort of value and place in one number."""
    return (np.sort((values.astype(np.uint64) << np.uint64(32)) | np.arange(len(values), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def shard_transform(symbols: np.ndarray, after: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of one shard and its transform. Rows n, n+1, ... are the empty suffixes, one a chain, in the order of
    the chains' last rows; they sort first. A transform symbol is that of the row before (-1: the chain starts here)."""
    n = len(symbols)
    ends = np.flatnonzero(after == n)
    order = sort_suffixes(symbols, after)
    preceding = np.where(before < 0, -1, symbols[np.maximum(before, 0)])
    return np.concatenate([n + np.arange(len(ends)), order]), np.concatenate([symbols[ends], preceding[order]])


def merge_transforms(transforms: list[np.ndarray], chains: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' sorted suffixes (a shard number for each merged row) and each row's block number; rows of
    one block agree in ``depth`` symbols (or end alike before)."""
    kind = np.uint16 if len(transforms) < 1 << 16 else np.int64
    merged = np.repeat(np.arange(len(transforms), dtype=kind), [len(t) for t in transforms])
    joined = np.concatenate(transforms).astype(np.int32)
    heads = np.repeat(np.arange(len(transforms), dtype=kind), chains)
    block, symbol = np.zeros(len(merged), np.int32), np.empty(len(merged), np.int32)
    for _ in range(depth):
        symbol[np.argsort(merged, kind="stable")] = joined  # each shard's rows keep their order
        inner = np.flatnonzero(symbol >= 0)
        key = np.sort((symbol[inner].astype(np.uint64) << np.uint64(32)) | inner.astype(np.uint64))  # stable: the place is in it
        order, sorted_ = (key & np.uint64(0xFFFFFFFF)).astype(np.int64), key >> np.uint64(32)
        before = block[order]
        new = np.ones(len(order), np.int32)
        new[1:] = (sorted_[1:] != sorted_[:-1]) | (before[1:] != before[:-1])
        block = np.concatenate([np.zeros(len(heads), np.int32), np.cumsum(new, dtype=np.int32)])
        merged = np.concatenate([heads, merged[order]])
    return merged, block


def repeated_windows(shards: list[tuple[np.ndarray, np.ndarray]], size: int, times: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """For each shard (bytes, offsets of its strings): which bytes start a string of ``size`` bytes that starts elsewhere
    in one of the shards too. ``times``: how often each string of a shard stands for (once, if not given)."""
    step = size // DEPTH
    hashes, layout = [], []
    for data, offsets in shards:
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        place = np.flatnonzero(np.arange(len(data)) + step <= offsets[row + 1])
        hashes.append(Rolling(data).every(step)[place])
        number = np.full(len(data) + step, -1)
        number[place] = np.arange(len(place))
        after = number[place + step]
        after[(after >= 0) & (row[np.minimum(place + step, len(data) - 1)] != row[place])] = -1
        before = np.full(len(place), -1)
        before[after[after >= 0]] = np.flatnonzero(after >= 0)
        layout.append((place, row, np.where(after < 0, len(place), after), before))
    _, codes = np.unique(np.concatenate(hashes), return_inverse=True)
    codes = np.split(codes.astype(np.int32), np.cumsum([len(h) for h in hashes])[:-1])
    made = [shard_transform(code, after, before) for code, (_, _, after, before) in zip(codes, layout, strict=True)]
    chains = [int((after == len(place)).sum()) for place, _, after, _ in layout]
    merged, block = merge_transforms([t for _, t in made], chains, DEPTH)
    order = np.argsort(merged, kind="stable")
    out, at = [], 0
    weight = np.ones(len(merged), np.int64)
    for (rows, _), (place, row, _, _), own in zip(made, layout, times or [], strict=False):
        inner = np.flatnonzero(rows < len(place))
        weight[order[at + inner]] = own[row[place[rows[inner]]]]
        at += len(rows)
    at = 0
    common = np.bincount(block, weights=weight)[block] > 1
    for (rows, _), (place, row, _, _), (data, offsets) in zip(made, layout, shards, strict=True):
        hit = common[order[at : at + len(rows)]]
        at += len(rows)
        start = place[rows[hit & (rows < len(place))]]
        mark = np.zeros(len(data), bool)
        mark[start[start + size <= offsets[row[start] + 1]]] = True
        out.append(mark)
    return out


MARKS = "kind int, bucket int, block int, hashes binary, extra binary, texts binary"
ANSWER = "block int, hashes binary, extra binary"
VERDICT = "kind int, " + ANSWER
#: Kinds of rows: contexts that a block has and others too, asked for as a whole; contexts as texts, answered by a bit for
#: each window; contexts whose windows are counted one by one; hashes of such windows; such contexts that occur again.
WHOLE, TEXTS, SPLIT, WINDOWS, AGAIN = range(5)
#: Most different contexts of one anchor whose transforms are merged: two megabytes of text.
FAMILY = 4096
#: What a block is told of a context: others have it; this block sends it; with multiplicity; its windows are counted; they
#: count twice; it occurs again among those that are counted.
ASK, SEND, HEAVY, COUNT, TWICE, KNOWN = (1 << k for k in range(6))
SPANS = {"n_bytes": "long", "n_removed": "long", "removed": T.ArrayType(fields(start="long", length="long")), "kept": "binary"}


def suffix_dedup(df: DataFrame, key: str, text: str, size: int = 400, whole_characters: bool = False) -> DataFrame:
    """``df`` with ``n_bytes``, ``n_removed``, ``removed`` (maximal removed runs of bytes) and ``kept`` (binary).

    A byte goes if a string of ``size`` bytes that covers it also starts anywhere else, in the same text or another.
    Matches lie inside one text; all copies go, the first too; strings are judged on the input. A null text counts as
    empty; texts of fewer bytes lose nothing. ``size`` is a multiple of 4. ``key`` only deals rows to blocks: it may be
    null or repeated. ``whole_characters``: a character of several bytes goes only if all of them do, so that what is kept
    is valid UTF-8. An empty table gives no rows. Columns of the new names raise ValueError; others may have any name.
    """
    refuse(df, SPANS)
    if size % DEPTH or size < 2 * DEPTH:
        raise ValueError("the size must be a multiple of 4, and 8 at least")
    given, names = df.schema, [f"column_{k}" for k in range(len(df.columns))]
    key, text, df = names[given.names.index(key)], names[given.names.index(text)], df.toDF(*names)
    blocks = Blocks(df, text, key)
    few, buckets = blocks.buckets(0.05), max(blocks.buckets(0.05), blocks.size // (2 << 20))  # for hashes; for texts
    width = (size - size * 3 // 5 + 8) // 8

    def runs(table: pa.Table):
        data, offsets = text_buffer(table.column(text))
        for a, b in slices(offsets, 500_000):
            yield (a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], *contexts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size))

    def number(table: pa.Table) -> int:
        return table.column(BLOCK)[0].as_py()

    def emit_anchors(table: pa.Table) -> pa.Table:
        return to_buckets(number(table), np.unique(np.concatenate([x[6] for x in runs(table)])), few)

    def meet_anchors(table: pa.Table) -> pa.Table:
        hashes, block, _, _ = gathered(table)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        return answers(block[order[twice]], hashes[order[twice]])

    def emit_contexts(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return to_buckets(0, np.zeros(0, np.uint64), 1, contexts=np.zeros(0, np.uint64), times=np.zeros(0, np.uint8))
        known, _ = told(answer)
        found = [x[6:] for x in runs(table)]
        anchor, context = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        order = np.lexsort((context, anchor))
        anchor, context = anchor[order], context[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = anchor[1:] != anchor[:-1]
        group = np.cumsum(fresh) - 1
        use = lookup(anchor, known)[0] | (np.bincount(group, minlength=1)[group] > 1) if len(anchor) else fresh
        anchor, context = anchor[use], context[use]
        fresh = np.ones(len(anchor), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])
        at = np.flatnonzero(fresh)
        times = np.minimum(np.diff(np.append(at, len(anchor))), 2).astype(np.uint8)
        return to_buckets(number(table), anchor[at], few, contexts=context[at], times=times)

    def meet_contexts(table: pa.Table) -> pa.Table:
        anchor, block, order, _ = gathered(table)
        read = lambda name, kind: np.concatenate([np.frombuffer(table.column(name)[i].as_buffer(), kind) for i in order])
        context, times = read("contexts", np.uint64), read("times", np.uint8)
        order = np.lexsort((block, context, anchor))
        anchor, block, context, times = anchor[order], block[order], context[order], times[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])
        group = np.cumsum(fresh) - 1
        sure = np.bincount(group, weights=times)[group] > 1
        first = np.ones(len(order), bool)
        first[1:] = anchor[1:] != anchor[:-1]
        family = np.cumsum(first) - 1
        many = np.bincount(family, weights=fresh)[family]
        split = many > FAMILY
        merge = ~split & ((many > 1) | sure)
        flag = ASK * (merge & sure) + SEND * (merge & fresh) + HEAVY * (merge & fresh & sure)
        flag = (flag + COUNT * (split & ~sure) + TWICE * (split & sure & fresh) + KNOWN * (split & sure)).astype(np.uint8)
        use = flag > 0
        return answers(block[use], context[use], flag[use])

    def emit_marks(table: pa.Table, answer: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if table.num_rows and answer.num_rows:
            own = number(table)
            known, flag = told(answer, np.uint8)
            for kind, bit in ((SPLIT, COUNT), (AGAIN, KNOWN)):
                out.append((kind, own % buckets, own, pack_sorted(np.unique(known[(flag & bit) > 0])), None, None))
            ask, send, heavy, one, two = (known[(flag & bit) > 0] for bit in (ASK, SEND, HEAVY, COUNT, TWICE))
            picked: dict[int, tuple[int, bytes]] = {}
            windows, twice, seen, asked = [], [], set(), [np.zeros((2, 0), np.uint64)]
            for _, _, part, _, lo, hi, anchor, context in runs(table):
                for i in np.flatnonzero(lookup(context, send)[0]).tolist():
                    if int(context[i]) not in picked:
                        picked[int(context[i])] = (int(anchor[i]), part[lo[i] : hi[i] + size].tobytes())
                also = lookup(context, ask)[0]
                asked.append(np.stack([anchor[also], context[also]]))
                counted, doubled = lookup(context, one)[0], lookup(context, two)[0]
                for i in np.flatnonzero(doubled).tolist():  # one copy speaks for all
                    doubled[i] = int(context[i]) not in seen
                    seen.add(int(context[i]))
                if counted.any() or doubled.any():
                    every = Rolling(part).every(size)
                    windows.append(every[_ranges(lo[counted], hi[counted])])
                    twice.append(every[_ranges(lo[doubled], hi[doubled])])
            rows = sorted((a, c, t) for c, (a, t) in picked.items())
            cut = cut_points(np.array([r[0] for r in rows], np.uint64), buckets)
            for b in np.flatnonzero(np.diff(cut)).tolist():
                mine = rows[cut[b] : cut[b + 1]]
                names = np.array([r[1] for r in mine], np.uint64)
                sizes = np.array([len(r[2]) for r in mine], np.int64) * 2 + lookup(names, heavy)[0]
                out.append((TEXTS, b, own, names.tobytes(), sizes.tobytes(), b"".join(r[2] for r in mine)))
            anchor, context = np.concatenate(asked, axis=1)
            order = np.lexsort((context, anchor))
            anchor, context = anchor[order], context[order]
            cut = cut_points(anchor, buckets)
            out += [(WHOLE, b, own, pack_sorted(np.unique(context[cut[b] : cut[b + 1]])), None, None) for b in np.flatnonzero(np.diff(cut)).tolist()]
            if windows:
                hashes, times = np.concatenate(windows + twice), np.repeat([1, 2], [sum(map(len, windows)), sum(map(len, twice))])
                hashes, group = np.unique(hashes, return_inverse=True)
                times = np.minimum(np.bincount(group, weights=times), 2).astype(np.uint8)
                cut = cut_points(hashes, buckets)
                out += [(WINDOWS, b, own, pack_sorted(hashes[cut[b] : cut[b + 1]]), times[cut[b] : cut[b + 1]].tobytes(), None) for b in np.flatnonzero(np.diff(cut)).tolist()]
        kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 3]
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["kind", "bucket", "block", "hashes", "extra", "texts"])

    def meet_marks(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["block"], r["kind"]))
        out = [(r["kind"], r["block"], r["hashes"], None) for r in rows if r["kind"] in (SPLIT, AGAIN)]
        counted = [r for r in rows if r["kind"] == WINDOWS]
        if counted:
            parts = [unpack_sorted(r["hashes"]) for r in counted]
            hashes, group = np.unique(np.concatenate(parts), return_inverse=True)
            repeated = np.bincount(group, weights=np.concatenate([np.frombuffer(r["extra"], np.uint8) for r in counted])) > 1
            at = 0
            for r, part in zip(counted, parts, strict=True):
                out.append((WINDOWS, r["block"], pack_sorted(part[repeated[group[at : at + len(part)]]]), None))
                at += len(part)
        texts = [r for r in rows if r["kind"] == TEXTS]
        sizes = [np.frombuffer(r["extra"], np.int64) for r in texts]
        shards = [(np.frombuffer(r["texts"], np.uint8), np.concatenate([[0], np.cumsum(n >> 1)])) for r, n in zip(texts, sizes, strict=True)]
        marks, found = repeated_windows(shards, size, [1 + (n & 1) for n in sizes]) if shards else [], [np.zeros(0, np.uint64)]
        for r, mark, (_, offsets), n in zip(texts, marks, shards, sizes, strict=True):
            hashes = np.frombuffer(r["hashes"], np.uint64)
            total = np.concatenate([[0], np.cumsum(mark)])
            found.append(hashes[total[offsets[1:]] - total[offsets[:-1]] == (n >> 1) - size + 1])  # repeated from end to end
            bits = np.zeros((len(hashes), 8 * width), bool)
            row = np.repeat(np.arange(len(hashes)), np.diff(offsets))
            hit = np.flatnonzero(mark)
            bits[row[hit], hit - offsets[row[hit]]] = True
            order = np.argsort(hashes)
            order = order[n[order] & 1 == 0]  # a block asks for the others
            out.append((TEXTS, r["block"], pack_sorted(hashes[order]), np.packbits(bits[order], axis=1).tobytes()))
        whole = np.sort(np.concatenate(found))
        for r in rows:
            if r["kind"] == WHOLE:
                asked = unpack_sorted(r["hashes"])
                out.append((WHOLE, r["block"], pack_sorted(asked[lookup(asked, whole)[0]]), None))
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["kind", "block", "hashes", "extra"])

    def finish(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([*[table.column(c) for c in names], *[pa.array([], k) for k in (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.binary())]], names=[*names, *SPANS])
        said: dict[int, list] = {kind: [np.zeros(0, np.uint64)] for kind in range(5)}
        bits = [np.zeros((0, width), np.uint8)]
        for i, kind in enumerate(answer.column("kind").to_pylist()):
            said[kind].append(unpack_sorted(answer.column("hashes")[i].as_buffer()))
            if kind == TEXTS:
                bits.append(np.frombuffer(answer.column("extra")[i].as_buffer(), np.uint8).reshape(-1, width))
        whole = np.sort(np.concatenate(said[WHOLE] + said[AGAIN]))
        split, counted = (np.sort(np.concatenate(said[kind])) for kind in (SPLIT, WINDOWS))
        partial, bits = np.concatenate(said[TEXTS]), np.concatenate(bits)
        order = np.argsort(partial)
        partial, bits = partial[order], bits[order]
        n_bytes, n_removed, spans, kept = [], [], [], []
        for a, b, part, local, lo, hi, _, context in runs(table):
            cover = np.zeros(len(part) + 1, np.int64)
            sure, _ = lookup(context, whole)
            np.add.at(cover, lo[sure], 1)
            np.add.at(cover, hi[sure] + size, -1)
            some, at = lookup(context, partial)
            some &= ~sure
            picked = np.unpackbits(bits[at[some]], axis=1)
            row, step = np.nonzero(picked)
            start = lo[some][row] + step
            single, _ = lookup(context, split)
            if single.any():
                at = _ranges(lo[single], hi[single])
                start = np.concatenate([start, at[lookup(Rolling(part).every(size)[at], counted)[0]]])
            np.add.at(cover, start, 1)
            np.add.at(cover, start + size, -1)
            gone = np.cumsum(cover[:-1]) > 0
            if whole_characters and len(part):
                head = np.flatnonzero((part & 0xC0) != 0x80)
                gone = np.repeat(np.logical_and.reduceat(gone, head), np.diff(np.append(head, len(part))))
            total = np.concatenate([[0], np.cumsum(gone)])
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            heads = local[:-1][local[:-1] < local[1:]]
            begin[heads] = gone[heads]
            begin = np.flatnonzero(begin)
            row = np.searchsorted(local, begin, "right") - 1
            free = np.append(np.flatnonzero(~gone), len(gone))
            stop = np.minimum(free[np.searchsorted(free, begin)], local[row + 1])
            cut = np.searchsorted(row, np.arange(b - a + 1))
            structs = pa.StructArray.from_arrays([pa.array(begin - local[row], pa.int64()), pa.array(stop - begin, pa.int64())], names=["start", "length"])
            spans.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), structs))
            lost = np.diff(total[local])
            n_bytes.append(np.diff(local))
            n_removed.append(lost)
            kept.append((part[~gone], np.diff(local) - lost))
        made = [pa.array(np.concatenate(n_bytes), pa.int64()), pa.array(np.concatenate(n_removed), pa.int64()), pa.chunked_array(spans), text_column(kept, pa.binary())]
        return pa.table([*[table.column(c) for c in names], *made], names=[*names, *SPANS])

    known = per_group(blocks.emit(emit_anchors, HASHES), "bucket", meet_anchors, ANSWER, few)
    flags = per_group(blocks.answer(known, emit_contexts, HASHES + ", contexts binary, times binary"), "bucket", meet_contexts, ANSWER, few)
    marks = per_group(blocks.answer(flags, emit_marks, MARKS), "bucket", meet_marks, VERDICT, buckets)
    return blocks.answer(marks, finish, T.StructType([*df.schema.fields, *fields(**SPANS).fields])).toDF(*given.names, *SPANS)


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All integers from each first to its last."""
    size = last - first + 1
    return np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(first) else first


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 400 bytes that occur more than once."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup(docs, "doc_id", "text")
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same in SQL: bytes as hexadecimal text, windows by their MD5.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS MATERIALIZED (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)),
x AS (SELECT doc_id, i FROM s SEMI JOIN (SELECT k FROM s GROUP BY k HAVING count(*) > 1) m USING (k)),
y AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM x),
z AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM y),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM z GROUP BY doc_id, run),
p AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS lo, a AS hi FROM r
      UNION ALL SELECT d.doc_id, coalesce(max(r.b), 0), any_value(d.n) FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id),
k AS (SELECT p.doc_id, string_agg(substr(d.h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS kept FROM p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, (d.n - length(k.kept) / 2)::BIGINT AS n_removed, coalesce(c.n_spans, 0) AS n_spans, sha256(unhex(k.kept)) AS kept_sha256
FROM d JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n_spans FROM r GROUP BY doc_id) c USING (doc_id)
"""
