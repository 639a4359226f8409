"""Sets of hashes, their rarity order and what the exact joins of ``signature_trees`` and ``line_join`` share.

A set holds 63-bit hashes of its elements; equal sets have equal keys (a 64-bit digest) and are one set from then on. Two sets with a Jaccard similarity of
``num / den`` or more share an element among their first ``n - ceil(n * num / den) + 1`` in any common order; the order here is rare elements first.

``describe`` reads the texts once: it gives the sets of each row, and counts of elements by slots (the upper half of the hash). A task counts ``HELD_ELEMENTS`` elements
at a time and passes on the slots it saw twice or more (lossy counting: a slot that is in no summary occurs at most once in each such stretch of text). ``rarity_order`` sums
them and keeps the ``ORDER_SLOTS`` most frequent; all others are rare and ordered by value. Which slots it keeps never changes a result, only how often two sets meet.
``classes`` turns links into classes by large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.llm import textkit as tk
from earlywarn.llm.storage import materialize

#: Slots that the order knows (bounds what is broadcast: 8 bytes each), the size of its lookup table, and the least count of a slot it holds.
ORDER_SLOTS = 1 << 20
LOOKUP_BITS = 22
FREQUENT = 4
#: Elements a task holds before it passes their counts on.
HELD_ELEMENTS = 2_000_000
HELD_POSTINGS = 1 << 18
#: Postings of one range (one task).
RANGE_POSTINGS = 600_000

#: Rows of sets: gets a batch, yields (index of batch row per set, part number per set, sorted distinct values, values per set).
Extract = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]


def _by_row(row: np.ndarray, place: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """The order by row, then place (of 44 bits), then value."""
    if rows < 1 << 20:
        packed = (row.astype(np.uint64) << np.uint64(44)) | place
        order = np.argsort(packed)
        p, v = packed[order], value[order]
        if not ((p[1:] == p[:-1]) & (v[1:] != v[:-1])).any():
            return order
    return np.lexsort((value, place, row))


def distinct_sorted(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values (of 63 bits) within rows, and their number per row."""
    order = _by_row(row, value >> np.uint64(19), value, rows)
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(row[new], minlength=rows)


def shingle_sets(k: int = 5, column: int = 0) -> Extract:
    """A set for each text: its distinct k-word shingles."""

    def run(batch: pa.RecordBatch):
        for lo, hi, buf, off in tk.chunks(batch.column(column)):
            w = tk.words(buf, off)
            s, count = tk.shingles(tk.word_hashes(w), w.per_row, k)
            values, n = distinct_sorted(np.repeat(np.arange(hi - lo), count), s >> np.uint64(1), hi - lo)
            yield np.arange(lo, hi), np.zeros(hi - lo, np.int64), values, n

    return run


def line_sets(least: int = 1, column: int = 0) -> Extract:
    """A set for each line of at least ``least`` distinct words: these words. The part number is that of the line in its text."""

    def run(batch: pa.RecordBatch):
        for lo, _, buf, off in tk.chunks(batch.column(column)):
            w = tk.words(buf, off, breaks=10)
            text = np.searchsorted(off, w.off[:-1], side="right") - 1 if len(w.off) > 1 else np.zeros(0, np.int64)
            # texts that are empty share their offset with the next one; the last of equal offsets owns the bytes
            part = np.arange(len(text)) - np.searchsorted(text, text, side="left")
            long = w.per_row >= max(1, least)
            keep = np.flatnonzero(long[w.row])
            new_row = np.cumsum(long) - 1
            values, n = distinct_sorted(new_row[w.row[keep]], tk.word_hashes(w)[keep] >> np.uint64(1), int(long.sum()))
            rows = np.flatnonzero(long)
            enough = n >= least
            values = values[np.repeat(enough, n)]
            yield text[rows][enough] + lo, part[rows][enough], values, n[enough]

    return run


def digest(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; 0 for the empty set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(values + np.uint64(0x9E3779B97F4A7C15)))])
    ends = np.cumsum(n)
    return np.where(n > 0, tk.mix(total[ends] - total[ends - n] + n.astype(np.uint64) * np.uint64(tk.BASE)), 0).astype(np.uint64).view(np.int64)


def signatures(values: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of ``width`` bits for each set, as words of 64 bits: one bit per element."""
    bits = np.zeros((len(n), width), bool)
    bits[np.repeat(np.arange(len(n)), n), (values % np.uint64(width)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def parities(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each set (none is empty) whether it has an odd number of elements at each of 64 places, and at the upper half of 128 places; the lower half is where the two differ.
    An element of both sets of a pair changes both alike, so each place that differs is an element, at least, that only one of them has."""
    bit = np.uint64(1) << (values & np.uint64(63))
    starts = np.cumsum(n) - n
    upper = np.where(values & np.uint64(64), bit, np.uint64(0))
    return np.column_stack([np.bitwise_xor.reduceat(bit, starts), np.bitwise_xor.reduceat(upper, starts)])


def offsets(size: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given sizes."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def blobs(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The values of all packed rows, one after another."""
    parts = [np.frombuffer(x.as_py(), kind) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def deal(part: np.ndarray, ranges: int, columns: dict[str, np.ndarray], packs: dict[str, Callable] | None = None) -> pa.RecordBatch:
    """One row for each range that occurs in ``part``, with its entries of every column packed, by ``packs`` where it names the column."""
    packs = packs or {}
    by = np.argsort(part.astype(np.uint16 if ranges <= 1 << 16 else np.int32), kind="stable")
    cut = np.searchsorted(part[by], np.arange(ranges + 1))
    rows = np.flatnonzero(np.diff(cut))
    same = lambda c: c
    packed = {name: [packs.get(name, same)(c[by[cut[r] : cut[r + 1]]]).tobytes() for r in rows] for name, c in columns.items()}
    return pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *(pa.array(p, pa.binary()) for p in packed.values())], names=["range", *packed])


DESCRIBED = "row long, part int, n int, key long, sig binary, wide binary, range int, slots binary, counts binary"


def describe(rows: DataFrame, extract: Extract, bits: int = 0) -> DataFrame:
    """The sets of a table (text, id long) and rows with counts of slots only (``key`` is null), written once. With ``bits``, each set has a bitmap of so many bits,
    and one of two bits or more per element where that is wider."""
    ranges = max(8, rows.rdd.getNumPartitions())
    names = [c.split()[0] for c in DESCRIBED.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]

    def filled(given: dict[str, pa.Array]) -> pa.RecordBatch:
        size = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([given[k] if k in given else pa.nulls(size, t) for k, t in zip(names, kinds, strict=True)], names=names)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        slots, counts = np.unique(np.concatenate(held), return_counts=True)
        slots, counts = slots[counts > 1], counts[counts > 1]
        dealt = deal((slots.astype(np.uint64) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64), ranges, {"slots": slots, "counts": counts.astype(np.uint32)})
        return filled(dict(zip(dealt.schema.names, dealt.columns, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for batch in batches:
            for at, part, values, n in extract(batch):
                held.append((values >> np.uint64(31)).astype(np.uint32))
                n_held += len(values)
                given = {"row": batch.column(1).take(pa.array(at)), "part": pa.array(part.astype(np.int32)), "n": pa.array(n.astype(np.int32)), "key": pa.array(digest(values, n))}
                if bits:
                    given["sig"], given["wide"] = _bitmaps(values, n, np.full(len(n), bits)), _bitmaps(values, n, wide_bits(n, bits))
                yield filled(given)
                if n_held > HELD_ELEMENTS:
                    yield counted(held)
                    held, n_held = [], 0
        if n_held:
            yield counted(held)

    return materialize(rows.select("text", "id").mapInArrow(run, DESCRIBED))


def wide_bits(n: np.ndarray, least: int) -> np.ndarray:
    """Two bits or more per element, a power of two; 0 where ``least`` bits are as wide."""
    return np.where(2 * n > least, 1 << np.ceil(np.log2(np.maximum(2 * n, 2))).astype(np.int64), 0)


def _bitmaps(values: np.ndarray, n: np.ndarray, width: np.ndarray) -> pa.Array:
    """A bitmap of its own width for each set, as bytes."""
    ends = np.concatenate([[0], np.cumsum(width // 8)]).astype(np.int64)
    out = np.zeros(ends[-1], np.uint8)
    of = np.repeat(np.arange(len(n)), n)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        packed = signatures(values[np.isin(of, rows) if len(rows) < len(n) else slice(None)], n[rows], int(w)).view(np.uint8)
        out[(ends[rows][:, None] + np.arange(w // 8)).ravel()] = packed.ravel()
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.binary())


def may_reach(na: int, x: np.ndarray, nb: int, y: np.ndarray, num: int, den: int) -> bool:
    """The bound of ``fits`` for two bitmaps (bytes), the wider one folded to the width of the other."""
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    surplus = min(na - int(np.bitwise_count(x).sum()), nb - int(np.bitwise_count(y).sum()))
    return min(int(np.bitwise_count(x & y).sum()) + surplus, na, nb) * (num + den) >= num * (na + nb)


class Order:
    """Rare first: elements of unknown slots by value, then those of known slots by the count of the slot. One slot per place of the lookup table."""

    def __init__(self, slots: np.ndarray, counts: np.ndarray):
        order = np.lexsort((slots, counts))  # ascending; later writes win a place, so the most frequent slot holds it
        self.slots = slots[order].astype(np.uint32)
        self.rank_at = np.full(1 << LOOKUP_BITS, -1, np.int32)
        at = self.slots >> np.uint32(32 - LOOKUP_BITS)
        self.rank_at[at] = np.arange(len(slots), dtype=np.int32)

    def __reduce__(self):
        return Order, (self.slots, np.arange(len(self.slots)))

    def prefix(self, values: np.ndarray, n: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first ``length`` elements of each set in this order, the set each belongs to, and its position."""
        row = np.repeat(np.arange(len(n)), n)
        slot = (values >> np.uint64(31)).astype(np.uint32)
        at = slot >> np.uint32(32 - LOOKUP_BITS)
        rank = self.rank_at[at]
        known = rank >= 0
        known[known] = self.slots[rank[known]] == slot[known]
        place = np.where(known, np.uint64(1 << 43) + rank.astype(np.uint64) % np.uint64(1 << 32), values >> np.uint64(20))
        order = _by_row(row, place, values, len(n))
        position = offsets(length)
        return values[order[np.repeat(np.cumsum(n) - n, length) + position]], np.repeat(np.arange(len(n)), length), position


def rarity_order(described: DataFrame) -> Order:
    """The order of a table, from the counts of all its elements. At most ``ORDER_SLOTS`` slots leave Spark, the most frequent ones of every range."""
    ranges = max(1, described.where("key is null").agg(F.max("range")).first()[0] or 0)
    most = max(1, ORDER_SLOTS // (ranges + 1))

    def top(key: tuple, table: pa.Table) -> pa.Table:
        slots, counts = blobs(table.column("slots"), np.uint32), blobs(table.column("counts"), np.uint32)
        order = np.argsort(slots)
        slots, counts = slots[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
        total, slots = np.add.reduceat(counts.astype(np.int64), first), slots[first]
        often = np.flatnonzero(total >= FREQUENT)
        often = often[np.argsort(-total[often], kind="stable")[:most]]
        return pa.table({"slots": pa.array([slots[often].tobytes()], pa.binary()), "counts": pa.array([total[often].tobytes()], pa.binary())})

    found = described.where("key is null").select("range", "slots", "counts").groupBy("range").applyInArrow(top, "slots binary, counts binary").collect()
    empty = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    return Order(np.concatenate([*empty[0], *(np.frombuffer(r.slots, np.uint32) for r in found)]), np.concatenate([*empty[1], *(np.frombuffer(r.counts, np.int64) for r in found)]))


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n + (-(n * num) // den) + 1


def fits(common_bits: np.ndarray, surplus: np.ndarray, na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether an overlap of ``common_bits + surplus`` and these sizes can reach the threshold: overlap * (num + den) >= num * (na + nb)."""
    most = np.minimum(common_bits + surplus, np.minimum(na, nb))
    return most * (num + den) >= num * (na + nb)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


MEMBERS = "range int, key long"


def members_of(lists: DataFrame) -> DataFrame:
    """``range, key`` of all lists (``range, members``), once each."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        k = np.unique(blobs(table.column("members"), np.int64))
        return pa.table({"range": pa.array(np.full(len(k), key[0].as_py(), np.int32)), "key": pa.array(k)})

    return lists.select("range", "members").groupBy("range").applyInArrow(run, MEMBERS)


#: Bits of the filter that keeps most other texts out of the joins of texts, as words of 64: a broadcast of at most 2**18 rows at every size.
FILTER_WORDS = 1 << 18


def only(rows: DataFrame, by: str, place: DataFrame, key: str, also: Column | None = None) -> DataFrame:
    """The rows whose ``by`` is in ``place`` (its column ``key``), and a few others: those whose hash meets a bit of the same place in a bitmap of fixed size.
    Rows for which ``also`` holds stay in any case."""

    def at(c: str) -> tuple[Column, Column]:
        h = F.pmod(F.xxhash64(c), F.lit(FILTER_WORDS * 64))
        return F.floor(h / 64).alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({c}), 64) as int))").alias("_bit")

    bits = place.select(*at(key)).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))
    met = rows.select(*rows.columns, *at(by)).join(F.broadcast(bits), "_word", "inner" if also is None else "left")
    return met.where(hit if also is None else hit | also).select(*rows.columns)


def texts_in_ranges(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``range, key, text`` of the wanted sets (range, key, row): only their texts are moved, once to meet the places and once to the ranges."""
    place = materialize(wanted.select("range", "key", F.col("row").alias("_row")))
    return only(rows.select("text", "id"), "id", place, "_row").join(place, F.col("id").eqNullSafe(F.col("_row"))).select("range", "key", "text")


def texts_of(rows: DataFrame, wanted: DataFrame, lines: bool) -> DataFrame:
    """``key, text`` of the wanted sets (key, row, part): the text of one row each, or its line ``part``. The places are written before, so that Spark knows their size
    when it picks the plan of the join.

    Rows that share an id may give a key a text of another set, too; ``Sets`` and ``line_join`` compare the digest."""
    if not lines:
        place = materialize(wanted.select("key", F.col("row").alias("_row")))
        return only(rows.select("text", "id"), "id", place, "_row").join(place, F.col("id").eqNullSafe(F.col("_row"))).select("key", "text")
    place = materialize(wanted.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("key", "part")).alias("parts")))
    found = only(rows.select("text", "id"), "id", place, "_row").join(place, F.col("id").eqNullSafe(F.col("_row"))).select(F.split("text", "\n", -1).alias("lines"), "parts")
    line = lambda p: F.struct(p["key"].alias("key"), F.get("lines", p["part"]).alias("text"))
    return found.select(F.explode(F.transform("parts", line)).alias("p")).select("p.key", "p.text").where("text is not null")


class Sets:
    """The sets of a task, by key, from a table of keys and texts."""

    def __init__(self, table: pa.Table, extract: Extract):
        key, column = table.column("key").to_numpy(), table.column("text").combine_chunks()
        found: dict[int, np.ndarray] = {}
        for at, _, values, n in extract(pa.RecordBatch.from_arrays([column], names=["text"])):
            ends = np.cumsum(n)
            for x in np.flatnonzero(digest(values, n) == key[at]):
                found.setdefault(int(key[at[x]]), values[ends[x] - n[x] : ends[x]])
        self.key = np.array(sorted(found), np.int64)
        self.values = [found[k] for k in self.key.tolist()]
        self.n = np.array([len(v) for v in self.values], np.int64)

    def similar(self, i: int, j: int, num: int, den: int) -> bool:
        common = overlap(self.values[i], self.values[j])
        return common * den >= num * (int(self.n[i]) + int(self.n[j]) - common)


def classes(links: DataFrame) -> DataFrame:
    """``key, label``: the smallest key of each linked key's class. Large-star and small-star steps until nothing changes."""
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = _checksum(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = materialize(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges = materialize(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        after = _checksum(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("key"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("key"), F.col("b").alias("label")).distinct())


def _checksum(edges: DataFrame) -> tuple[int, int]:
    """Number and hash sum of distinct edges: equal sums of two rounds mean that nothing changed."""
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))), F.lit(0)).alias("h")).first()
    return r.n, r.h
