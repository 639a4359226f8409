"""Benchmark decontamination with suffix arrays of the training text.

Documents are dealt into shards of about a megabyte of whole texts. In each shard the positions whose next words could begin a match of
the shortest window are sorted as suffixes (keys of ``KEY_WORDS`` word ranks), every suffix of every benchmark item is located by binary
search, and the range of suffixes that share a whole window gives all its places; each is extended word by word to its longest verbatim match. A position whose next words begin no such window starts no match that counts, so leaving it out of the sort changes nothing.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is ``window`` consecutive words of an item; an item of
fewer words, but not none, is one window. Words are compared by 64-bit hash.

Defined cases: null and empty texts have no words and are clean; null items and items without words match nothing; repeated item ids count
once in the lists of a document; repeated documents are judged alike; an empty table on either side gives clean documents or no rows;
other columns pass through whatever their names.

Plan: no shuffle. The benchmark is a stated query set. It is read in blocks of at most ``BLOCK_BYTES`` of text; each block is one pass of
``mapInArrow`` over the documents, and a bitmap of hit words travels along from block to block, so any number of blocks gives the same sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlywarn.llm import textkit as tk

WINDOW = 10
#: Words in a sort key; longer matches are extended past it.
KEY_WORDS = 16
BLOCK_BYTES = 16 << 20
STATE = "_hit binary, _items array<string>, _longest int, _longest_at int, _longest_item string, _words int, _n_hit long"


class TestSuffixes:
    """One block of benchmark items: all suffixes, their window lengths, and the hashes of the first ``lead`` words of each window."""

    __test__ = False

    def __init__(self, ids: list[str], texts: list[str], window: int):
        hashes, owner, room = [], [], []
        column = pa.array(texts, pa.large_string())
        for lo, hi, buf, off in tk.chunks(column):
            w = tk.words(buf, off, tk.ALNUM_WORDS)
            ends = np.cumsum(w.per_row)
            hashes.append(tk.word_hashes(w))
            owner.append(w.row + lo)
            room.append(ends[w.row] - np.arange(len(w.row)))
        self.ids, self.window = np.array(ids, dtype=object), window
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        self.room = np.concatenate(room) if room else np.zeros(0, np.int64)  # words from here to the end of the item
        size = np.zeros(len(ids), np.int64)
        np.add.at(size, self.owner, 1)
        size = size[self.owner]
        self.need = np.minimum(window, size)
        self.begins = self.room >= self.need  # suffixes that begin a window
        self.lead = int(min(4, self.need.min())) if len(self.need) else 0
        self.words, ranks = np.unique(self.hash, return_inverse=True)
        self.rank = (ranks + 1).astype(np.uint32)
        at = np.flatnonzero(self.begins)
        self.leads = np.unique(_lead_hash(self.hash, at, self.lead)) if len(at) else np.zeros(0, np.uint64)


def _lead_hash(h: np.ndarray, at: np.ndarray, lead: int) -> np.ndarray:
    total = np.zeros(len(at), np.uint64)
    for j in range(lead):
        total += h[at + j] * tk.POSITION[j]
    return tk.mix(total)


def _keys(rank: np.ndarray, at: np.ndarray, room: np.ndarray, take: np.ndarray | int = KEY_WORDS) -> np.ndarray:
    """Sort keys: ranks of the next words as big-endian bytes, 0 beyond the end."""
    step = np.arange(KEY_WORDS)
    inside = step[None, :] < np.minimum(room, take)[:, None]
    where = np.minimum(at[:, None] + step[None, :], max(len(rank) - 1, 0))
    return np.ascontiguousarray(np.where(inside, rank[where], 0).astype(">u4")).view(f"S{4 * KEY_WORDS}").ravel()


def search_shard(h: np.ndarray, per_row: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, list[set[int]], list[tuple[int, int, int]]]:
    """Hit words, items per document, and per document the longest match as (words, position in the document, suffix of the test block)."""
    hit = np.zeros(len(h) + 1, np.int32)
    items: list[set[int]] = [set() for _ in per_row]
    longest = [(0, -1, -1)] * len(per_row)
    if not len(h) or not test.lead:
        return hit[:-1] > 0, items, longest
    ends = np.cumsum(per_row)
    row = np.repeat(np.arange(len(per_row)), per_row)
    room = ends[row] - np.arange(len(h))
    at = np.flatnonzero(room >= test.lead)
    at = at[np.isin(_lead_hash(h, at, test.lead), test.leads)]
    if not len(at):
        return hit[:-1] > 0, items, longest
    # ranks within the test vocabulary; words outside it end every match
    found = np.minimum(np.searchsorted(test.words, h), len(test.words) - 1)
    rank = np.where(test.words[found] == h, found + 1, len(test.words) + 1).astype(np.uint32)
    key = _keys(rank, at, room[at])
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    suffixes = np.arange(len(test.hash))
    test_key = _keys(test.rank, suffixes, test.room)
    place = np.searchsorted(key, test_key)
    # matches shorter than a window: the neighbours of the place where the suffix would stand
    for side in (place - 1, place):
        ok = np.flatnonzero((side >= 0) & (side < len(key)))
        spot = at[side[ok]]
        length = np.zeros(len(ok), np.int64)
        live = np.arange(len(ok))
        while len(live):
            more = (length[live] < room[spot[live]]) & (length[live] < test.room[ok[live]])
            live = live[more]
            same = rank[spot[live] + length[live]] == test.rank[ok[live] + length[live]]
            live = live[same]
            length[live] += 1
        for j in np.flatnonzero(length):
            d = row[spot[j]]
            if length[j] > longest[d][0]:
                longest[d] = (int(length[j]), int(spot[j] - (ends[d] - per_row[d])), int(ok[j]))
    # all places of whole windows
    begins = np.flatnonzero(test.begins)
    need = test.need[begins]
    for size in np.unique(need):
        mine = begins[need == size]
        size = int(size)
        take = min(size, KEY_WORDS)
        low = _keys(test.rank, mine, test.room[mine], take)
        lo = np.searchsorted(key, low, side="left")
        high = np.frombuffer(low.tobytes(), np.uint8).reshape(len(low), -1).copy()
        high[:, 4 * take :] = 0xFF
        hi = np.searchsorted(key, high.view(f"S{4 * KEY_WORDS}").ravel(), side="right")
        n = hi - lo
        which = np.repeat(mine, n)
        spot = at[np.repeat(lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))]
        fits = room[spot] >= size
        which, spot = which[fits], spot[fits]
        for j in range(take, size):  # windows longer than a key
            same = rank[spot + j] == test.rank[which + j]
            which, spot = which[same], spot[same]
        np.add.at(hit, spot, 1)
        np.add.at(hit, spot + size, -1)
        # every place of a window, extended: the longest match of its document, whatever other documents and items share of it
        length = np.full(len(spot), size)
        live = np.arange(len(spot))
        while len(live):
            live = live[(length[live] < room[spot[live]]) & (length[live] < test.room[which[live]])]
            live = live[rank[spot[live] + length[live]] == test.rank[which[live] + length[live]]]
            length[live] += 1
        for j in np.lexsort((which, spot, length)) if len(spot) else ():
            d = row[spot[j]]
            if length[j] > longest[d][0]:
                longest[d] = (int(length[j]), int(spot[j] - (ends[d] - per_row[d])), int(which[j]))
        pairs = np.unique(row[spot] * len(test.ids) + test.owner[which])
        for p in pairs:
            items[p // len(test.ids)].add(int(p % len(test.ids)))
    return np.cumsum(hit[:-1]) > 0, items, longest


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[tuple[list[str], list[str]]]:
    """The items in blocks of bounded size, streamed one partition at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null and i is not null").toLocalIterator():
        if size and size + len(r.t) > BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t)
    if ids:
        yield ids, texts


def _pass(text_at: int, test_of, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = test_of()
        for batch in batches:
            own = batch.columns if first else batch.columns[:-7]
            old = None if first else [c.to_pylist() for c in batch.columns[-7:]]
            out: list[list] = [[] for _ in range(7)]
            for lo, _, buf, off in tk.chunks(own[text_at]):
                w = tk.words(buf, off, tk.ALNUM_WORDS)
                hit, items, longest = search_shard(tk.word_hashes(w), w.per_row, test)
                ends = np.cumsum(w.per_row)
                for d, n in enumerate(w.per_row):
                    mine = hit[ends[d] - n : ends[d]]
                    names = {str(test.ids[i]) for i in items[d]}
                    length, spot, suffix = longest[d]
                    item = str(test.ids[test.owner[suffix]]) if length else None
                    if old:
                        mine = mine | np.unpackbits(np.frombuffer(old[0][lo + d], np.uint8), count=n).astype(bool)
                        names |= set(old[1][lo + d])
                        if old[2][lo + d] >= length:
                            length, spot, item = old[2][lo + d], old[3][lo + d], old[4][lo + d]
                    for k, v in enumerate((np.packbits(mine).tobytes(), sorted(names), length, spot, item, int(n), int(mine.sum()))):
                        out[k].append(v)
            types = [pa.binary(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, t) for v, t in zip(out, types, strict=True))], names=[f"c{i}" for i in range(len(own) + 7)])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted strings), longest_match (words), longest_at (word position), longest_item, hit (bitmap)."""
    spark = docs.sparkSession
    names = docs.columns
    out = docs.toDF(*(f"c{i}" for i in range(len(names))))
    schema = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes)) + ", " + STATE
    at, first = names.index(text), True
    for ids, texts in _blocks(benchmark, item, item_text):
        sent = spark.sparkContext.broadcast((ids, texts))
        out = out.mapInArrow(_pass(at, _cached(sent, window), first), schema)
        first = False
    if first:
        out = out.mapInArrow(_pass(at, lambda: TestSuffixes([], [], window), True), schema)
    result = out.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)), F.col("_words").cast("long").alias("_n_words"), "_n_hit", "_items", "_longest", "_longest_at", "_longest_item", "_hit")
    return result


def _cached(sent, window: int):
    def get() -> TestSuffixes:
        ids, texts = sent.value
        return TestSuffixes(ids, texts, window)

    return get


def items_digest(items: list[str]) -> str:
    """Lower-case hex SHA-256 of the ids, sorted as strings and joined by commas."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of an item occurs, with their own columns."""
    found = find_contamination(docs, benchmark, **options)
    n = len(docs.columns)
    every = found.toDF(*(f"c{i}" for i in range(len(found.columns))))
    clean = every.where(F.size(f"c{n + 2}") == 0)
    return clean.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
