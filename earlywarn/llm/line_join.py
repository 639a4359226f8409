"""Which lines have an earlier match: exact Jaccard join of line tokens with prefix, positional and length filters.

1. ``setjoin.describe`` gives the key and size of every line and the rarity order of all tokens.
2. A second scan deals the prefixes of the lines to ranges of tokens: token, key, size, position of the token in the line's order, place of the line (row, line number)
   and a bitmap of parities (64 bits, 128 for long lines), packed column by column in the least width that holds them. A line is dealt only where another set of its size could reach the threshold at all (fewer than ``num / (den - num)`` words match only their equals,
   which have the same key).
3. Each range orders the lines of a token by place and looks, for each line, for the earliest line before it that passes
   the length filter (sizes within the threshold of each other), the positional filter (the overlap can be the tokens before and at the shared one, and what is left of the
   shorter rest), and the parities (places that differ are words that only one of the two has). It returns that one pair, not all, and, where a line has more than one such line, the list.
4. The pairs meet their whole lines, read again from the texts, and are counted exactly.
5. Only lines none of whose pairs held go on: each is compared with all lines before it in its lists, by bitmaps of two bits or more per token and then, where these leave any, by the whole lines.

What a join needs of the lines or texts is told beforehand by a bitmap of fixed size (``setjoin.only``), so that most others stay where they are.

So a group of near copies costs one pair for each line, and a line without a match has been compared with all that the filters leave. The lines of one token are held by one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlywarn.llm import setjoin as sj
from earlywarn.llm import textkit as tk
from earlywarn.llm.storage import materialize

BITS = 128
#: Lines of more words have parities of 128 bits in their postings, others of 64.
LONG = 64
#: Lists of up to this many lines are compared at once; pairs and lines in one step.
SMALL = 48
PAIRS = 1 << 17
BLOCK = 1024
#: An entry of a long list is compared with no more blocks once so many entries before it passed; should none of them match, it meets the rest later.
ENOUGH = 64
#: Postings that a range holds before a table is dealt to more of them only for the sake of the cores.
LEAST_POSTINGS = 50_000
#: The place of a null id: before all others.
NULL_ROW = -(1 << 63)
#: Columns of a posting. A token is told from others of its range by 32 bits: two tokens that agree in them are one list, which only compares more.
POSTED = ("h", "k", "n", "pos", "row", "part", "sig")
FOUND = "range int, a long, b long, members binary, sizes binary"


def _widen(column: pa.ChunkedArray) -> np.ndarray:
    parts = [tk.widen(b.as_py()) for b in column]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _pack_parities(c: np.ndarray) -> np.ndarray:
    """The first halves of all entries, then the second halves of the long ones."""
    return np.concatenate([c[:, 0], c[c[:, 2] > 0, 1]])


def _distinct_entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The postings of a range that can pair, in the order they are compared in: by token (of those that several have), by place within it, of equal lines the first.
    Gives their places in the packed columns, their tokens and their keys; only two columns are widened at a time."""
    tokens, count = np.unique(sj.blobs(table.column("h"), np.uint32), return_counts=True)
    tokens = tokens[count > 1]
    h = sj.blobs(table.column("h"), np.uint32)
    t = np.searchsorted(tokens, h).astype(np.int32)
    at = np.flatnonzero(np.append(tokens, np.uint32(0))[t] == h).astype(np.int32) if len(tokens) else np.zeros(0, np.int32)
    t, k = t[at], sj.blobs(table.column("k"), np.int64)[at]
    del h
    # stable sorts from the last key to the first
    by = np.argsort(k, kind="stable").astype(np.int32)
    for name in ("part", "row"):
        by = by[np.argsort(_widen(table.column(name))[at][by], kind="stable")]
    by = by[np.argsort(t[by], kind="stable")]
    at, t, k = at[by], t[by], k[by]
    by = np.argsort(k, kind="stable").astype(np.int32)
    by = by[np.argsort(t[by], kind="stable")]
    new = np.ones(len(by), bool)
    new[1:] = (t[by][1:] != t[by][:-1]) | (k[by][1:] != k[by][:-1])
    by = np.sort(by[new])
    return at[by], t[by], k[by]


def _parities(column: pa.ChunkedArray, n: np.ndarray) -> np.ndarray:
    """Both halves of all entries, of sizes ``n``; 0 for second halves that were not sent."""
    out, lo = np.zeros((len(n), 2), np.uint64), 0
    for blob in column:
        c = np.frombuffer(blob.as_py(), np.uint64)
        # a blob of m entries, long of them long, has m + long halves: the least m with so many
        halves = np.cumsum(1 + (n[lo : lo + len(c)] > LONG))
        hi = lo + int(np.searchsorted(halves, len(c))) + 1
        out[lo:hi, 0] = c[: hi - lo]
        out[lo:hi, 1][n[lo:hi] > LONG] = c[hi - lo :]
        lo = hi
    return out


def _postings(rows: DataFrame, extract: sj.Extract, order: sj.Order, ranges: int, num: int, den: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(order)
    least = math.ceil(num / (den - num)) if den > num else 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            columns = {k: np.concatenate([x.pop(k) for x in held]) for k in POSTED}
            part = (tk.mix(columns["h"]) % np.uint64(ranges)).astype(np.int64)
            columns["h"] = (columns["h"] >> np.uint64(31)).astype(np.uint32)
            return sj.deal(part, ranges, columns, {"n": tk.narrow, "pos": tk.narrow, "row": tk.narrow, "part": tk.narrow, "sig": _pack_parities})

        for batch in batches:
            ids = batch.column(1).fill_null(NULL_ROW).to_numpy(zero_copy_only=False)
            for at, part, values, n in extract(batch):
                keys, row = sj.digest(values, n), ids[at]
                # equal lines of a chunk are dealt once, at their first place
                by = np.lexsort((part, row, keys))
                first = by[np.flatnonzero(np.concatenate([[True], keys[by][1:] != keys[by][:-1]]))] if len(by) else by
                pick = np.zeros(len(n), bool)
                pick[first] = True
                pick &= n >= least
                if not pick.any():
                    continue
                values, n, keys, row, part = values[np.repeat(pick, n)], n[pick], keys[pick], row[pick], part[pick]
                h, s, position = sent.value.prefix(values, n, sj.prefix_length(n, num, den))
                sig = sj.parities(values, n)
                sig = np.column_stack([sig, n > LONG])
                held.append({"h": h, "k": keys[s], "n": n[s].astype(np.int32), "pos": position.astype(np.int32), "row": row[s], "part": part[s].astype(np.int32), "sig": sig[s]})
                if sum(len(x["h"]) for x in held) > sj.HELD_POSTINGS:
                    yield flush()
                    held = []
        if held:
            yield flush()

    return rows.select("text", "id").mapInArrow(run, "range int, " + ", ".join(f"{k} binary" for k in POSTED))


class _Filter:
    """The filters of pairs of entries (i, j)."""

    def __init__(self, n: np.ndarray, pos: np.ndarray, sig: np.ndarray, num: int, den: int):
        self.n, self.pos, self.sig, self.num, self.den = n, pos, sig, num, den
        self.rest = n - pos - 1

    def mask(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        na, nb, num, den = self.n[i], self.n[j], self.num, self.den
        need = num * (na + nb)
        ok = (na * den >= nb * num) & (nb * den >= na * num)
        ok &= (np.minimum(self.pos[i], self.pos[j]) + 1 + np.minimum(self.rest[i], self.rest[j])) * (num + den) >= need
        at = np.flatnonzero(ok)
        i, j = i[at], j[at]
        differ = self.sig[i] ^ self.sig[j]
        apart = np.bitwise_count(differ[:, 0]).astype(np.int64)
        long = np.flatnonzero((self.n[i] > LONG) & (self.n[j] > LONG))
        apart[long] = np.bitwise_count(differ[long, 1]).astype(np.int64) + np.bitwise_count(differ[long, 0] ^ differ[long, 1])
        ok[at] = apart * (num + den) <= (na[at] + nb[at]) * (den - num)
        return ok


def _long_list(lo: int, hi: int, f: _Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The earliest entry before each entry of a long list that passes, and the entries that an entry with several such may have to meet: all that pass with another,
    and all not yet compared with one that has ``ENOUGH`` already."""
    a, b, keep, several = [], [], np.zeros(hi - lo, bool), False
    for x in range(lo, hi, BLOCK):
        j = np.arange(x, min(x + BLOCK, hi))
        seen = np.zeros(len(j), np.int64)
        for y in range(lo, x + BLOCK, BLOCK):
            i = np.arange(y, min(y + BLOCK, hi))
            open_ = np.flatnonzero(seen < ENOUGH)
            if len(open_) < len(j):
                keep[i - lo] = True
            for z in range(0, len(open_), max(1, PAIRS // len(i))):
                mine = open_[z : z + max(1, PAIRS // len(i))]
                ii, jj = np.tile(i, len(mine)), np.repeat(j[mine], len(i))
                ok = np.zeros(len(ii), bool)
                before = np.flatnonzero(ii < jj)
                ok[before] = f.mask(ii[before], jj[before])
                keep[ii[ok] - lo] = True
                keep[jj[ok] - lo] = True
                ok = ok.reshape(len(mine), len(i))
                n = ok.sum(1)
                fresh = (seen[mine] == 0) & (n > 0)
                a.append(i[ok[fresh].argmax(1)])
                b.append(j[mine[fresh]])
                seen[mine] += n
        several |= bool((seen > 1).any())
    cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
    return cat(a), cat(b), lo + np.flatnonzero(keep) if several else np.zeros(0, np.int64)


def _search(num: int, den: int):
    """Pairs (a before b) of one range, and the lists where a line has more than one candidate: their members that pass with another, in the order of place."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at, t, k = _distinct_entries(table)
        n = _widen(table.column("n"))
        sig = _parities(table.column("sig"), n)[at]
        f = _Filter(n[at], _widen(table.column("pos"))[at], sig, num, den)
        start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(k) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(k)))
        out_a, out_b, again = [], [], []
        for m in np.unique(size[(size > 1) & (size <= SMALL)]):
            first = start[size == m]
            jj, ii = np.tril_indices(int(m), -1)
            step = max(1, PAIRS // len(ii))
            for lo in range(0, len(first), step):
                base = first[lo : lo + step, None]
                i, j = (base + ii).ravel(), (base + jj).ravel()
                ok = f.mask(i, j)
                i, j = i[ok], j[ok]
                by = np.lexsort((i, j))
                i, j = i[by], j[by]
                new = np.ones(len(j), bool)
                new[1:] = j[1:] != j[:-1]
                out_a.append(i[new])
                out_b.append(j[new])
                # lists with an entry that has several: the entries that pass with another
                which = np.searchsorted(start, j, side="right") - 1
                more = np.isin(which, which[~new])
                again.append(np.unique(np.concatenate([i[more], j[more]])))
        for x in np.flatnonzero(size > SMALL):
            a, b, keep = _long_list(start[x], start[x] + size[x], f)
            out_a.append(a)
            out_b.append(b)
            again.append(keep)
        a, b, again = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (out_a, out_b, again))
        pair = np.unique(np.stack([k[a], k[b]]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        n = pair.shape[1]
        again = np.sort(again)
        members = [k[again].tobytes()] if len(again) else []
        sizes = [np.unique(np.searchsorted(start, again, side="right"), return_counts=True)[1].astype(np.int32).tobytes()] if len(again) else []
        blank, none = pa.nulls(len(members), pa.int64()), pa.nulls(n, pa.binary())
        return pa.table(
            {
                "range": pa.array(np.full(n + len(members), key[0].as_py(), np.int32)),
                "a": pa.chunked_array([pa.array(pair[0]), blank]),
                "b": pa.chunked_array([pa.array(pair[1]), blank]),
                "members": pa.chunked_array([none, pa.array(members, pa.binary())]),
                "sizes": pa.chunked_array([none, pa.array(sizes, pa.binary())]),
            }
        )

    return run


def _unsettled(key: tuple, lists: pa.Table, keys: pa.Table) -> pa.Table:
    """The lists that hold one of the keys (``open`` marks them), without what comes after the last of them."""
    members, sizes, marks = [], [], []
    if lists.num_rows and keys.num_rows:
        wanted = np.unique(keys.column("b").to_numpy())
        k, n = sj.blobs(lists.column("members"), np.int64), sj.blobs(lists.column("sizes"), np.int32)
        hit = np.isin(k, wanted)
        ends = np.cumsum(n)
        for lo, hi in zip(ends - n, ends, strict=True):
            at = np.flatnonzero(hit[lo:hi])
            if len(at) and at[-1]:
                last = lo + at[-1] + 1
                members.append(k[lo:last])
                sizes.append(last - lo)
                marks.append(hit[lo:last])
    rows = 1 if members else 0
    pack = lambda x: pa.array([np.concatenate(x).tobytes()] if rows else [], pa.binary())
    return pa.table({"range": pa.array([key[0].as_py()] * rows, pa.int32()), "members": pack(members), "sizes": pack([np.array(sizes, np.int32)]), "open": pack(marks)})


def _each(lists: pa.Table, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each open member of each list: its place in ``key`` (sorted) and those of the members before it."""
    members, marks, n = sj.blobs(lists.column("members"), np.int64), sj.blobs(lists.column("open"), bool), sj.blobs(lists.column("sizes"), np.int32)
    at = np.minimum(np.searchsorted(key, members), len(key) - 1)
    known = key[at] == members
    ends = np.cumsum(n)
    for lo, hi in zip(ends - n, ends, strict=True):
        for x in np.flatnonzero(marks[lo:hi] & known[lo:hi]):
            yield int(at[lo + x]), at[lo : lo + x][known[lo : lo + x]]


class _Bitmaps:
    """Bitmaps of several widths (powers of two), each compared at the lesser width of a pair."""

    def __init__(self, bitmaps: list[bytes], n: np.ndarray, num: int, den: int):
        self.n, self.num, self.den = n, num, den
        self.width = np.array([len(b) for b in bitmaps], np.int64)
        self.at = np.zeros(len(n), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for w in np.unique(self.width):
            mine = np.flatnonzero(self.width == w)
            self.at[mine] = np.arange(len(mine))
            self.rows[int(w)] = np.frombuffer(b"".join(bitmaps[i] for i in mine), np.uint64).reshape(len(mine), -1)

    def pass_(self, j: int, i: np.ndarray) -> np.ndarray:
        """Those of the sets ``i`` that may reach the threshold with set ``j``."""
        out = []
        for w in np.unique(self.width[i]):
            mine = i[self.width[i] == w]
            x, y = self.rows[int(w)][self.at[mine]], self.rows[int(self.width[j])][self.at[j]]
            while x.shape[1] > len(y):
                x = x[:, : x.shape[1] // 2] | x[:, x.shape[1] // 2 :]
            while len(y) > x.shape[1]:
                y = y[: len(y) // 2] | y[len(y) // 2 :]
            surplus = np.minimum(self.n[mine] - np.bitwise_count(x).sum(1).astype(np.int64), self.n[j] - int(np.bitwise_count(y).sum()))
            out.append(mine[sj.fits(np.bitwise_count(x & y).sum(1).astype(np.int64), surplus, self.n[mine], self.n[j], self.num, self.den)])
        return np.concatenate(out) if out else i


LISTS = "range int, members binary, sizes binary, open binary"


def _may_match(num: int, den: int):
    """For each open key of a range a list of the keys before it that bitmaps let pass, and itself."""

    def run(key: tuple, lists: pa.Table, sets: pa.Table) -> pa.Table:
        before: dict[int, set[int]] = {}
        if lists.num_rows and sets.num_rows:
            k = sets.column("key").to_numpy()
            order = pa.array(np.argsort(k))
            k, n = k[order.to_numpy()], sets.column("n").take(order).to_numpy().astype(np.int64)
            bitmaps = _Bitmaps(sets.column("bitmap").take(order).to_pylist(), n, num, den)
            for j, i in _each(lists, k):
                i = i[(n[i] * den >= n[j] * num) & (n[j] * den >= n[i] * num)]
                before.setdefault(j, set()).update(bitmaps.pass_(j, i).tolist())
        lists_ = [np.append(k[sorted(i)], k[j]) for j, i in before.items() if i]
        rows = 1 if lists_ else 0
        pack = lambda x: pa.array([np.concatenate(x).tobytes()] if rows else [], pa.binary())
        marks = [np.arange(len(x)) == len(x) - 1 for x in lists_]
        return pa.table({"range": pa.array([key[0].as_py()] * rows, pa.int32()), "members": pack(lists_), "sizes": pack([np.array([len(x) for x in lists_], np.int32)]), "open": pack(marks)})

    return run


def _settle(extract: sj.Extract, num: int, den: int):
    """The open keys of a range that match a member before them."""

    def run(key: tuple, lists: pa.Table, texts: pa.Table) -> pa.Table:
        settled: list[int] = []
        if lists.num_rows and texts.num_rows:
            s = sj.Sets(texts, extract)
            settled = [int(s.key[j]) for j, i in _each(lists, s.key) if any(s.similar(x, j, num, den) for x in i.tolist())]
        return pa.table({"b": pa.array(settled, pa.int64())})

    return run


def _verified(pairs: DataFrame, texts: DataFrame, extract: sj.Extract, num: int, den: int) -> DataFrame:
    """The later keys (b) of pairs whose exact similarity is num / den or more."""

    def sets(texts: pa.Array, keys: pa.Array) -> list[np.ndarray | None]:
        out: list[np.ndarray | None] = [None] * len(texts)
        key = keys.to_numpy()
        for at, _, values, n in extract(pa.RecordBatch.from_arrays([texts], names=["text"])):
            ends = np.cumsum(n)
            for x in np.flatnonzero(sj.digest(values, n) == key[at]):
                out[at[x]] = values[ends[x] - n[x] : ends[x]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for u, v in zip(sets(batch.column(2), batch.column(0)), sets(batch.column(3), batch.column(1)), strict=True):
                common = 0 if u is None or v is None else sj.overlap(u, v)
                ok.append(u is not None and v is not None and common * den >= num * (len(u) + len(v) - common))
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(ok, pa.bool_()))], names=["b"])

    left, right = texts.select(F.col("key").alias("a"), F.col("text").alias("x")), texts.select(F.col("key").alias("b"), F.col("text").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "b long")


def _ranges(total: int, cores: int) -> int:
    """Ranges for so many postings: ``sj.RANGE_POSTINGS`` each at most, and where these are too few to keep all cores evenly busy, four for each core."""
    return max(1, math.ceil(total / sj.RANGE_POSTINGS), min(4 * cores, math.ceil(total / LEAST_POSTINGS)))


def earlier_matches(rows: DataFrame, extract: sj.Extract, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Lines of a table (text, id long): ``members`` (``row, part, n, key``, one for each line whose key may be among the heads) and ``heads`` (``key, first, matched``): the first place of each key
    that has several lines or an earlier match, and whether a line with another key before that place matches it."""
    described = sj.describe(rows, extract, BITS)
    order = sj.rarity_order(described)
    members = described.where("key is not null")
    bitmap = F.when(F.length("wide") > 0, F.col("wide")).otherwise(F.col("sig")).alias("bitmap")
    one = members.groupBy("key").agg(F.min(F.struct("row", "part", "n", bitmap)).alias("at"), F.count(F.lit(1)).alias("copies"))
    reps = materialize(one.select("key", F.struct("at.row", "at.part").alias("first"), "copies", "at.n", "at.bitmap"))
    total = int(reps.agg(F.coalesce(F.sum(F.col("n") - F.ceil(F.col("n") * num / den) + 1), F.lit(0))).first()[0])
    ranges = _ranges(total, rows.sparkSession.sparkContext.defaultParallelism)
    found = materialize(_postings(rows, extract, order, ranges, num, den).groupBy("range").applyInArrow(_search(num, den), FOUND))
    pairs = materialize(found.where("a is not null").select("a", "b").distinct())
    # no semi-join: Spark would take it before the bitmap
    place = lambda keys: sj.only(reps, "key", keys, "key").join(keys, "key").select("key", F.col("first.row").alias("row"), F.col("first.part").alias("part"))
    keys = materialize(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct())
    texts = materialize(sj.texts_of(rows, place(keys), lines=True))
    matched = materialize(_verified(pairs, texts, extract, num, den).distinct())
    unsettled = found.where("a is not null").select(F.col("range").alias("at"), "b").join(matched, "b", "left_anti").distinct()
    lists = materialize(found.where("members is not null").select("range", "members", "sizes").groupBy("range").cogroup(unsettled.groupBy("at")).applyInArrow(_unsettled, LISTS))
    wanted = materialize(sj.members_of(lists))
    bitmaps = wanted.join(sj.only(reps, "key", wanted, "key").select("key", "n", "bitmap"), "key").select(F.col("range").alias("at"), "key", "n", "bitmap")
    lists = materialize(lists.groupBy("range").cogroup(bitmaps.groupBy("at")).applyInArrow(_may_match(num, den), LISTS))
    if lists.limit(1).count():
        wanted = materialize(sj.members_of(lists))
        texts = wanted.join(sj.texts_of(rows, place(wanted.select("key").distinct()), lines=True), "key").select("range", "key", "text")
        matched = matched.unionByName(lists.groupBy("range").cogroup(texts.groupBy("range")).applyInArrow(_settle(extract, num, den), "b long"))
    matched = materialize(matched.select(F.col("b").alias("key")).distinct())
    may = sj.only(reps, "key", matched, "key", F.col("copies") > 1)
    heads = may.join(matched.withColumn("matched", F.lit(True)), "key", "left").where("copies > 1 or matched").select("key", "first", F.coalesce("matched", F.lit(False)).alias("matched"))
    heads = materialize(heads)
    return sj.only(members, "key", heads, "key").select("row", "part", "n", "key"), heads
