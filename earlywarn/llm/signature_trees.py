"""Exact Jaccard join of sets by rare prefixes and signature trees, and the classes that its links make.

1. ``setjoin.describe`` gives each row's key, size and bitmaps, and the rarity order of all elements.
2. A second scan deals (element, key) of the prefixes to ranges of elements. Each range keeps elements with two sets or more; lists of the same members become one
   and move to the range of their smallest member, so that the lists of one cluster of near copies meet.
3. The members' bitmaps join the lists. Each list becomes a signature tree: nodes hold the OR of their sets' bitmaps, the range of sizes and the
   largest surplus (elements less bits). Dual traversal drops a pair of nodes when its largest possible overlap (the common bits and the lesser surplus), or its sizes,
   rule out the threshold, or when all sets below both are in one group already; bitmaps of two bits or more per element rule out most of what is left.
   What may link is grouped, and a list keeps only the members that have another of their group in it.
4. The texts of these members join the lists they are left in, once per range; the trees are traversed again, and each pair of sets of different classes is counted exactly.
5. A range joins what it has linked into classes of its own and returns one link for each set, not its pairs. ``setjoin.classes`` joins the ranges' classes.

A list of near copies is first tried against one of its sets, which usually leaves one class. So no link between classes is lost, and a group of copies never
becomes all its pairs. The members of one list, and the texts of those that may link, are held by one task.
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

BITS = 512
LEAF = 32
FAN_OUT = 8
#: Lists of more members are tried against one of them first.
STAR = 6
LISTS = "range int, members binary, sizes binary"


def _postings(rows: DataFrame, extract: sj.Extract, order: sj.Order, ranges: int, num: int, den: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ks, held = [], [], 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate(hs)
            return sj.deal((tk.mix(h) % np.uint64(ranges)).astype(np.int64), ranges, {"h": h, "k": np.concatenate(ks)})

        for batch in batches:
            for _, _, values, n in extract(batch):
                keys = sj.digest(values, n)
                # equal sets of a chunk are dealt once
                pick = np.zeros(len(n), bool)
                pick[np.unique(keys, return_index=True)[1]] = True
                pick &= n > 0
                values, n, keys = values[np.repeat(pick, n)], n[pick], keys[pick]
                if len(n):
                    h, row, _ = sent.value.prefix(values, n, sj.prefix_length(n, num, den))
                    hs.append(h)
                    ks.append(keys[row])
                    held += len(h)
                if held > sj.HELD_POSTINGS:
                    yield flush()
                    hs, ks, held = [], [], 0
        if held:
            yield flush()

    return rows.select("text", "id").mapInArrow(run, "range int, h binary, k binary")


def _lists(ranges: int):
    """Lists of two sets or more that share an element of this range; equal lists once, each at the range of its smallest member."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        h, k = sj.blobs(table.column("h"), np.uint64), sj.blobs(table.column("k"), np.int64)
        order = np.lexsort((k, h))
        h, k = h[order], k[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
        h, k = h[new], k[new]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(start, len(h)))
        # members are in key order, so lists of the same members have the same digest
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(k.view(np.uint64)))])
        many = np.flatnonzero(size > 1)
        same = np.stack([(total[start + size] - total[start])[many], size[many].astype(np.uint64)], axis=1)
        lists = many[np.sort(np.unique(same, axis=0, return_index=True)[1])] if len(many) else many
        n = size[lists]
        flat = k[np.repeat(start[lists], n) + sj.offsets(n)]
        home = (tk.mix(k[start[lists]].view(np.uint64)) % np.uint64(ranges)).astype(np.int64)
        by = np.argsort(home, kind="stable")
        cut = np.searchsorted(home[by], np.arange(ranges + 1))
        ends = np.concatenate([[0], np.cumsum(n)])
        rows = [(r, by[cut[r] : cut[r + 1]]) for r in np.flatnonzero(np.diff(cut))]
        members = [np.concatenate([flat[ends[i] : ends[i + 1]] for i in mine]).tobytes() for _, mine in rows]
        return pa.table({"range": pa.array([int(r) for r, _ in rows], pa.int32()), "members": pa.array(members, pa.binary()), "sizes": pa.array([n[mine].astype(np.int32).tobytes() for _, mine in rows], pa.binary())})

    return run


class Tree:
    """A signature tree over sets in the order of size. Level 0 holds the sets; a node covers ``LEAF``, then ``FAN_OUT`` of the level below."""

    def __init__(self, sig: np.ndarray, n: np.ndarray):
        self.levels = [(sig, n, n, n - np.bitwise_count(sig).sum(1))]
        self.span = [1]
        while len(self.levels[-1][0]) > 1:
            s, low, high, surplus = self.levels[-1]
            step = LEAF if len(self.levels) == 1 else FAN_OUT
            at = np.arange(0, len(s), step)
            self.levels.append((np.bitwise_or.reduceat(s, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(surplus, at)))
            self.span.append(step)

    def pairs(self, num: int, den: int, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i < j) of sets of different classes that may reach the threshold, from the root down. ``label``: the class of each set."""
        top = len(self.levels) - 1
        pure = [(label, label)]
        for level in range(1, top + 1):
            at = np.arange(0, len(pure[-1][0]), self.span[level])
            pure.append((np.minimum.reduceat(pure[-1][0], at), np.maximum.reduceat(pure[-1][1], at)))
        work = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while work:
            level, a, b = work.pop()
            if len(a) > 4096 and level > 0:
                half = len(a) // 2
                work += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            s, low, high, surplus = self.levels[level]
            least, most = pure[level]
            # sizes closest to each other allow the largest similarity
            ok = (high[a] * den >= low[b] * num) & (high[b] * den >= low[a] * num)
            ok &= (least[a] != most[a]) | (least[b] != most[b]) | (least[a] != least[b])
            if level == 0:
                ok &= a < b
            a, b = a[ok], b[ok]
            common = np.bitwise_count(s[a] & s[b]).sum(1).astype(np.int64)
            ok = (common + np.minimum(surplus[a], surplus[b])) * (num + den) >= num * (low[a] + low[b])
            a, b = a[ok], b[ok]
            if level == 0:
                if len(a):
                    yield a, b
                continue
            step, below = self.span[level], len(self.levels[level - 1][0])
            for x, y in zip(a, b, strict=True):
                i = np.arange(x * step, min(below, (x + 1) * step))
                j = np.arange(y * step, min(below, (y + 1) * step))
                ii, jj = np.repeat(i, len(j)), np.tile(j, len(i))
                half = ii <= jj
                work.append((level - 1, ii[half], jj[half]))


class _Range:
    """The sets of one range (sizes, bitmaps, a test of two sets) and the classes found so far."""

    def __init__(self, n: np.ndarray, sig: np.ndarray, test, num: int, den: int):
        self.n, self.sig, self.test, self.num, self.den = n, sig, test, num, den
        self.surplus = n - np.bitwise_count(sig).sum(1).astype(np.int64)
        self.label = np.arange(len(n))
        self.inside: dict[int, list[int]] = {}
        self.failed: set[tuple[int, int]] = set()

    def unite(self, i: int, j: int) -> None:
        x, y = int(self.label[i]), int(self.label[j])
        a, b = self.inside.pop(x, [x]), self.inside.pop(y, [y])
        if len(a) < len(b):
            x, a, b = y, b, a
        self.label[b] = x
        a.extend(b)
        self.inside[x] = a

    def try_pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True):
            if self.label[i] == self.label[j] or (i, j) in self.failed:
                continue
            if self.test(i, j):
                self.unite(i, j)
            else:
                self.failed.add((i, j))

    def link(self, m: np.ndarray) -> None:
        """Link the sets of one list."""
        label = self.label[m]
        if (label == label[0]).all():
            return
        m = m[np.argsort(self.n[m], kind="stable")]
        if len(m) > STAR:
            pivot = m[len(m) // 2]
            others = m[self.label[m] != self.label[pivot]]
            common = np.bitwise_count(self.sig[others] & self.sig[pivot]).sum(1).astype(np.int64)
            others = others[sj.fits(common, np.minimum(self.surplus[others], self.surplus[pivot]), self.n[others], self.n[pivot], self.num, self.den)]
            self.try_pairs(others, np.full(len(others), pivot))
        for a, b in Tree(self.sig[m], self.n[m]).pairs(self.num, self.den, self.label[m]):
            self.try_pairs(m[a], m[b])


def _each(lists: pa.Table, key: np.ndarray) -> Iterator[np.ndarray]:
    """The members of each list as places in ``key`` (sorted; others are left out), short lists first."""
    members, size = sj.blobs(lists.column("members"), np.int64), sj.blobs(lists.column("sizes"), np.int32).astype(np.int64)
    at = np.minimum(np.searchsorted(key, members), len(key) - 1)
    known = key[at] == members
    ends = np.cumsum(size)
    for i in np.argsort(size, kind="stable"):
        lo, hi = ends[i] - size[i], ends[i]
        m = at[lo:hi][known[lo:hi]]
        if len(m) > 1:
            yield m


def _may_link(num: int, den: int):
    """The lists of a range without the members that can link with no other of the list: by trees and bitmaps alone."""

    def run(key: tuple, lists: pa.Table, sets: pa.Table) -> pa.Table:
        left: dict[bytes, np.ndarray] = {}
        if lists.num_rows and sets.num_rows:
            k = sets.column("key").to_numpy()
            order = pa.array(np.argsort(k))
            k, n = k[order.to_numpy()], sets.column("n").take(order).to_numpy().astype(np.int64)
            sig = np.frombuffer(b"".join(sets.column("sig").take(order).to_pylist()), np.uint64).reshape(len(k), -1)
            wide = [np.frombuffer(w, np.uint64) if w else s for w, s in zip(sets.column("wide").take(order).to_pylist(), sig, strict=True)]
            mine = _Range(n, sig, lambda i, j: sj.may_reach(int(n[i]), wide[i], int(n[j]), wide[j], num, den), num, den)
            for m in _each(lists, k):
                mine.link(m)
            for m in _each(lists, k):
                m = m[np.argsort(mine.label[m], kind="stable")]
                for group in np.split(m, np.flatnonzero(np.diff(mine.label[m])) + 1):
                    if len(group) > 1:
                        same = np.sort(k[group])
                        left[same.tobytes()] = same
        rows = 1 if left else 0
        sizes = np.array([len(x) for x in left.values()], np.int32)
        return pa.table({"range": pa.array([key[0].as_py()] * rows, pa.int32()), "members": pa.array([b"".join(left)] * rows, pa.binary()), "sizes": pa.array([sizes.tobytes()] * rows, pa.binary())})

    return run


def _links(extract: sj.Extract, num: int, den: int):
    """One link (a, b) for each set of the range that belongs to a class of two or more."""

    def run(key: tuple, lists: pa.Table, texts: pa.Table) -> pa.Table:
        a = b = np.zeros(0, np.int64)
        if lists.num_rows and texts.num_rows:
            sets = sj.Sets(texts, extract)
            mine = _Range(sets.n, sj.signatures(np.concatenate(sets.values), sets.n, BITS), lambda i, j: sets.similar(i, j, num, den), num, den)
            for m in _each(lists, sets.key):
                mine.link(m)
            moved = np.flatnonzero(mine.label != np.arange(len(mine.label)))
            a, b = sets.key[moved], sets.key[mine.label[moved]]
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def link_sets(rows: DataFrame, extract: sj.Extract, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Sets of a table (text, id long) and their classes.

    Returns ``(members, labels)``: members has ``row, part, n, key`` for each set, labels has ``key, label`` for keys that are linked with another."""
    described = sj.describe(rows, extract, BITS)
    order = sj.rarity_order(described)
    members = described.where("key is not null")
    reps = materialize(members.where("n > 0").groupBy("key").agg(F.min(F.struct("row", "part", "n", "sig", "wide")).alias("at")).select("key", "at.*"))
    total = int(reps.agg(F.coalesce(F.sum(F.col("n") - F.ceil(F.col("n") * num / den) + 1), F.lit(0))).first()[0])
    ranges = max(1, math.ceil(total / sj.RANGE_POSTINGS))
    lists = materialize(_postings(rows, extract, order, ranges, num, den).groupBy("range").applyInArrow(_lists(ranges), LISTS))
    bitmaps = sj.members_of(lists).join(reps.select("key", "n", "sig", "wide"), "key").select("range", "key", "n", "sig", "wide")
    lists = materialize(lists.groupBy("range").cogroup(bitmaps.groupBy(F.col("range").alias("at"))).applyInArrow(_may_link(num, den), LISTS))
    wanted = sj.members_of(lists).join(reps.select("key", "row"), "key").select("range", "key", "row")
    dealt = sj.texts_in_ranges(rows, wanted)
    links = lists.groupBy("range").cogroup(dealt.groupBy("range")).applyInArrow(_links(extract, num, den), "a long, b long")
    return members.select("row", "part", "n", "key"), materialize(sj.classes(links))
