"""Near duplicates by MinHash: many universal hash minima, banding, signature verification, and classes by alternating large-star and small-star steps.

1. One pass over the texts gives each row's set of shingles, its key (equal sets are one set from then on) and its signature: the least value of each of ``HASHES`` functions
   ``(a * x + b) mod 2**32``, kept to 16 bits.
2. The signature is cut into ``HASHES / BAND`` bands. Sets with an equal band are dealt together; lists of the same members become one.
3. The members' signatures join the lists. Pairs whose signatures agree in less than a share that similar sets all but never miss are ruled out; members that can
   link with no other of their list leave it.
4. The texts of what is left join the lists, and pairs of sets of different classes are counted exactly (``signature_trees``). A range returns one link for each set it has
   linked, never its pairs. ``setjoin.classes`` joins the ranges' classes.

Two sets with a similarity of 0.8 share no band with a probability of 4e-9, and the share asked of signatures lies 6.5 deviations below what such sets agree in; no list is
capped, and what is linked is counted on full sets.

Defined cases: a document without words (null, empty or blank text) has an empty set and is a class of its own; with fewer words than a shingle the whole sequence is one
shingle; repeated rows are equal sets, so one class; a null id stays null and never names a class unless all ids of the class are null, and is kept only then; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlywarn.llm import setjoin as sj
from earlywarn.llm import signature_trees as st
from earlywarn.llm import textkit as tk
from earlywarn.llm.near_duplicates import named_classes
from earlywarn.llm.storage import materialize

NUM, DEN, WORDS = 4, 5, 2
HASHES, BAND = 384, 6
#: Minima that are compared before all of them are.
FIRST = 128
#: Deviations below the threshold at which a pair of signatures is ruled out.
DEVIATIONS = 6.5
#: Sets of a list that are compared with all others at a time.
STEP = 64


def functions(n: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of ``n`` hash functions, from a fixed sequence."""
    drawn = tk.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(tk.BASE))
    return (drawn[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (drawn[n:] >> np.uint64(32)).astype(np.uint32)


def minima(values: np.ndarray, n: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """The signature of each non-empty set, 16 bits a function."""
    sets = np.flatnonzero(n)
    out = np.zeros((len(n), hashes), np.uint16)
    if not len(sets):
        return out
    x = (tk.mix(values) >> np.uint64(32)).astype(np.uint32)
    start = (np.cumsum(n) - n)[sets]
    held = np.empty_like(x)
    for i, (a, b) in enumerate(zip(*functions(hashes), strict=True)):
        np.multiply(x, a, out=held)
        np.add(held, b, out=held)
        # the least values have few high bits, so they are mixed before they are cut
        out[sets, i] = np.minimum.reduceat(held, start) * np.uint32(0x9E3779B1) >> np.uint32(16)
    return out


def bands(sig: np.ndarray, band: int = BAND) -> np.ndarray:
    """A 64-bit hash of each band, which holds its number."""
    sets, hashes = sig.shape
    parts = sig[:, : hashes // band * band].reshape(sets, -1, band).astype(np.uint64)
    h = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64) * np.uint64(tk.BASE), parts.shape[:2]).copy()
    for k in range(band):
        h = tk.mix((h ^ parts[:, :, k]) * np.uint64(tk.BASE) + np.uint64(k))
    return h


DESCRIBED = "row long, part int, n int, key long, sig binary"


def describe(rows: DataFrame, extract: sj.Extract) -> DataFrame:
    """The sets of a table (text, id long), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part, values, n in extract(batch):
                sig = minima(values, n)
                yield pa.record_batch({
                    "row": batch.column(1).take(pa.array(at)), "part": pa.array(part.astype(np.int32)), "n": pa.array(n.astype(np.int32)), "key": pa.array(sj.digest(values, n)),
                    "sig": pa.array([s.tobytes() if k else None for s, k in zip(sig, n, strict=True)], pa.binary()),
                })

    return materialize(rows.select("text", "id").mapInArrow(run, DESCRIBED))


def _postings(reps: DataFrame, ranges: int) -> DataFrame:
    """(band, key), packed by ranges of bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ks, held = [], [], 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate(hs)
            return sj.deal((tk.mix(h) % np.uint64(ranges)).astype(np.int64), ranges, {"h": h, "k": np.concatenate(ks)})

        for batch in batches:
            if not batch.num_rows:
                continue
            h = bands(_signatures(batch.column(1)))
            hs.append(h.ravel())
            ks.append(np.repeat(batch.column(0).to_numpy(), h.shape[1]))
            held += h.size
            if held > sj.HELD_POSTINGS:
                yield flush()
                hs, ks, held = [], [], 0
        if held:
            yield flush()

    return reps.select("key", "sig").mapInArrow(run, "range int, h binary, k binary")


def _signatures(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


class _Signed:
    """The sets of one range with their signatures, and the classes found so far."""

    def __init__(self, n: np.ndarray, sig: np.ndarray, num: int, den: int):
        self.n, self.sig, self.num, self.den = n, sig, num, den
        self.label = np.arange(len(n))
        share = num / den
        least = lambda k: math.floor(k * (share - DEVIATIONS * math.sqrt(share * (1 - share) / k)))
        self.first, self.all = least(FIRST), least(sig.shape[1])

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether pairs may be similar, by their sizes and signatures."""
        a, b = self.n[i], self.n[j]
        keep = np.flatnonzero((a * self.den >= b * self.num) & (b * self.den >= a * self.num))
        for upto, least in ((FIRST, self.first), (self.sig.shape[1], self.all)):
            near = np.zeros(len(keep), bool)
            for lo in range(0, len(keep), 1 << 14):
                k = keep[lo : lo + (1 << 14)]
                near[lo : lo + len(k)] = (self.sig[i[k], :upto] == self.sig[j[k], :upto]).sum(1) >= least
            keep = keep[near]
        out = np.zeros(len(i), bool)
        out[keep] = True
        return out

    def _unite(self, i: np.ndarray, j: np.ndarray) -> None:
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = self.label[x], self.label[y]
            if a != b:
                self.label[self.label == b] = a

    def link(self, m: np.ndarray) -> None:
        """Join the members of one list that may link: first with one of them, then those of different classes."""
        m = m[np.argsort(self.n[m], kind="stable")]
        pivot = m[len(m) // 2]
        others = m[self.label[m] != self.label[pivot]]
        near = others[self.agree(others, np.full(len(others), pivot))]
        self.label[np.isin(self.label, np.unique(self.label[near]))] = self.label[pivot]
        size = self.n[m]
        for lo in range(0, len(m), STEP):
            i = m[lo : lo + STEP]
            if (self.label[m[lo:]] == self.label[m[lo]]).all():
                break
            hi = int(np.searchsorted(size * self.num, size[min(lo + STEP, len(m)) - 1] * self.den, side="right"))  # sizes ascend
            j = m[lo:hi]
            x, y = np.nonzero((self.label[i][:, None] != self.label[j][None, :]) & (np.arange(len(i))[:, None] < np.arange(len(j))[None, :]))
            near = self.agree(i[x], j[y])
            self._unite(i[x[near]], j[y[near]])


def _may_link(num: int, den: int):
    """The lists of a range without the members that can link with no other of the list."""

    def run(key: tuple, lists: pa.Table, sets: pa.Table) -> pa.Table:
        left: dict[bytes, np.ndarray] = {}
        if lists.num_rows and sets.num_rows:
            order = pa.array(np.argsort(sets.column("key").to_numpy()))
            k, n = sets.column("key").take(order).to_numpy(), sets.column("n").take(order).to_numpy().astype(np.int64)
            mine = _Signed(n, _signatures(sets.column("sig").take(order)), num, den)
            for m in st._each(lists, k):
                mine.link(m)
            for m in st._each(lists, k):
                m = m[np.argsort(mine.label[m], kind="stable")]
                for group in np.split(m, np.flatnonzero(np.diff(mine.label[m])) + 1):
                    if len(group) > 1:
                        same = np.sort(k[group])
                        left[same.tobytes()] = same
        rows = 1 if left else 0
        sizes = np.array([len(x) for x in left.values()], np.int32)
        return pa.table({"range": pa.array([key[0].as_py()] * rows, pa.int32()), "members": pa.array([b"".join(left)] * rows, pa.binary()), "sizes": pa.array([sizes.tobytes()] * rows, pa.binary())})

    return run


def link_sets(rows: DataFrame, extract: sj.Extract, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Sets of a table (text, id long) and their classes, as ``signature_trees.link_sets``: ``row, part, n, key`` for each set, and ``key, label`` for linked keys."""
    members = describe(rows, extract)
    reps = materialize(members.where("n > 0").groupBy("key").agg(F.min(F.struct("row", "part", "n", "sig")).alias("at")).select("key", "at.*"))
    ranges = max(1, math.ceil(reps.count() * (HASHES // BAND) / sj.RANGE_POSTINGS))
    lists = materialize(_postings(reps, ranges).groupBy("range").applyInArrow(st._lists(ranges), st.LISTS))
    signed = sj.members_of(lists).join(reps.select("key", "n", "sig"), "key").select("range", "key", "n", "sig")
    lists = materialize(lists.groupBy("range").cogroup(signed.groupBy(F.col("range").alias("at"))).applyInArrow(_may_link(num, den), st.LISTS))
    wanted = sj.members_of(lists).join(reps.select("key", "row"), "key").select("range", "key", "row")
    dealt = sj.texts_in_ranges(rows, wanted)
    links = lists.groupBy("range").cogroup(dealt.groupBy("range")).applyInArrow(st._links(extract, num, den), "a long, b long")
    return members.select("row", "part", "n", "key"), materialize(sj.classes(links))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = NUM, den: int = DEN, words: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``; the document that names its class is kept."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return named_classes(*link_sets(rows, sj.shingle_sets(words), num, den)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
