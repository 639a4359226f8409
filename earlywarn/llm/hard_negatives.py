"""Hard negatives by segment summaries: rows of other labels that score just below an anchor's positives.

A vector is cut into segments, and of each its mean and its deviation (the length of what the mean leaves) are stored, for 4 segments and for 16. The inner product of two segments
lies within ``length * mean * mean`` plus or minus ``deviation * deviation``, so two small matrix products bound the scores of a block of rows with a block of anchors. What the
coarse segments leave open is bounded by the fine ones, and what these leave open is scored exactly. Bounds are compared with the anchor's best scores so far, so ties are kept.

1. Rows are packed into blocks (ids, labels, whole-number components, summaries), in one narrow pass; blocks are written once. Anchors are packed into blocks of their own.
2. Blocks of rows meet blocks of anchors on a grid: every task holds one block of anchors and a few blocks of rows, whatever a label's share. Each returns the best positives
   it saw of each anchor; a ranked window, cut before its exchange, merges them.
3. The same grid finds, for each anchor and positive, the best rows of other labels within the window that the positive's score sets.

Every anchor meets every row, as the query set asks, but as blocks: what is moved is packed, and what is returned is bounded by the ranks asked for.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; a null id is no anchor and comes last among ties; shorter vectors count as
padded with zeros, empty ones score 0; of rows that repeat an id each is a row of its own, and as an anchor has its own rows; positives with a negative score have an empty
window; an empty table gives no rows; other columns are ignored. Scores that could leave 63 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.llm.storage import materialize
from earlywarn.llm.textkit import narrow, widen

POSITIVES, NEGATIVES = 5, 3
COARSE, FINE = 4, 16
#: Rows of a block, anchors of a block, and blocks of rows that one task meets.
BLOCK_ROWS, BLOCK_ANCHORS, TASK_BLOCKS = 2048, 1024, 8
#: Bounds are computed in float; they are widened by this share of the product of the vectors' lengths.
SLACK = 1e-5
#: Above this share of open pairs a whole matrix product is cheaper than one pair at a time.
DENSE = 0.1
LAST = np.iinfo(np.int64).max

BLOCK = "block long, n int, width int, ids binary, labels binary, vectors binary, coarse binary, fine binary, at binary"


class Rows:
    """The rows of a block as arrays."""

    def __init__(self, r: dict):
        self.n, self.width = r["n"], r["width"]
        self.id, self.label = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
        self.at = np.frombuffer(r["at"], np.int64)
        self.vector = widen(r["vectors"]).reshape(self.n, self.width)
        self.coarse, self.fine = (np.frombuffer(r[k], np.float32).reshape(2, self.n, -1) for k in ("coarse", "fine"))

    def widened(self, width: int) -> Rows:
        """The same rows padded to a wider vector: their summaries are those of the padded one."""
        if width == self.width:
            return self
        return Rows(pack(self.at, self.id, self.label, np.pad(self.vector, ((0, 0), (0, width - self.width)))))


def summaries(vector: np.ndarray, segments: int) -> np.ndarray:
    """Mean and deviation of every segment: (2, rows, segments)."""
    parts = vector.reshape(len(vector), segments, -1).astype(np.float64)
    mean = parts.mean(2)
    return np.stack([mean, np.sqrt(((parts - mean[:, :, None]) ** 2).sum(2))]).astype(np.float32)


def pack(at: np.ndarray, ids: np.ndarray, labels: np.ndarray, vector: np.ndarray) -> dict:
    return {
        "block": int(at[0]), "n": len(at), "width": vector.shape[1], "ids": ids.astype(np.int64).tobytes(), "labels": labels.astype(np.int64).tobytes(), "vectors": narrow(vector.ravel()).tobytes(),
        "coarse": summaries(vector, COARSE).tobytes(), "fine": summaries(vector, FINE).tobytes(), "at": at.astype(np.int64).tobytes(),
    }


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Whole numbers of all rows, padded with zeros to a common width that both kinds of segments divide."""
    size = np.diff(column.offsets.to_numpy())
    width = max(FINE, -(-int(size.max(initial=0)) // FINE) * FINE)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy()
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, v) packed; ``at`` tells rows apart."""
    first = TaskContext.get().partitionId() << 33
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(lo, BLOCK_ROWS)
            ids = part.column(0).fill_null(int(LAST)).to_numpy(zero_copy_only=False)
            yield _batch([pack(np.arange(first, first + part.num_rows), ids, part.column(1).to_numpy(), _matrix(part.column(2)))])
            first += part.num_rows


ARROW_BLOCK = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), *((k, pa.binary()) for k in ("ids", "labels", "vectors", "coarse", "fine", "at"))])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, ARROW_BLOCK)


def _anchors(every: int, count: int):
    """Anchors of the blocks, one by one, dealt to ``count`` groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                r = Rows(row)
                mine = np.flatnonzero((r.id % every == 0) & (r.id != LAST))
                yield pa.record_batch({"a": pa.array((r.at[mine] * 0x9E3779B1 % 1000003 % count).astype(np.int32)), "at": r.at[mine], "id": r.id[mine], "label": r.label[mine], "v": pa.array(list(r.vector[mine]), pa.list_(pa.int64()))})

    return run


def _pack_anchors(key: tuple, table: pa.Table) -> pa.Table:
    table = table.combine_chunks().sort_by("at")
    vector = _matrix(table.column("v").combine_chunks())
    row = pack(*(table.column(c).to_numpy() for c in ("at", "id", "label")), vector)
    return pa.Table.from_batches([_batch([row | {"block": key[0].as_py()}])])


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two whole-number matrices."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64) if most < 2**53 else x @ y.T


def _bounded(a: Rows, ai: np.ndarray, r: Rows, ri: np.ndarray, useful) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, row, score)`` of the pairs that ``useful(anchor places, low, high)`` keeps after the coarse and the fine bounds. It gets matrices or flat arrays."""
    product = (a.vector[ai], r.vector[ri])
    if float(np.abs(product[0]).max(initial=0)) * float(np.abs(product[1]).max(initial=0)) * a.width >= 2**63:
        raise ValueError("inner products beyond 63 bits")
    length = lambda s, i: np.sqrt((s[0][i].astype(np.float64) ** 2 * (a.width / COARSE) + s[1][i].astype(np.float64) ** 2).sum(1))
    la, lr = length(a.coarse, ai) * SLACK, length(r.coarse, ri)
    mid = a.coarse[0][ai] @ r.coarse[0][ri].T * (a.width // COARSE)
    off = a.coarse[1][ai] @ r.coarse[1][ri].T + np.outer(la, lr) + 1e-3
    i, j = np.nonzero(useful(np.arange(len(ai))[:, None], mid - off, mid + off))
    if not len(i):
        return i, j, np.zeros(0, np.int64)
    dense = len(i) > DENSE * len(ai) * len(ri)
    pairs = lambda x, y, k: (x @ y.T)[i, j] if dense else np.concatenate([np.einsum("ij,ij->i", x[i[p : p + k]], y[j[p : p + k]]) for p in range(0, len(i), k)])
    mid = pairs(a.fine[0][ai], r.fine[0][ri], 1 << 16) * (a.width // FINE)
    off = pairs(a.fine[1][ai], r.fine[1][ri], 1 << 16) + la[i] * lr[j] + 1e-3
    keep = useful(i, mid - off, mid + off)
    i, j = i[keep], j[keep]
    if len(i) > DENSE * len(ai) * len(ri):
        return i, j, exact(*product)[i, j]
    k = 1 << 16
    return i, j, np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", product[0][i[p : p + k]], product[1][j[p : p + k]]) for p in range(0, len(i), k))])


class Best:
    """The best ``k`` rows of each of ``groups`` groups: highest scores, then smallest ids."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.group, self.score, self.id, self.at = (np.zeros(0, np.int64) for _ in range(4))
        #: A row must reach this score to be among them.
        self.least = np.full(groups, -np.inf)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        if not len(group):
            return
        g, s, i, a = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, ids), (self.at, at)))
        order = np.lexsort((a, i, -s, g))
        g = g[order]
        rank = np.arange(len(g)) - np.searchsorted(g, g)
        g, order, rank = (x[rank < self.k] for x in (g, order, rank))
        self.group, self.score, self.id, self.at = g, s[order], i[order], a[order]
        full = rank == self.k - 1
        self.least[self.group[full]] = self.score[full]


def _tables(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[Rows, Rows]]:
    a = Rows(anchors.slice(0, 1).to_pylist()[0])
    for i in range(rows.num_rows):
        r = Rows(rows.slice(i, 1).to_pylist()[0])
        width = max(a.width, r.width)
        yield a.widened(width), r.widened(width)


FOUND = "a int, anchor long, anchor_id long, n long, id long, at long, score long"


def _found(a_group: int, best: Best, anchor: np.ndarray, anchor_id: np.ndarray, n: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(np.full(len(best.id), a_group, np.int32)), "anchor": anchor, "anchor_id": anchor_id, "n": n, "id": best.id, "at": best.at, "score": best.score})


def _positives(k: int):
    """The best rows of the anchor's label that one task meets."""

    def run(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        best = None
        for a, r in _tables(anchors, rows) if anchors.num_rows else ():
            best = best or Best(a.n, k)
            for label in np.intersect1d(a.label, r.label):
                ai, ri = np.flatnonzero(a.label == label), np.flatnonzero(r.label == label)
                other = lambda i, ai=ai, ri=ri, a=a, r=r: a.at[ai[i]] != r.at[ri[None, :]]

                def useful(i, low, high, best=best, ai=ai, other=other):
                    if high.ndim == 1:
                        return high >= best.least[ai[i]]
                    ok = other(i)
                    least = best.least[ai]
                    if high.shape[1] > k:  # so many rows are at least as good as the k-th lower bound
                        sure = np.where(ok, low, -np.inf)
                        least = np.maximum(least, np.partition(sure, -k, axis=1)[:, -k])
                    return ok & (high >= least[:, None])

                i, j, score = _bounded(a, ai, r, ri, useful)
                keep = score >= best.least[ai[i]]
                best.add(ai[i[keep]], score[keep], r.id[ri[j[keep]]], r.at[ri[j[keep]]])
        if best is None:
            best, a = Best(0, k), None
        anchor, ids = (a.at[best.group], a.id[best.group]) if a is not None else (best.at, best.id)
        return _found(key[0].as_py(), best, anchor, ids, np.zeros(len(best.id), np.int64))

    return run


def _negatives(k: int):
    """The best rows of other labels within each positive's window that one task meets. The anchors come with their positives, packed: anchor, number and score."""

    def run(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        best, a, n = None, None, 0
        for a, r in _tables(anchors, rows) if anchors.num_rows else ():
            if best is None:
                row = anchors.slice(0, 1).to_pylist()[0]
                at, number, score = np.frombuffer(row["positives"], np.int64).reshape(3, -1)
                n = int(number.max()) + 1
                order = np.argsort(a.at)
                place = order[np.searchsorted(a.at[order], at)]
                # 50 * positive <= 100 * negative <= 95 * positive, without products that could overflow
                floor, ceiling = np.full((n, a.n), np.inf), np.full((n, a.n), -np.inf)
                floor[number, place], ceiling[number, place] = -(-score // 2), score - -(-score // 20)
                whole = np.full((2, n, a.n), 0, np.int64)
                whole[0, number, place], whole[1, number, place] = -(-score // 2), score - -(-score // 20)
                best = Best(a.n * n, k)

            def useful(i, low, high, best=best, a=a, r=r, n=n, floor=floor, ceiling=ceiling):
                flat = high.ndim == 1
                i = i if flat else slice(None)
                shape = (lambda x: x[i]) if flat else (lambda x: x[:, None])
                open_ = np.zeros(high.shape, bool)
                for p in range(n):
                    least = np.maximum(floor[p], best.least[p * a.n : (p + 1) * a.n])
                    open_ |= (high >= shape(least)) & (low <= shape(ceiling[p]))
                return open_ if flat else open_ & (a.label[:, None] != r.label[None, :])

            i, j, score = _bounded(a, np.arange(a.n), r, np.arange(r.n), useful)
            for p in range(n):
                keep = (score >= whole[0, p, i]) & (score <= whole[1, p, i]) & np.isfinite(floor[p, i]) & (score >= best.least[p * a.n + i])
                best.add(p * a.n + i[keep], score[keep], r.id[j[keep]], r.at[j[keep]])
        if best is None:
            best = Best(0, k)
            return _found(key[0].as_py(), best, best.at, best.id, best.id)
        anchor = best.group % a.n
        return _found(key[0].as_py(), best, a.at[anchor], a.id[anchor], best.group // a.n)

    return run


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group, numbered from 0."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "at")
    return found.withColumn("_rank", F.row_number().over(order) - 1).where(F.col("_rank") < k)


def mine(table: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. Anchors are the rows whose id is divisible by ``every``."""
    i, v = F.col(vec_id).cast("long"), F.col(embedding)
    usable = F.col(label).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    moved = F.when(i % 7 == 0, (F.col(label).cast("long") + 1) % 10).otherwise(F.col(label).cast("long"))
    rows = table.where(usable).select(i.alias("id"), moved.alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * 256)).alias("v"))
    blocks = materialize(rows.mapInArrow(_blocks, BLOCK))
    size = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    groups = max(1, -(-size.rows // (every * BLOCK_ANCHORS)))
    shards = max(1, -(-size.blocks // TASK_BLOCKS))
    dealt = blocks.mapInArrow(_anchors(every, groups), "a int, at long, id long, label long, v array<long>")
    anchors = materialize(dealt.groupBy("a").applyInArrow(_pack_anchors, BLOCK).withColumnRenamed("block", "a"))
    # each group of anchors meets each shard of rows
    right = blocks.select(F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int").alias("s"), "*").withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    spread = lambda df: df.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    met = lambda left, f: spread(left).withColumn("a", F.col("a").cast("int")).groupBy("a", "s").cogroup(right.groupBy("a", "s")).applyInArrow(f, FOUND)
    near = materialize(_ranked(met(anchors, _positives(positives)), ["anchor"], positives))
    # a block of anchors holds at most so many positives each
    wanted = near.where("score >= 0").groupBy("a").applyInArrow(_pack_positives, "a int, positives binary")
    far = met(anchors.join(wanted.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a")).drop("_a"), _negatives(negatives))
    best = _ranked(far, ["anchor", "n"], negatives)
    p = near.select(F.col("anchor").alias("_anchor"), F.col("_rank").cast("long").alias("_n"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = best.join(p, (F.col("anchor") == F.col("_anchor")) & (F.col("n") == F.col("_n")))
    known = lambda c: F.when(F.col(c) != int(LAST), F.col(c))
    return out.select("anchor_id", known("positive_id").alias("positive_id"), (F.col("_rank") + 1).cast("int").alias("rank"), known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _pack_positives(key: tuple, table: pa.Table) -> pa.Table:
    packed = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("anchor", "_rank", "score")]).tobytes()
    return pa.table({"a": pa.array([key[0].as_py()], pa.int32()), "positives": pa.array([packed], pa.binary())})
