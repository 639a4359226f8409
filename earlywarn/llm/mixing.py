"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets an expected number of copies, its source's target over its source's size. The whole part is certain; the fraction is
rounded by the pivotal method on words: two documents of a source meet, words move from one to the other in a random direction chosen so
that expectations stay, and one of the two becomes integral. The words taken by a source stay exactly on target until one fractional
document is left, so the final error is at most that one document.

Documents first meet in leaves of about ``LEAF`` documents of one source, dealt by a hash; each leaf passes on at most one fractional
document, and these meet in nodes of ``FAN_IN`` leaves, level by level, until one is left in each source (a reduction tree of tasks).

Random numbers are hashes of the seed, the level and the document, so reruns agree. Repeated rows are documents of their own, and equal
rows are interchangeable. Null texts have size 0 and, like empty ones, take nothing. A null source is a source of its own, sorted last. A
source without words has target 0. An empty table gives no rows. Names of other columns don't matter.

Plan: sizes are one scan; sources are one grouped sum, kept as a table; only (document, source, size) rows are shuffled, to leaves that a
hot source has many of. Levels above hold one row per leaf. Sources are joined to documents by broadcast only up to ``BROADCAST_SOURCES``
of them, beyond that by a salted join.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earlywarn.llm.storage import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
LEAF = 4096
FAN_IN = 256
SEED = 20240
BROADCAST_SOURCES = 100_000
SALTS = 64
BROADCAST_ROWS = 2_000_000


def word_count(text: str) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+", -1), "")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Target words of each source: ``share`` of all words by weight, none above ``most`` times its size, the excess reshared by weight."""
    order = sorted((s for s, _ in sizes), key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    size = dict(sizes)
    left, open_, out = share * sum(size.values()), list(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > most * size[s]]
        if not full:
            out |= {s: weight[s] * unit for s in open_}
            break
        for s in full:
            out[s] = most * size[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def _random(seed: int, ids: np.ndarray, others: np.ndarray) -> np.ndarray:
    from earlywarn.llm.textkit import mix

    x = mix(ids ^ mix(others + np.uint64(seed & 0xFFFFFFFF)))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivotal(size: np.ndarray, part: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Round fractions ``part`` of documents of ``size`` words in the given order, keeping the sum of size times part; at most one stays fractional."""
    part = part.astype(np.float64).copy()
    held = -1
    for i in range(len(part)):
        if size[i] == 0 or part[i] <= 0 or part[i] >= 1:
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min((1 - part[a]) * size[a], part[b] * size[b])  # words that can move from b to a
        down = min(part[a] * size[a], (1 - part[b]) * size[b])
        move = up if draw[i] * (up + down) < down else -down
        whole_a = move in ((1 - part[a]) * size[a], -part[a] * size[a])
        whole_b = move in (part[b] * size[b], -(1 - part[b]) * size[b])
        part[a] = (1.0 if move > 0 else 0.0) if whole_a else part[a] + move / size[a]
        part[b] = (0.0 if move > 0 else 1.0) if whole_b else part[b] - move / size[b]
        held = a if not whole_a else b if not whole_b else -1
    return part


def _node(level: int, seed: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["_key"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.lexsort((pdf["_size"].to_numpy(), key))
        pdf = pdf.iloc[order].reset_index(drop=True)
        key = key[order]
        draw = _random(seed + level, key, np.arange(len(key), dtype=np.uint64))
        part = pivotal(pdf["_size"].to_numpy(), pdf["_part"].to_numpy(), draw)
        open_ = np.flatnonzero((part > 0) & (part < 1) & (pdf["_size"].to_numpy() > 0))
        if last and len(open_):
            i = open_[0]
            u = _random(seed - 1, key[i : i + 1], np.zeros(1, np.uint64))[0]
            part[i] = 1.0 if u < part[i] else 0.0
        pdf["_part"] = part
        pdf["_source"] = pdf["_source"].astype(object)
        pdf["_group"] = pdf["_group"] // FAN_IN
        return pdf

    return run


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs``."""
    units = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size")))
    by_source = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")).collect()  # one row per source
    spark = docs.sparkSession
    goal = targets([(r.source, r.source_size) for r in by_source], weights, share, most)
    rows = [(r.source is None, r.source or "", r.source_size, float(goal[r.source]), max(1, math.ceil(r.docs / LEAF))) for r in by_source]
    table = spark.createDataFrame(rows, "_null boolean, _source string, source_size long, target double, _leaves long")
    out = units.withColumn("_null", F.col("source").isNull()).withColumn("_source", F.coalesce("source", F.lit("")))
    if len(rows) <= BROADCAST_SOURCES:
        out = out.join(F.broadcast(table), ["_null", "_source"])
    else:
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = out.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["_null", "_source", "_salt"]).drop("_salt")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-12)
    out = out.withColumn("_whole", whole.cast("int")).withColumn("_part", F.greatest(F.lit(0.0), F.when(rate - whole < 1e-12, 0.0).otherwise(rate - whole)))
    out = out.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id")).withColumn("_group", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), "_leaves"))
    work = out.select("doc_id", "_null", "_source", F.col("size").alias("_size"), "_whole", "_part", "_key", "_group", "source_size", "target")
    schema = T.StructType(work.schema.fields)
    level, leaves, done = 0, max([1, *(r[4] for r in rows)]), []
    fractional = (F.col("_part") > 0) & (F.col("_part") < 1) & (F.col("_size") > 0)
    while True:
        last = leaves == 1
        work = work.groupBy("_null", "_source", "_group").applyInPandas(_node(level, seed, last), schema)
        if last:
            done.append(work)
            break
        work = materialize(work)
        done.append(work.where(~fractional))
        work, leaves, level = work.where(fractional), math.ceil(leaves / FAN_IN), level + 1
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    copies = (F.col("_whole") + F.round("_part").cast("int")).cast("int")
    return every.select("doc_id", F.when(~F.col("_null"), F.col("_source")).alias("source"), F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"), (F.col("_size") * copies).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixture itself: the rows of ``docs`` as often as the mix takes them, with ``copy`` (1, 2, ...) as a last column.

    Both sides are numbered within a document id by size and source, so that repeated ids meet their own rows.
    """
    from pyspark.sql import Window

    names = [f"c{i}" for i in range(len(docs.columns))]
    i, t, s = (names[docs.columns.index(c)] for c in (doc_id, text, source))
    d = docs.toDF(*names).withColumn("_id", F.coalesce(F.col(i).cast("string"), F.lit("")))
    taken = materialize(mix(docs, doc_id, text, source, **options).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), "size", F.col("source").alias("_s"), "copies"))
    if taken.groupBy("_id").count().where("count > 1").limit(1).count():
        d = d.withColumn("_n", F.row_number().over(Window.partitionBy("_id").orderBy(word_count(t), F.col(s).cast("string"))))
        taken = taken.withColumn("_n", F.row_number().over(Window.partitionBy("_id").orderBy("size", "_s", "copies")))
        on = ["_id", "_n"]
    else:
        on = ["_id"]
    taken = taken.where("copies > 0").select(*on, "copies")
    both = d.join(F.broadcast(taken) if taken.count() <= BROADCAST_ROWS else taken, on)
    both = both.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies")))
    return both.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)), F.col("_copy").alias("copy"))
