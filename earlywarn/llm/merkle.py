"""A Merkle manifest of a table: a ternary tree for each source, a tree over the sources, and a witness for every row.

Leaves are appended to their source's tree in the order of ids. An ``Appender`` holds the open subtrees of a stretch: every completed run of three closes a node, and at that
moment each of the three gets its siblings as an extension of the partial witness that all rows below it share. Stretches are aligned (``BLOCK`` leaves, a power of three),
so a full one is a subtree of the whole tree. Its root is appended in turn, as a leaf of the next tier, whose stretches are aligned too, until each source is one node; the
sources' nodes are the leaves of the last tree. A row's witness is its stretch's extensions followed by those of its stretch's root, tier by tier.

Plan: one narrow pass hashes the rows to slim ones (id, leaf, leaf of the altered text); their places come from running sums over ranges with fixed bounds, so a source of
any size is many ranges; they are dealt by (source, stretch) and appended as they stream by, sorted. A stretch becomes one packed row. Each further tier has 243 times fewer
rows. The upper witnesses then come down by joins of one row a stretch, and a last narrow pass unpacks rows, folds their witnesses and compares with the root.

Defined cases: a null in any column is ``-`` in the leaf, an empty text ``0:``; a null source is a source of its own, the first; null ids come first in their source; rows with
equal ids are ordered by their leaves, and repeated rows are leaves each; a null id is never altered; an empty table gives no rows; other columns are ignored; a text of any
length is hashed in the JVM and never travels.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.llm.storage import materialize
from earlywarn.operators.ordered import running

FAN_OUT = 3
#: Levels and leaves of an aligned stretch.
LEVELS = 5
BLOCK = FAN_OUT**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32


def combine(children: list[bytes]) -> bytes:
    """The digest of digests, which enter as lowercase hex text."""
    return sha256("".join(c.hex() for c in children).encode()).digest()


class Appender:
    """Appends aligned leaves and keeps the witnesses of all of them.

    ``total``: leaves of the whole tree that this stretch is part of, which tells where it ends. ``extensions[level][k]`` is what the witness of every leaf below node ``k``
    of that level gets when its run closes: its place, its number of siblings, and these."""

    def __init__(self, total: int, levels: int = LEVELS):
        self.open: list[list[bytes]] = []
        self.extensions: list[list[bytes]] = []
        while levels and total > 1:
            self.open.append([])
            self.extensions.append([])
            total, levels = -(-total // FAN_OUT), levels - 1
        self.root: bytes | None = None

    def append(self, node: bytes, level: int = 0) -> None:
        if level == len(self.open):
            self.root = node
            return
        run = self.open[level]
        run.append(node)
        if len(run) == FAN_OUT:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        for at in range(len(run)):
            self.extensions[level].append(bytes((at, len(run) - 1)) + b"".join(run[:at] + run[at + 1 :]))
        self.append(combine(run), level + 1)

    def finish(self) -> bytes:
        """Close what is open, lowest first, and return the root."""
        for level in range(len(self.open)):
            if self.open[level]:
                self._close(level)
        return self.root

    def witness(self, leaf: int) -> bytes:
        out = []
        for of_level in self.extensions:
            out.append(of_level[leaf])
            leaf //= FAN_OUT
        return b"".join(out)


def steps(witness: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """The place and the siblings of each level, lowest first."""
    at = 0
    while at < len(witness):
        place, n = witness[at], witness[at + 1]
        at += 2
        yield place, [witness[at + DIGEST * i : at + DIGEST * (i + 1)] for i in range(n)]
        at += DIGEST * n


def fold(leaf: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness give."""
    for place, others in steps(witness):
        leaf = combine([*others[:place], leaf, *others[place:]])
    return leaf


def proof_digest(witness: bytes) -> str:
    return sha256("".join(s.hex() for _, others in steps(witness) for s in others).encode()).hexdigest()


def leaf_digest(columns: dict[str, Column]) -> Column:
    """SHA-256 of all columns, each ``-`` or its length in UTF-8 bytes, a colon and its value."""

    def part(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.sha2(F.concat(*(part(c) for c in columns.values())), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``tree, source, doc_id, leaf, altered`` (binary; null where nothing is altered): the altered leaf is that of the text without its line breaks, for ids whose CRC-32 is even."""
    of = {c: F.col(c) for c in COLUMNS}
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    bare = leaf_digest(of | {"text": F.translate("text", "\n", "")})
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null first, then by bytes
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf_digest(of)).alias("leaf"), F.when(even & F.contains("text", F.lit("\n")), F.unhex(bare)).alias("altered"))


STRETCH = "tree string, stretch long, root binary, total long, leaves int, ids binary, known binary, nodes binary, altered binary, extensions array<binary>, sizes array<binary>"


def _appended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree, stretch, total, doc_id, leaf, altered), sorted by tree, stretch and place, as one packed row for each stretch. The first row of a stretch only tells the total."""
    names = [c.split()[0] for c in STRETCH.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]
    key, held = None, ([], [], [])
    packed: list[tuple] = []

    def pack() -> tuple:
        (tree, stretch, total), (ids, nodes, altered) = key, held
        tree_of = Appender(total)
        for node in nodes:
            tree_of.append(node)
        root = tree_of.finish()
        flat = [b"".join(e) for e in tree_of.extensions]
        sizes = [np.array([len(x) for x in e], np.uint8).tobytes() for e in tree_of.extensions]
        known = np.array([i is not None for i in ids], bool)
        numbers = np.array([i or 0 for i in ids], np.int64)
        return tree, stretch, root, total, len(nodes), numbers.tobytes(), known.tobytes(), b"".join(nodes), b"".join(a or bytes(DIGEST) for a in altered), flat, sizes

    def flush() -> pa.RecordBatch:
        columns = list(zip(*packed, strict=True))
        packed.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for tree, stretch, total, doc_id, leaf, altered in zip(*(batch.column(c).to_pylist() for c in ("tree", "stretch", "total", "doc_id", "leaf", "altered")), strict=True):
            if total is not None:
                if key is not None:
                    packed.append(pack())
                    if len(packed) == 16:
                        yield flush()
                key, held = (tree, stretch, total), ([], [], [])
                continue
            held[0].append(doc_id)
            held[1].append(leaf)
            held[2].append(altered)
    if key is not None:
        packed.append(pack())
    if packed:
        yield flush()


def _append(nodes: DataFrame) -> DataFrame:
    """Append nodes (tree, place from 0, doc_id, leaf, altered) and write a packed row for each stretch.

    A tree's total comes to its stretches as a row ahead of each, so a tree of any size meets no join."""
    totals = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("total"))
    ahead = totals.select("tree", "total", F.lit(-1).cast("long").alias("place"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / BLOCK).cast("long"))).alias("stretch"))
    every = nodes.withColumn("stretch", F.floor(F.col("place") / BLOCK).cast("long")).unionByName(ahead, allowMissingColumns=True)
    dealt = every.repartition("tree", "stretch").sortWithinPartitions("tree", "stretch", "place")
    return materialize(dealt.select("tree", "stretch", "total", "doc_id", "leaf", "altered").mapInArrow(_appended, STRETCH))


def _unpack(row: dict) -> Iterator[tuple[int, bytes, bytes]]:
    """``(number in the stretch, node, witness within the stretch)``."""
    levels = []
    for flat, sizes in zip(row["extensions"], row["sizes"], strict=True):
        ends = np.cumsum(np.frombuffer(sizes, np.uint8).astype(np.int64)).tolist()
        levels.append([flat[a:b] for a, b in zip([0, *ends], ends, strict=False)])
    for i in range(row["leaves"]):
        at, out = i, []
        for level in levels:
            out.append(level[at])
            at //= FAN_OUT
        yield i, row["nodes"][DIGEST * i : DIGEST * (i + 1)], b"".join(out)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):  # a row holds a stretch
        yield batch.slice(i, 1).to_pylist()[0]


def _witnesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of an upper tier: their tree, their place, which is the number of a stretch below, and their witness within the stretch."""
    for batch in batches:
        tree, place, stretch, witness = [], [], [], []
        for row in _rows(batch):
            for i, _, w in _unpack(row):
                tree.append(row["tree"])
                place.append(row["stretch"] * BLOCK + i)
                stretch.append(row["stretch"])
                witness.append(w)
        yield pa.RecordBatch.from_arrays([pa.array(tree, pa.string()), pa.array(place, pa.int64()), pa.array(stretch, pa.int64()), pa.array(witness, pa.binary())], names=["tree", "place", "stretch", "witness"])


MANIFEST = "tree string, doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of packed stretches with what comes from above (upper, subroot, root): each row's leaf is folded with its witness."""
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    for batch in batches:
        for row in _rows(batch):
            upper, root, rows = row["upper"], row["top"], row["leaves"]
            ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=~np.frombuffer(row["known"], bool))
            out: tuple[list, ...] = ([], [], [], [])
            for i, node, w in _unpack(row):
                w += upper
                other = row["altered"][DIGEST * i : DIGEST * (i + 1)]
                got = fold(other if any(other) else node, w)
                for column, value in zip(out, (node.hex(), proof_digest(w), got.hex(), got == root), strict=True):
                    column.append(value)
            leaf, proof, folded, same = out
            text = lambda v: pa.array([v] * rows, pa.string())
            yield pa.RecordBatch.from_arrays([text(row["tree"]), ids, pa.array(leaf, pa.string()), text(row["subroot"].hex()), text(root.hex()), pa.array(proof, pa.string()), pa.array(folded, pa.string()), pa.array(same, pa.bool_())], names=names)


def _node(tree: str, place: str, leaf: str) -> list[Column]:
    """The columns of a node that is no row of the table."""
    return [F.col(tree).alias("tree"), F.col(place).alias("place"), F.lit(None).cast("long").alias("doc_id"), F.col(leaf).alias("leaf"), F.lit(None).cast("binary").alias("altered")]


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """All tiers over nodes (tree, place, doc_id, leaf, altered), the lowest first, until each tree is one stretch."""
    tiers = [_append(nodes)]
    most = tiers[0].agg(F.coalesce(F.max("stretch"), F.lit(0))).first()[0] + 1
    while most > 1:
        tiers.append(_append(tiers[-1].select(*_node("tree", "stretch", "root"))))
        most = -(-most // BLOCK)
    return tiers


def _placed(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """Nodes with their place in their tree, from 0."""
    return running(nodes, ["tree"], order, {"place": F.lit(1)}).withColumn("place", F.col("place").cast("long") - 1)


def _down(tiers: list[DataFrame], top: DataFrame) -> DataFrame:
    """``tree, stretch, upper, subroot, top`` of each stretch of the lowest tier: the witness of its root. ``top`` (tree, upper, subroot, top) holds that of each tree."""
    known = tiers[-1].select("tree", "stretch").join(top, "tree")
    for tier in reversed(tiers[1:]):
        inside = tier.mapInArrow(_witnesses, "tree string, place long, stretch long, witness binary")
        joined = inside.join(known, ["tree", "stretch"])
        known = joined.select("tree", F.col("place").alias("stretch"), F.concat("witness", "upper").alias("upper"), "subroot", "top")
    return materialize(known)


def manifest(docs: DataFrame) -> DataFrame:
    """``source, doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``docs`` (doc_id, source, lang, n_chars, text)."""
    rows = materialize(leaves(docs).withColumn("row", F.monotonically_increasing_id()))
    tiers = _tiers(_placed(rows, [F.col("doc_id"), F.col("leaf"), F.col("row")]).drop("row"))
    # the top tier of every tree is one stretch, and its root is the source's
    subroots = materialize(tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("leaf")))
    numbered = materialize(_placed(subroots, [F.col("source")]))
    sources = _tiers(numbered.select(*_node("tree", "place", "leaf")))
    root = sources[-1].select("tree", F.lit(b"").alias("upper"), F.col("root").alias("subroot"), F.col("root").alias("top"))
    above = _down(sources, root)
    inside = sources[0].mapInArrow(_witnesses, "tree string, place long, stretch long, witness binary").join(above, ["tree", "stretch"])
    by_source = numbered.select("place", F.col("source").alias("of"), "leaf").join(inside, "place")
    top = materialize(by_source.select(F.col("of").alias("tree"), F.concat("witness", "upper").alias("upper"), F.col("leaf").alias("subroot"), "top"))
    full = tiers[0].join(_down(tiers, top), ["tree", "stretch"]).select("tree", "leaves", "ids", "known", "nodes", "altered", "extensions", "sizes", "upper", "subroot", "top")
    out = full.mapInArrow(_verified, MANIFEST)
    return out.select(F.when(F.col("tree") != "", F.substr("tree", F.lit(2))).alias("source"), *[c.split()[0] for c in MANIFEST.split(", ")[1:]])
