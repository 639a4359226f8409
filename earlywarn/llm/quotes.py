"""Quotation linking: conversations in reply order, without the quotes.

Every message is read line by line. Leading ``>`` marks (blanks between them allowed) give a line's quote level; a run of lines of one
level above 0 is a passage. A passage is normalised (marks, case of A-Z and white space folded) and hashed, and the hashes are joined to
the passages that messages of the same conversation wrote themselves: whole texts, their paragraphs, and every run of consecutive lines (blank
ones aside) that has as many lines as some quote of the conversation. The parent of a message is the latest earlier message that its outermost quotes repeat; without such a quote it is the message before it. Messages are
ordered so that replies follow their parents, depth first, ties by turn.

Defined cases: a null text is empty, so without quotes; a null conversation is a conversation of its own; repeated turns are told apart by
role and text, and fully equal rows share one place; quotes without a source stay unlinked (counted) and are taken out all the same; quotes of
later messages don't count; an empty table gives no rows; other columns are ignored.

Plan: one pass parses messages, in time linear in each text. Quoted passages and the passages of their conversations are joined on
(conversation, hash, text) as of the quoting message: each quote meets the latest earlier source only, so a line that many quote and many wrote
costs their sum. Digests of runs roll along a text, so a text costs its lines times the different lengths that its conversation quotes. What precedes a row (the message before, the source before, the sibling before) is found over range partitions with
one carried row a range, so no conversation is one task. Reply order is an Euler tour of the reply tree ranked by pointer doubling: two short
rows a message at any depth, and a number of even rounds that follows the logarithm of the largest conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earlywarn.llm.storage import materialize

MARK = re.compile(r"[ \t]*((?:>[ \t]*)+)")
BLANKS = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
QUOTES = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("lines", T.IntegerType()), T.StructField("run", T.StringType())]))
ARROW_QUOTES = pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string()), ("lines", pa.int32()), ("run", pa.string())]))

#: Digests of runs are polynomials of line digests modulo a prime of 127 bits.
PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.blake2b(b"runs of lines", digest_size=15).digest(), "big")
#: Rows of runs that a task holds before it sends them on.
SENT = 20_000


def normal(text: Column) -> Column:
    """Fold case of A-Z and white space."""
    return F.trim(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " "))


def line_values(text: str) -> list[int]:
    """A number for each normalised line of a text that is not blank."""
    lines = (BLANKS.sub(" ", x).strip(" ") for x in text.translate(LOWER).split("\n"))
    return [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=15).digest(), "big") for x in lines if x]


def runs_of(values: list[int], k: int) -> Iterator[str]:
    """The names of all runs of ``k`` consecutive lines, in order. No normalised text has a line break, so none is such a name."""
    leaving, digest = pow(BASE, k, PRIME), 0
    for i, v in enumerate(values):
        digest = (digest * BASE + v - (values[i - k] * leaving if i >= k else 0)) % PRIME
        if i >= k - 1:
            yield f"\n{k}:{digest:032x}"


def passages(text: str) -> tuple[list[dict], str]:
    """Quoted passages of a text (level, text) in order, and the text without its quoted lines, trimmed."""
    runs: list[tuple[int, list[str]]] = []
    own, level_before = [], 0
    for line in text.split("\n"):
        mark = MARK.match(line)
        level = mark[1].count(">") if mark else 0
        if not level:
            own.append(line)
        elif level == level_before:
            runs[-1][1].append(line[mark.end() :])
        else:
            runs.append((level, [line[mark.end() :]]))
        level_before = level
    quotes = []
    for level, lines in runs:
        values = line_values("\n".join(lines))
        quotes.append({"level": level, "text": "\n".join(lines), "lines": len(values), "run": next(runs_of(values, len(values)), None) if values else None})
    return quotes, "\n".join(own).strip(" ")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parsed = [passages(t or "") for t in batch.column("given").to_pylist()]
        arrays = [*batch.columns, pa.array([q for q, _ in parsed], ARROW_QUOTES), pa.array([t for _, t in parsed], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "quotes", "text"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``c, at, t``: the runs of each message's own lines, of the lengths asked."""
    for batch in batches:
        rows, names = [], []

        def sent(batch=batch, rows=rows, names=names) -> pa.RecordBatch:
            picked = pa.array(rows, pa.int64())
            out = pa.RecordBatch.from_arrays([batch.column("c").take(picked), batch.column("at").take(picked), pa.array(names, pa.string())], ["c", "at", "t"])
            rows.clear()
            names.clear()
            return out

        for i, (text, lengths) in enumerate(zip(batch.column("text").to_pylist(), batch.column("lengths").to_pylist(), strict=True)):
            values = line_values(text)
            for k in lengths:
                if k <= len(values):
                    for name in runs_of(values, k):
                        rows.append(i)
                        names.append(name)
                        if len(rows) >= SENT:
                            yield sent()
        yield sent()


def _before(df: DataFrame, group: list[str], order: list[str], **wanted: tuple) -> DataFrame:
    """``df`` with aggregates over the earlier rows of each row's group: ``name=("max" or "sum", column)``.

    Rows lie in range partitions by group and order. Each range sums up itself, and one row per range carries what the group at its head had before."""
    placed = materialize(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    of = {"max": F.max, "sum": F.sum}
    earlier = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    held = placed.groupBy("_part", *group).agg(*(of[how](c).alias(name) for name, (how, c) in wanted.items())).withColumn("_g", F.struct(*group))
    heads = held.groupBy("_part").agg(F.min("_g").alias("_g")).withColumn("_kind", F.lit(0))
    tails = held.groupBy("_part").agg(F.max("_g").alias("_g"), *(F.max_by(name, "_g").alias(name) for name in wanted)).withColumn("_kind", F.lit(1))
    carried = Window.partitionBy("_g").orderBy("_part", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    ranges = heads.unionByName(tails, allowMissingColumns=True)  # two rows per range partition
    ranges = ranges.select("_part", "_g", "_kind", *(of[how](name).over(carried).alias(f"_{name}") for name, (how, _) in wanted.items())).where("_kind = 0").drop("_kind")
    out = placed.select("*", *(of[how](c).over(earlier).alias(name) for name, (how, c) in wanted.items())).join(F.broadcast(ranges), "_part", "left")
    for name, (how, _) in wanted.items():
        carry = F.when(F.struct(*group).eqNullSafe(F.col("_g")), F.col(f"_{name}"))
        out = out.withColumn(name, F.greatest(name, carry) if how == "max" else F.coalesce(name, F.lit(0)) + F.coalesce(carry, F.lit(0)))
    return out.drop("_part", "_g", *(f"_{name}" for name in wanted))


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` (without quotes), ``n_quotes, n_linked, parent_turn, depth, position`` (1, 2, ... in reply order)."""
    given = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).cast("string").alias("given"))
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731  a null is told from an empty text
    parsed = given.mapInArrow(_parse, T.StructType([*given.schema.fields, T.StructField("quotes", QUOTES), T.StructField("text", T.StringType())]))
    parsed = parsed.withColumn("key", F.xxhash64(*(known(c) for c in ("conv_id", "turn", "role", "given")))).withColumn("c", known("conv_id")).drop("given")
    # repeated rows are one message of so many copies until the end
    one = parsed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first(F.struct("c", "conv_id", "turn", "role", "text", "quotes")).alias("m"))
    one = materialize(one.select("key", "copies", "m.*").withColumn("at", F.struct("turn", "key")))
    links = _links(one)
    places = _before(one.select("c", "key", "turn", "at"), ["c"], ["turn", "key"], previous=("max", F.col("at")), earlier=("sum", F.lit(1)))
    parent = F.coalesce("link", "previous")
    nodes = places.join(links, "key", "left").select("key", "c", "turn", "at", "earlier", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), parent.alias("parent"), F.col("link").isNotNull().alias("by_quote"))
    order = _ordered(materialize(nodes))
    every = one.withColumn("n_quotes", F.size("quotes").cast("long")).drop("quotes", "turn").join(order, "key").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return every.select("conv_id", F.col("at.turn").alias("turn"), "role", "text", "n_quotes", "n_linked", "parent_turn", "depth", "position")


def _links(one: DataFrame) -> DataFrame:
    """``key, n_linked, link``: of each message with linked quotes, how many, and the latest earlier source of the first outermost one."""
    read = one.where(F.size("quotes") > 0).select("c", "key", "at", F.posexplode("quotes").alias("n", "q"))
    # a quote is asked for as a text, however its lines are broken, and as a run of lines
    quoted = read.select("c", "key", "at", "n", F.col("q.level").alias("level"), F.explode(F.array_compact(F.array(normal(F.col("q.text")), F.col("q.run")))).alias("t")).withColumn("h", F.xxhash64("t")).withColumn("kind", F.lit(0))
    asked = read.groupBy("c").agg(F.array_compact(F.collect_set(F.when(F.col("q.lines") > 0, F.col("q.lines")))).alias("lengths"))  # as many as there are different lengths
    said = one.select("c", "at", "text").join(asked, "c")
    pieces = F.array_distinct(F.filter(F.transform(F.concat(F.array("text"), F.split("text", "\n{2,}"), F.split("text", "\n")), normal), lambda p: p != ""))
    runs = said.mapInArrow(_runs, T.StructType([said.schema["c"], said.schema["at"], T.StructField("t", T.StringType())]))
    sources = said.select("c", "at", F.explode(pieces).alias("t")).unionByName(runs).withColumn("h", F.xxhash64("t"))
    sources = sources.join(quoted.select("c", "h", "t").distinct(), ["c", "h", "t"], "left_semi").withColumn("kind", F.lit(1))
    events = quoted.unionByName(sources, allowMissingColumns=True)
    # a message's quotes come before what it wrote itself, so it is no source of its own
    found = _before(events, ["c", "h", "t"], ["at", "kind"], source=("max", F.when(F.col("kind") == 1, F.col("at")))).where((F.col("kind") == 0) & F.col("source").isNotNull())
    linked = found.groupBy("key", "n", "level").agg(F.max("source").alias("source"))
    return linked.groupBy("key").agg(F.count(F.lit(1)).alias("n_linked"), F.min_by("source", F.struct("level", "n")).alias("link"))


def _ordered(nodes: DataFrame) -> DataFrame:
    """``key, n_linked, parent_turn, depth, position``. Conversations without links are already in order; the others are ranked along the tour of their reply tree."""
    # a reply to the message just before it only lengthens a chain, so trees are needed where some message quotes
    branchy = nodes.where("by_quote").select("c").distinct()
    plain = nodes.join(branchy, "c", "left_anti").select("key", F.col("earlier").alias("depth"), (F.col("earlier") + 1).alias("position"))
    tree = nodes.join(branchy, "c", "left_semi").select("c", "key", "turn", "at", F.col("parent.key").alias("up"))
    last = tree.where("up is not null").groupBy("up").agg(F.max("at").alias("last")).select(F.col("up").alias("key"), F.col("last.key").alias("last"))
    tree = _before(tree, ["c", "up"], ["turn", "key"], sibling=("max", F.col("at"))).join(last, "key", "left")
    # the tour enters and leaves each message; what comes before a step is the end of the sibling before, or the parent's entry, or the last child's end
    prior = F.coalesce("sibling.key", "up")
    enter = F.struct(F.lit(False).alias("out"), prior.alias("prior"), F.when(prior.isNotNull(), F.col("sibling").isNotNull()).alias("prior_out"), F.lit(1).cast("long").alias("entered"), F.lit(1).cast("long").alias("open"))
    leave = F.struct(F.lit(True).alias("out"), F.coalesce("last", "key").alias("prior"), F.col("last").isNotNull().alias("prior_out"), F.lit(0).cast("long").alias("entered"), F.lit(-1).cast("long").alias("open"))
    tour = materialize(tree.select("key", F.explode(F.array(enter, leave)).alias("e")).select("key", "e.*"))
    while tour.where("prior is not null").limit(1).count():
        ahead = tour.select(F.col("key").alias("prior"), F.col("out").alias("prior_out"), F.col("prior").alias("p"), F.col("prior_out").alias("po"), F.col("entered").alias("e"), F.col("open").alias("o"))
        add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        tour = materialize(tour.join(ahead, ["prior", "prior_out"], "left").select("key", "out", F.col("p").alias("prior"), F.col("po").alias("prior_out"), add("entered", "e"), add("open", "o")))
    ranked = tour.where("not out").select("key", (F.col("open") - 1).alias("depth"), F.col("entered").alias("position"))
    return nodes.select("key", "n_linked", F.col("parent.turn").alias("parent_turn")).join(plain.unionByName(ranked), "key")


def conversations(linked: DataFrame) -> DataFrame:
    """One row per conversation: its messages in reply order. For conversations of ordinary length; a training sample holds one whole."""
    return linked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", "role", "text"))).alias("messages"))
