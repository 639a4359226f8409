"""Line dedup: what a posting and the joins move, and lines around the width of their parities."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_llm import later_by_brute_force

from earlywarn.llm import line_dedup, line_join
from earlywarn.llm import setjoin as sj
from earlywarn.llm import textkit as tk


def test_parities_never_rule_out_more_than_the_sets_differ():
    rng = np.random.default_rng(3)
    for size in (1, 5, 60, 64, 65, 130, 400):
        base = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        for swapped in (0, 1, size // 10, size // 2, size):
            other = np.unique(np.concatenate([base[swapped:], rng.integers(0, 1 << 63, swapped, np.uint64)]))
            p = sj.parities(np.concatenate([base, other]), np.array([len(base), len(other)]))
            low = int(np.bitwise_count(p[0, 0] ^ p[1, 0]))
            wide = int(np.bitwise_count(p[0, 1] ^ p[1, 1]) + np.bitwise_count(p[0, 0] ^ p[1, 0] ^ p[0, 1] ^ p[1, 1]))
            assert low <= wide <= len(np.setxor1d(base, other))


def test_packed_parities_come_back():
    rng = np.random.default_rng(4)
    blobs, want, n = [], [], []
    for m in (1, 7, 30, 2):
        size = rng.integers(line_join.LONG - 2, line_join.LONG + 3, m)
        halves = rng.integers(0, 1 << 63, (m, 2), np.uint64)
        blobs.append(line_join._pack_parities(np.column_stack([halves, size > line_join.LONG])).tobytes())
        halves[size <= line_join.LONG, 1] = 0
        want.append(halves)
        n.append(size)
    got = line_join._parities(pa.chunked_array([pa.array(blobs[:2], pa.binary()), pa.array(blobs[2:], pa.binary())]), np.concatenate(n))
    assert (got == np.concatenate(want)).all()


def test_bytes_of_a_posting(spark):
    """What is sent for each token of each line's prefix, in the form in which many ranges leave nothing to squeeze (32 bytes here with bitmaps of 128 bits)."""
    rng = random.Random(6)
    rows = [(d, "\n".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(40)) for _ in range(5))) for d in range(200)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    order = sj.Order(np.zeros(0, np.uint32), np.zeros(0, np.int64))
    posted = line_join._postings(df, sj.line_sets(1), order, 50, 4, 5)
    sent, count = posted.agg(F.sum(sum(F.octet_length(k) for k in line_join.POSTED)), F.sum(F.octet_length("k") / 8)).first()
    assert count > 8000 and sent / count < 28


def test_small_tables_are_dealt_to_all_cores():
    assert line_join._ranges(0, 6) == 1 and line_join._ranges(40_000, 6) == 1
    assert line_join._ranges(4_000_000, 6) == 24
    assert line_join._ranges(60_000_000, 6) == 100


def test_joins_leave_other_rows_where_they_are(spark):
    rows = spark.range(50_000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), F.col("id").cast("string").alias("text"))
    place = rows.where("id % 1000 = 7 or id is null").select(F.col("id").alias("_row"))
    left = sj.only(rows, "id", place, "_row")
    assert left.columns == rows.columns and left.where("id % 1000 = 7").count() == 50 and left.where("id is null").count() == 1
    assert left.count() < 200
    kept = sj.only(rows, "id", place, "_row", F.col("text") < "2")
    assert kept.where("text < '2'").count() == rows.where("text < '2'").count() and kept.where("id % 1000 = 7").count() == 50
    # nor do the texts without a wanted line move
    lines = sj.texts_of(rows, rows.where("id % 1000 = 7").select(F.col("id").alias("key"), F.col("id").alias("row"), F.lit(0).alias("part")), lines=True)
    assert sorted(r.key for r in lines.collect()) == list(range(7, 50_000, 1000))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "_bits" in plan


def test_lines_about_as_long_as_parities_by_brute_force(spark):
    """Lines of 50 to 150 words, many of them near the threshold, on both sides of the width."""
    rng = random.Random(9)
    bases = [[f"b{b}x{i}" for i in range(rng.choice((50, 60, 64, 65, 66, 72, 100, 150)))] for b in range(25)]
    rows = []
    for d in range(250):
        words = list(rng.choice(bases))
        for i in rng.sample(range(len(words)), rng.randrange(0, len(words) // 6 + 1)):
            words[i] = f"c{rng.randrange(400)}"
        del words[: rng.choice((0, 0, 1, 5))]
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.id: r.removed for r in line_dedup.later_lines(df).collect()}
    assert got == later_by_brute_force(rows) and 50 < len(got) < 250


def test_memory_of_a_full_range():
    """A range of ``RANGE_POSTINGS`` postings, as many as a task gets at any size: what its search holds besides them (107 MB when all columns were widened at once)."""
    rng, each, columns = np.random.default_rng(5), 20_000, {k: [] for k in line_join.POSTED}
    for lo in range(0, sj.RANGE_POSTINGS, each):
        n = rng.integers(5, 60, each)
        columns["h"].append(rng.integers(0, 100_000, each).astype(np.uint32).tobytes())
        columns["k"].append(rng.integers(0, 1 << 62, each).tobytes())
        for k, v in (("n", n), ("pos", n // 10), ("row", np.arange(lo, lo + each)), ("part", rng.integers(0, 50, each))):
            columns[k].append(tk.narrow(v).tobytes())
        columns["sig"].append(rng.integers(0, 1 << 63, each, np.uint64).tobytes())
    table = pa.table({k: pa.array(v, pa.binary()) for k, v in columns.items()})
    tracemalloc.start()
    out = line_join._search(4, 5)((pa.scalar(7),), table)
    held = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert out.num_columns == 5 and held < 90
