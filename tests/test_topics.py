"""Topics keep the order within a key, through files, batches and streams."""

import json
import random
from pathlib import Path

from pyspark.sql import functions as F

from earlywarn.sources import readers

SCHEMA = "id long, at long"


def rows(n, seed):
    """A third of all rows under one key, a third without a key; times tie and rows repeat."""
    draw = random.Random(seed)
    out = [(i // 2 * 2 if i % 10 == 0 else i, [None, "hot", f"k{i % 7}"][i % 3], draw.randint(0, n // 4)) for i in range(n)]
    draw.shuffle(out)
    return out


def by_key(found):
    out = {}
    for k, place, i in sorted(found, key=lambda r: (r[0] or "", r[1])):
        out.setdefault(k, []).append(i)
    return out


def test_order_within_keys(spark, tmp_path):
    given = rows(3000, 1)
    df = spark.createDataFrame(given, "id long, k string, at long").repartition(5)
    path = f"file://{tmp_path}/t"
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # else files this small are put together
    try:
        readers.write_topic(df, path, "k", ("at", "id"))
    finally:
        spark.conf.unset(coalesce)
    readers.write_topic(df.where("id < 100"), path, "k", ("id",))  # a second batch comes after
    back = readers.read_topic_places(spark, path, SCHEMA).select("key", F.struct("batch", "offset").alias("place"), F.col("value.id").alias("id"))
    want = {k: [i for i, x, at in sorted(given, key=lambda r: (r[2], r[0])) if x == k] + sorted(i for i, x, _ in given if x == k and i < 100) for k in {r[1] for r in given}}
    assert by_key([(r.key, tuple(r.place), r.id) for r in back.collect()]) == want
    # within and across the files of a batch, lines are in order; the hot key is not one file
    first = min(Path(tmp_path, "t").glob("batch=*"))
    files = [[json.loads(x) for x in f.read_text().splitlines()] for f in sorted(first.glob("part-*"))]
    lines = [(x.get("key") or "", x["offset"]) for f in files for x in f]
    assert lines == sorted(lines) and len(lines) == 3000
    assert sum(any(x.get("key") == "hot" for x in f) for f in files) > 1
    assert readers.read_topic(spark, path, SCHEMA).count() == back.count()


def test_streamed_batches(spark, tmp_path):
    parts = [rows(200, s) for s in range(3)]
    for i, p in enumerate(parts):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"id": a + 1000 * i, "k": k, "at": t}) for a, k, t in p))
    path, checkpoint = f"file://{tmp_path}/t", f"file://{tmp_path}/cp"
    stream = spark.readStream.schema("id long, k string, at long").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    for _ in range(2):  # a restart adds nothing
        readers.write_topic_stream(stream, path, "k", ("at", "id"), checkpoint, availableNow=True).awaitTermination()
    found = readers.read_topic_places(spark, path, SCHEMA)
    assert found.count() == 600 and found.select("batch").distinct().count() == 3
    again = spark.createDataFrame(parts[0], "id long, k string, at long")
    readers.write_topic(again, path, "k", ("at", "id"), batch=0)  # a batch that runs again replaces itself
    assert readers.read_topic_places(spark, path, SCHEMA).count() == 600
    for b in range(3):
        got = by_key([(r.key, r.offset, (r.at, r.id)) for r in readers.read_topic_places(spark, path, SCHEMA).where(f"batch = {b}").select("key", "offset", "value.at", "value.id").collect()])
        assert all(v == sorted(v) for v in got.values()) and sum(map(len, got.values())) == 200


def test_empty_topic(spark, tmp_path):
    readers.write_topic(spark.createDataFrame([], "id long, k string, at long"), f"file://{tmp_path}/t", "k", ("at",), batch=1)
    assert not [x for f in Path(tmp_path, "t", "batch=1").glob("part-*") for x in f.read_text().splitlines()]
