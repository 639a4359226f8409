"""Stored state merged by batches equals one batch; only touched buckets are written."""

import os

import pytest
from pyspark.sql import functions as F

from earlywarn.operators.store import Store

LOG = "id long, seq long, authoritative boolean, resource struct<v:string>, at long"


def rows(*given):
    return [(i, s, a, (v,), s * 10) for i, s, a, v in given]


def state(store):
    return {r.id: (r.seq, r.resource.v, r.updated_at) for r in store.read().collect()}


LOG_ROWS = rows(
    (1, 1, False, "result"), (1, 3, True, "admitted"), (1, 5, False, "result"), (1, 7, True, "admitted"), (1, 9, True, "gone"),
    (2, 2, False, "first"), (2, 4, False, "second"), (3, 6, True, "x"), (3, 8, True, "y"), (3, 10, True, "y"), (None, 11, True, "z"),
)


def test_overlapping_batches_and_a_replay_equal_one(spark, tmp_path):
    df = spark.createDataFrame(LOG_ROWS, LOG)
    one, many = Store(spark, f"{tmp_path}/one"), Store(spark, f"{tmp_path}/many")
    assert many.read() is None
    one.merge(df, 1)
    many.merge(df.where("seq <= 6"), 1)
    many.merge(df.where("seq between 3 and 9"), 2)
    assert many.merge(df.where("seq between 3 and 9"), 2) == []
    many.merge(df, 3)
    want = {1: (9, "gone", 90), 2: (4, "first", 20), 3: (10, "y", 80), None: (11, "z", 110)}
    assert state(one) == want and state(many) == want
    assert many.merge(df.limit(0), 4) == [] and state(many) == want


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", buckets=8)
    every = spark.range(400).select(F.col("id"), F.lit(1).cast("long").alias("seq"), F.lit(True).alias("authoritative"), F.struct(F.lit("a").alias("v")).alias("resource"), F.lit(1).cast("long").alias("at"))
    assert store.merge(every, 1) == list(range(8))
    before = {r.bucket: r.folder for r in store._log()}
    touched = store.merge(every.where("id = 7").withColumn("seq", F.lit(2).cast("long")).withColumn("resource", F.struct(F.lit("b").alias("v"))), 2)
    after = {r.bucket: r.folder for r in store._log()}
    assert len(touched) == 1 and {b for b in after if after[b] != before[b]} == set(touched)
    assert store.read().count() == 400 and state(store)[7] == (2, "b", 1)
    # what an attempt leaves that ends before the log is no part of the state
    os.makedirs(f"{tmp_path}/s/data/v3-lost/bucket=0")
    assert store.read().count() == 400


def test_a_failed_merge_changes_nothing(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", buckets=2)
    store.merge(spark.createDataFrame(LOG_ROWS, LOG), 1)
    before = state(store)
    bad = spark.createDataFrame(rows((1, 20, True, "late")), LOG).withColumn("at", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception):  # noqa: B017
        store.merge(bad, 2)
    assert state(store) == before
    assert store.merge(spark.createDataFrame(rows((1, 20, True, "late")), LOG), 2) and state(store)[1] == (20, "late", 200)


def test_merges_read_placed_rows_not_their_windows(spark, monkeypatch):
    """Each merge reads its rows twice, so the windows that place the log's rows are computed before, once."""
    from earlywarn.plans import ward_queries as wq

    plans, merge = [], Store.merge
    monkeypatch.setattr(Store, "merge", lambda self, updates, batch: (plans.append(updates._jdf.queryExecution().optimizedPlan().toString()), merge(self, updates, batch))[1])
    log = spark.createDataFrame(LOG_ROWS, LOG)
    got = {r.id: (r.seq, r.resource.v) for r in wq._stored(log).collect()}
    assert got == {1: (9, "gone"), 2: (4, "first"), 3: (10, "y"), None: (11, "z")}
    assert len(plans) == 4 and not any("Window" in p for p in plans)
