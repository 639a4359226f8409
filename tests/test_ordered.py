"""Ranks over ranges with fixed bounds against a plain window."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from earlywarn.operators import evaluation as ev
from earlywarn.operators import ordered


@pytest.fixture(params=[(True, "64k"), (False, "64m")], ids=["adaptive", "static"])
def adaptive(spark, request):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.adaptive.enabled", str(request.param[0]).lower())
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", request.param[1])
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def test_two_million_numbers(spark, adaptive):
    df = spark.range(2_000_000).select(((F.col("id") * 48271) % 2_000_003).alias("v"), F.lit("x").alias("wide"))
    got = ordered.running(df, [], [F.col("v")], {"n": F.lit(1), "t": F.col("v")})
    # the values are 2 000 000 of 0..2 000 002, so ranks are known up to the three that are left out
    a = got.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("n").alias("ranks"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("t").alias("total"), F.max(F.abs(F.col("v") - F.col("n"))).alias("off"), F.corr("v", "n").alias("c")).first()
    assert (a.rows, a.ranks, a.low, a.high) == (2_000_000, 2_000_000, 1, 2_000_000) and a.off <= 3 and a.c > 0.9999999
    assert a.total == df.agg(F.sum("v")).first()[0]
    assert got.groupBy((F.col("n") % 7).alias("k")).count().agg(F.sum("count")).first()[0] == 2_000_000


def test_folds_keep_every_stay(spark, adaptive):
    stays = spark.range(50_000).select(F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("site"), F.col("id").alias("encounter_id"), (F.col("id") % 9 == 0).alias("septic"))
    out = ev.folds(stays)
    assert out.count() == 50_000 and out.select("encounter_id").distinct().count() == 50_000
    order = F.md5(F.concat_ws("/", F.lit("2019"), "site", F.col("encounter_id").cast("string")))
    plain = stays.withColumn("want", ((F.row_number().over(Window.partitionBy("septic").orderBy(order)) - 1) % 5).cast("int"))
    assert out.join(plain.select("encounter_id", "want"), "encounter_id").where("fold <> want").count() == 0
    assert {r.septic: r["count"] for r in out.groupBy("septic").count().collect()} == {True: 5556, False: 44444}


def test_ranking_equals_the_pair_count(spark, adaptive):
    n = 2_000_000
    df = spark.range(n).select(((F.col("id") * 48271) % 2_000_003).cast("double").alias("s"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    r = ev.ranking(df, "label", "s").first()
    # pairs from ranks by Spark's own global window, over positives only
    ranks = df.select("label", F.row_number().over(Window.orderBy("s")).alias("n")).where("label = 1").agg(F.sum("n").alias("r"), F.count(F.lit(1)).alias("p")).first()
    want = (ranks.r - ranks.p * (ranks.p + 1) / 2) / (ranks.p * (n - ranks.p))
    assert r.auroc == pytest.approx(want, abs=2e-9)


def test_ties_nulls_and_small_tables(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", None), ("a", 4), ("a", 4)], "g string, v int")
    got = sorted((str(r.g), r.n) for r in ordered.running(df, ["g"], [F.col("v")], {"n": F.lit(1)}, ranges=3).collect())
    assert got == [("None", 1), ("None", 2), ("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    assert ordered.running(df.limit(0), ["g"], [F.col("v")], {"n": F.lit(1)}).count() == 0


def test_scores_that_are_not_numbers_come_first(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 0), (1.0, 1), (None, 1)], "s double, label int")
    assert ev.ranking(df, "label", "s").first().auroc == 0.5


def test_quantiles_equal_percentile_without_a_window_over_all(spark):
    df = spark.range(20_000).select(((F.col("id") * 7919) % 20_011 / 7).alias("v"), (F.col("id") % 3).alias("g")).unionByName(spark.range(5000).select(F.lit(1000.0).alias("v"), F.lit(1).cast("long").alias("g")))
    at = [i / 399 for i in range(400)]
    want = df.agg(F.percentile("v", F.array(*map(F.lit, at)))).first()[0]
    got = {r.i: r.quantile for r in ordered.even_quantiles(df, "v", 400).collect()}
    assert len(got) == 400 and all(abs(got[i] - w) < 1e-6 for i, w in enumerate(want))
    x = ordered.at_ranks(df, ["g"], "v", {"mid": F.floor((F.col("n") - 1) / 2)})
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    for r in x.collect():
        values = sorted(v.v for v in df.where(F.col("g") == r.g).collect())
        assert (r.n, r.max, r.mid) == (len(values), values[-1], values[(len(values) - 1) // 2])
    assert ordered.even_quantiles(df.limit(0), "v", 400).count() == 0
    assert {r.quantile for r in ordered.even_quantiles(df.limit(1), "v", 5).collect()} == {df.first().v}


def test_weighted_percentiles(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (2.0, 1.0), (10.0, 1.0), (None, 5.0)], "v double, w double")
    got = {r.percent: r.result for r in ev.weighted_percentile(df, "v", "w", [0.0, 25.0, 50.0, 90.0, 100.0]).collect()}
    # positions: 1 at 8.333, 2 from 33.333 to 66.667, 10 at 91.667
    assert got[0.0] == 1.0 and got[50.0] == 2.0 and got[100.0] == 10.0
    assert got[25.0] == pytest.approx(1 + (25 - 100 / 12) / (100 / 3 - 100 / 12)) and got[90.0] == pytest.approx(2 + 8 * (90 - 200 / 3) / (1100 / 12 - 200 / 3))
