"""Work that once grew faster than it must: inputs read again and again, rows grouped that were never apart, tasks whose number was fixed."""

from pyspark.sql import functions as F

from earlywarn.operators import evaluation as ev
from earlywarn.operators import hl7, ordered


def counted(spark, df):
    """``df`` and the number of its rows that were computed."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for x in batches:
            seen.add(len(x))
            yield x

    return df.coalesce(1).mapInPandas(run, df.schema), seen


def test_bootstrap_reads_its_stays_once(spark, monkeypatch):
    k = F.col("id")
    df = spark.range(200).select(k.alias("encounter_id"), F.lit("A").alias("site"), (k % 17 == 0).alias("excluded"), (k % 3 == 0).alias("septic"), (k % 6 == 0).alias("detected"), (k % 5).alias("alerts"), (k % 40 + 1).alias("hours"))
    stays, seen = counted(spark, df)
    got = sorted(ev.bootstrap(stays, 30).collect())
    assert seen.value == 200 and len(got) == 2
    monkeypatch.setattr(ev, "BROADCAST", 10)
    assert sorted(ev.bootstrap(df, 30).collect()) == got


def test_threshold_search_reads_outcomes_once(spark):
    k = F.col("id")
    scored = spark.range(800).select((k % 20).alias("encounter_id"), F.lit("A").alias("site"), (k / 20).cast("int").alias("hour"), (k * 37 % 101 / 10).alias("score"))
    septic = k % 3 == 0
    outcomes, seen = counted(spark, spark.range(20).select(k.alias("encounter_id"), F.lit("A").alias("site"), septic.alias("septic"), septic.alias("onset_known"), F.when(septic, 30).alias("onset_hour")))
    assert ev.search_thresholds(scored, outcomes, sensitivity=0.8, candidates=50).count() == 1
    assert seen.value == 20


def test_segments_of_a_message_are_not_shuffled(spark):
    msgs = spark.createDataFrame([("a", "MSH|^~\\&|X\rPID|1||M1\r\rOBX|1\nOBX|2"), ("b", "MSH#^~\\&#X\rPV1#1|2#3"), ("c", ""), ("d", None)], "msg_id string, raw string")
    whole = hl7.message_segments(msgs)
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    flat = sorted((r.msg_id, r.pos, r.id, r.fields) for r in hl7.segments(msgs).collect())
    assert sorted((r.msg_id, i + 1, s.id, s.fields) for r in whole.collect() for i, s in enumerate(r.segments)) == flat and len(flat) == 6


def test_ranges_are_tasks(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("v"))
    got = ordered.running(df, [], [F.col("v")], {"n": F.lit(1)}, 40)
    parts = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()
    assert len(parts) > 12 and max(r.c for r in parts) < 4000 and got.agg(F.count_distinct("n")).first()[0] == 20_000
