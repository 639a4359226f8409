from pyspark.sql import functions as F

from earlywarn.operators import hourly
from earlywarn.sources import readers
from earlywarn.sources.views import observations
from earlywarn.streaming import jobs

DATA = "/root/testdata/sf0.001"


def test_stay_files(spark, tmp_path):
    for site, n in (("A", 3), ("B", 2)):
        folder = tmp_path / f"training_set{site}"
        folder.mkdir()
        for p in range(n):
            rows = ["|".join(readers.STAY_COLUMNS)]
            rows += ["|".join("NaN" if c == "HR" and h == 1 else str(h) if c == "ICULOS" else "0" if c == "SepsisLabel" else "1.5" for c in readers.STAY_COLUMNS) for h in (1, 2)]
            (folder / f"p{p}.psv").write_text("\n".join(rows) + "\n")
    long = readers.read_sites(spark, f"file://{tmp_path}")
    assert long.count() == 10 and long.where("HR is null").count() == 5
    assert readers.read_stays(spark, f"file://{tmp_path}/training_setA/*.psv", "A", 2).select("patient_id").distinct().count() == 2


def test_topic_round_trip(spark, tmp_path):
    o = observations(spark, DATA).select("encounter_id", "id", "value")
    readers.write_topic(o, f"file://{tmp_path}/t", "encounter_id")
    back = readers.read_topic(spark, f"file://{tmp_path}/t", "encounter_id long, id string, value double").select("value.*")
    assert back.exceptAll(o).count() == 0 and back.count() == o.count()


def test_streams_agree_with_batch(spark, tmp_path):
    obs = observations(spark, DATA).where("hour >= 1")
    path = f"file://{tmp_path}/obs"
    bounds = [r.seq for r in obs.select(F.percentile_approx("seq", F.array(F.lit(0.3), F.lit(0.6))).alias("q")).select(F.explode("q").alias("seq")).collect()]
    for i, (lo, hi) in enumerate(zip([-1, *bounds], [*bounds, 10**9], strict=True)):
        obs.where((F.col("seq") > lo) & (F.col("seq") <= hi)).coalesce(1).write.parquet(f"{path}/part={i}")
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")
    out = f"file://{tmp_path}/scores"
    q = jobs.score_batches(stream, f"file://{tmp_path}/store", lambda df, n: df.write.mode("append").parquet(out), f"{tmp_path}/cp")
    q.awaitTermination()
    got = spark.read.parquet(out).select("encounter_id", "hour").distinct()
    hours = hourly.stay_hours(obs)
    newest = hours.groupBy("encounter_id").agg(F.max("hour").alias("newest"))
    want = hours.join(newest, "encounter_id").where("hour < newest").select("encounter_id", "hour")
    assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0


def test_windowed_stream(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet")
    e.repartition(2).write.parquet(f"file://{tmp_path}/e")
    s = spark.readStream.schema(e.schema).parquet(f"file://{tmp_path}/e")
    q = jobs.throughput_stream(s).writeStream.outputMode("complete").format("memory").queryName("through").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) as n from through").first().n == e.count()
