"""The stateful scorer: late and repeated records, timers, restarts, bounded state."""

import time

import pytest
from pyspark.sql import functions as F

from earlywarn.operators.evaluation import Policy
from earlywarn.streaming import scoring

ROWS = "encounter_id long, site string, id string, variable string, value double, effective string, hour long, seq long"
POLICIES = {"news2": Policy(5.0, 6.0, 2.0)}


def record(seq, hour, variable="HR", value=140.0, name=None, stay=1):
    return (stay, "A", name or f"r{seq}", variable, value, f"2024-01-01 {hour:02}:{seq % 60:02}:00", hour, seq)


def test_records_one_by_one():
    stay = scoring.Stay(None, 31)
    closer = scoring.HourCloser(POLICIES, 1.0, 31, lambda last: last.get("HR", 0.0))
    closer.policies = POLICIES | {"model": Policy(130.0)}
    assert stay.add("a", "HR", 1, "t1", 140.0) == "accepted"
    assert stay.add("a", "HR", 1, "t1", 140.0) == "duplicate"
    assert stay.add("b", "nothing", 1, "t1", 1.0) == "unknown_code" and stay.add("c", "HR", 0, "t0", 1.0) == "before_admission"
    assert stay.add("d", "Resp", 4, "t4", 30.0) == "accepted"
    rows = closer._closed((1, "A"), stay, 3, "later hour")
    assert [r["icu_hour"] for r in rows if r["kind"] == "score" and r["source"] == "news2"] == [1, 2, 3]
    assert [r["raw_score"] for r in rows if r["kind"] == "score" and r["source"] == "news2"] == [3.0] * 3
    assert [(r["icu_hour"], r["source"]) for r in rows if r["kind"] == "alert"] == [(1, "model")]
    # a late value is not scored again, but later hours see it; equal times go by id
    assert stay.add("e", "HR", 3, "t3", 100.0) == "late"
    assert stay.add("f", "HR", 3, "t3", 95.0) == "late" and stay.last_values(4) == {"HR": 95.0, "Resp": 30.0}
    again = scoring.Stay(stay.body(), 31)
    assert again.last_values(4) == stay.last_values(4) and again.alerts == stay.alerts and again.closed == 3


def test_state_does_not_grow():
    stay, sizes = scoring.Stay(None, 31), []
    for hour in range(1, 400):
        stay = scoring.Stay(stay.body(), 31)
        stay.add(f"r{hour}", "HR", hour, f"2024 {hour:04}", 80.0)
        stay.closed = hour - 1
        sizes.append(len(stay.body()))
    assert max(sizes[100:]) < 1.2 * sizes[60] and "2024 0360" < stay.said <= min(stay.times.values())


def test_points():
    assert scoring.points({}) == 0
    assert scoring.points({"HR": 131, "Resp": 25, "SBP": 90.4, "O2Sat": 91.4, "Temp": 39.1, "FiO2": 0.3}) == 3 + 3 + 3 + 3 + 2 + 2
    assert scoring.points({"HR": 90.49, "Resp": 20, "SBP": 111, "O2Sat": 96, "Temp": 38.04}) == 0


@pytest.mark.parametrize("timer", [False, True], ids=["records", "timer"])
def test_stream_with_a_restart(spark, tmp_path, timer):
    first = [record(1, 1), record(2, 1, "Resp", 30.0), record(3, 4), record(3, 4), record(4, 2, "SBP", 80.0), record(5, 1, stay=2)]
    second = [record(6, 5, "O2Sat", 85.0), record(3, 4), record(7, 7)]
    source, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    stream = lambda settle: scoring.score_stream(spark.readStream.schema(ROWS).parquet(source), POLICIES, settle_seconds=settle)
    for part in (first, second):
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(source)
        if timer and part is second:
            q = scoring.start(stream(0.5), out, checkpoint, seconds=0.5)
            until = time.time() + 60
            read = lambda: spark.read.schema(scoring.TAGGED).parquet(out).where("closed_by = 'timer' and kind = 'score'").count()
            while time.time() < until and (q.lastProgress is None or not read()):
                time.sleep(0.5)
            q.stop()
        else:
            q = scoring.start(stream(1e6 if not timer else 0.5), out, checkpoint)
            assert q.awaitTermination(90) in (True, None)
    rows = spark.read.schema(scoring.TAGGED).parquet(out)
    got = {(r.encounter_id, r.icu_hour): (r.raw_score, r.closed_by) for r in rows.where("kind = 'score'").collect()}
    assert rows.where("kind = 'score'").count() == len(got)  # each hour once
    # hour 2's pressure came after hour 4 had closed it; hours 4 and later see it
    want = {1: 6.0, 2: 6.0, 3: 6.0, 4: 9.0, 5: 12.0, 6: 12.0}
    assert {h: got[1, h][0] for h in want} == want and all(got[1, h][1] == "later hour" for h in (1, 2, 3, 4))
    assert sorted(r.icu_hour for r in rows.where("kind = 'alert' and encounter_id = 1").collect())[:3] == [1, 4, 5]
    assert rows.where("kind = 'alert'").select("alert_id").distinct().count() == rows.where("kind = 'alert'").count()
    outcomes = {r.outcome: r.n for r in rows.where("kind = 'outcome' and encounter_id = 1").groupBy("outcome").agg(F.sum("n").alias("n")).collect()}
    assert outcomes == {"accepted": 5, "duplicate": 2, "late": 1}
    if timer:
        assert got[1, 7][1] == "timer"
    else:
        assert (1, 7) not in got and (2, 1) not in got


def test_no_stretch_of_arrivals_is_one_task(spark, tmp_path):
    """A stretch is written by as many tasks as hold it, and no row of a later one comes before it."""
    rows = spark.createDataFrame([record(i, i % 7 + 1) for i in range(100)], ROWS).repartition(4)
    path, seen, before = f"{tmp_path}/in", set(), set()
    for i, _ in enumerate(scoring.arrivals(rows, path)):
        files = {str(p) for p in (tmp_path / "in").glob("*.parquet")}
        assert len(files - before) == 4
        new = {r.seq for r in spark.read.parquet(*(files - before)).collect()}
        assert new == set(range(25 * i, 25 * i + 25))
        seen, before = seen | new, files
    assert seen == set(range(100))
    assert len(list(scoring.arrivals(rows.limit(0), f"{tmp_path}/none"))) == 1
    assert scoring.replay(spark, rows.limit(0), f"{tmp_path}/empty", POLICIES).count() == 0
