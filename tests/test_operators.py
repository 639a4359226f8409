from datetime import datetime

import pytest
from pyspark.sql import functions as F

from earlywarn.functions.clinical import round_half_up
from earlywarn.operators import evaluation as ev
from earlywarn.operators import hl7, hourly, ward


def test_round_half_up(spark):
    r = spark.createDataFrame([(38.05, 36.5)], "t double, h double").select(round_half_up(F.col("t"), 1).alias("t"), round_half_up(F.col("h"), 0).cast("double").alias("h")).first()
    assert (r.t, r.h) == (38.1, 37.0)


def test_policy_refractory_and_rise(spark):
    scores = [5.0, 6.0, 7.0, None, 5.0, 4.0, 5.0, 5.0]
    df = spark.createDataFrame([(1, "A", h + 1, s) for h, s in enumerate(scores)], "encounter_id long, site string, hour long, score double")
    got = [r.alert for r in ev.apply_policy(df, ev.Policy(5.0, 6.0, 2.0)).orderBy("hour").collect()]
    assert got == [True, False, True, False, False, False, False, False]
    assert [r.alert for r in ev.apply_policy(df, ev.Policy(5.0)).orderBy("hour").collect()] == [True, False, False, False, False, False, True, False]


def test_gap_is_an_error(spark):
    df = spark.createDataFrame([(1, "A", 1), (1, "A", 3)], "encounter_id long, site string, hour long")
    assert hourly.hour_steps(df).count() == 1
    with pytest.raises(Exception, match="follow each other"):
        hourly.assert_hourly(df).collect()


def test_unescape(spark):
    df = spark.createDataFrame([("a\\F\\b",), ("plain",), ("a\\Q\\b",), ("open\\F",), ("\\X0D0A\\",), (None,)], "t string")
    got = [(r.u.text, r.u.error) for r in df.select(hl7.unescape(F.col("t")).alias("u")).collect()]
    bad = (None, "ESCAPE_SEQUENCE_INVALID")
    assert got == [("a|b", None), ("plain", None), bad, bad, ("\r\n", None), (None, None)]


def test_dtm(spark):
    texts = ["2024", "20240229", "20230229", "202402291314", "20240229131415.12+0130", "2024022913+1500", "x"]
    got = [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(hl7.parse_dtm(F.col("t")).alias("p")).collect()]
    assert [g.precision for g in got] == ["year", "day", None, "minute", "fraction", None, None]
    assert got[4].offset == 90 and got[1].ts == datetime(2024, 2, 29)
    assert [g.error is None for g in got] == [True, True, False, True, True, False, False]


def test_numbers(spark):
    texts = ["1", "+1.5", "-.5", "1.", "1e5", " 1", "", "."]
    assert [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(hl7.parse_nm(F.col("t")).alias("n")).collect()] == [1.0, 1.5, -0.5, 1.0, None, None, None, None]


def test_date_interval():
    assert ward.date_interval("ge1996-12") == ("ge", datetime(1996, 12, 1), datetime(1997, 1, 1))
    assert ward.date_interval("1996") == ("eq", datetime(1996, 1, 1), datetime(1997, 1, 1))
    with pytest.raises(ValueError, match="date parameter"):
        ward.date_interval("yesterday")


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "encounter_id long, site string, hour long, score double, label int")
    assert ev.apply_policy(empty, ev.Policy(5.0)).count() == 0
    assert ev.ranking(empty, "label", "score").first().auroc is None
