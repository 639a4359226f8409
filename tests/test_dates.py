"""Search dates as a table, against the plain comparison of every row with every parameter."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from earlywarn.operators import dates, ward

PARAMS = [
    "2024", "ne2024-02", "lt2024-03-10", "le2024-03-10T02:30", "gt2024-03-10T02:30:15", "ge2024-03-10T02:30:15.25", "eq2024-03-10T02:30:15.250001", "2024-03-10T02:30+05:45",
    "ge2024-12-31T23:59:59-23:59", "le0001", "ge9999", "ne1969-12-31T23:59:59.9", "2024-02-29", "2024-03-10T02:30Z",
]
FAULTS = ["yesterday", "sa2024", "2024-13", "2023-02-29", "0000", "2024-03-10T02", "2024-03-10T02:30:60", "2024-03-10T24:00", "2024-03-10T02:30+24:00", "2024-3", "2024\n", "", "2024Z"]


def times():
    edges = [datetime(2024, 1, 1), datetime(2025, 1, 1), datetime(2024, 2, 1), datetime(2024, 3, 1), datetime(2024, 3, 10, 2, 30), datetime(2024, 3, 9, 20, 45), datetime(2024, 3, 10, 2, 30, 15, 250000), datetime(1970, 1, 1), datetime(2024, 2, 29), datetime(1, 1, 2), datetime(9999, 1, 1), datetime(2025, 1, 1, 23, 58, 59)]
    near = [e + timedelta(microseconds=d) for e in edges for d in (-1, 0, 1, 999_999, 60_000_000)]
    return near + [datetime(1900, 1, 1) + timedelta(seconds=i * 7_654_321, microseconds=i * 1237) for i in range(600)] + near[:3]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_join_is_the_plain_comparison(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [(i, t) for i, t in enumerate(times())] + [(-1, None)]
        table = spark.createDataFrame([(i, t and t.isoformat(sep=" ")) for i, t in rows], "id long, t string").select("id", F.col("t").cast("timestamp_ntz").alias("effective"))
        asked = spark.createDataFrame([(p,) for p in [*PARAMS, PARAMS[0], *FAULTS, None]], "param string")
        got = sorted((r.id, r.param) for r in dates.date_join(table, asked).select("id", "param").collect())
        test = {"eq": lambda t, a, b: a <= t < b, "ne": lambda t, a, b: not a <= t < b, "lt": lambda t, a, b: t < a, "le": lambda t, a, b: t < b, "gt": lambda t, a, b: t >= b, "ge": lambda t, a, b: t >= a}
        want = []
        for p in [*PARAMS, PARAMS[0]]:
            op, a, b = ward.date_interval(p)
            want += [(i, p) for i, t in rows if t and test[op](t, a, b)]
        assert got == sorted(want) and len(want) > 2000
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_faults(spark):
    asked = spark.createDataFrame([(p,) for p in [*FAULTS, None]], "param string")
    out = asked.select("param", dates.date_bounds(F.col("param")).alias("b")).collect()
    assert [r.param for r in out if r.b.error is None] == [None] and all(r.b.op is None and r.b.low is None for r in out)
    for p in FAULTS:
        with pytest.raises(ValueError, match="date"):
            ward.date_interval(p)


def test_join_by_equal_keys(spark):
    """No nested loops in the plan; clashing names and empty tables are fine."""
    table = spark.range(10).select("id", F.lit("2024-03-01").cast("timestamp_ntz").alias("param"))
    asked = spark.createDataFrame([("ge2024", 1), ("lt2024", 2)], "param string, id long")
    joined = dates.date_join(table, asked, "param")
    plan = joined._jdf.queryExecution().toString()
    assert joined.columns == ["id", "param", "param", "id"] and joined.count() == 10
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert dates.date_join(table.limit(0), asked, "param").count() == 0 == dates.date_join(table, asked.limit(0), "param").count()
