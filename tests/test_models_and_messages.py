"""Hand values for messages, resources, captures, models and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from earlywarn.operators import evaluation as ev
from earlywarn.operators import fhir, hl7, models
from earlywarn.sources import readers
from earlywarn.streaming import jobs

ORU = "\r".join(["MSH|^~\\&|BED|A|EW|H|20240101120000||ORU^R01|C1|P|2.5.1", "PID|1||MRN1^^^HOSP^MR||FAM^GIV||19600229|F", "PV1|1|I|ICU^1^B||||||||||||||||V1", "OBR|1|||V|||20240101", "OBX|1|NM|8867-4^HR^LN||80|/min|||||F|||20240101120000+0130"])


def check(spark, raw):
    return hl7.validate(spark.createDataFrame([("m", 1, raw)], "msg_id string, seq long, raw string")).first()


@pytest.mark.parametrize(
    ("change", "error"),
    [
        (lambda m: m, None),
        (lambda m: m.replace("|", "#").replace("^", "*").replace("MSH#*~\\&", "MSH#*~\\&"), None),
        (lambda m: m.replace("OBX|1|NM|8867-4^HR^LN", "OBX|1|ZZ|8867-4^HR^LN"), "VALUE_TYPE_MISMATCH"),
        (lambda m: m.replace("8867-4^HR^LN", ""), "OBSERVATION_CODE_MISSING"),
        (lambda m: m.replace("|80|", "|8o|"), "VALUE_NOT_NUMERIC"),
        (lambda m: m.replace("19600229", "19610229"), "TIMESTAMP_INVALID"),
        (lambda m: m.replace("+0130", "+1290"), "TIMESTAMP_INVALID"),
        (lambda m: m.replace("PID|", "PIX|"), "SEGMENT_MISSING"),
    ],
)
def test_validation(spark, change, error):
    assert check(spark, change(ORU)).error_code == error


def test_times(spark):
    rows = [("20240229131415.12+0130",), ("20230229",), ("20240101+1290",), ("2024",), ("20240101120000.5",), ("",), ("202413",)]
    got = [r.p for r in spark.createDataFrame(rows, "t string").select(hl7.parse_dtm(F.col("t")).alias("p"), hl7.dtm_valid(F.col("t")).alias("v")).collect()]
    assert got[0].ts == datetime.datetime(2024, 2, 29, 13, 14, 15, 120000) and got[0].offset == 90 and got[0].precision == "fraction"
    assert [g.error is None for g in got] == [True, False, False, True, True, False, False]
    valid = [r.v for r in spark.createDataFrame(rows, "t string").select(hl7.dtm_valid(F.col("t")).alias("v")).collect()]
    assert valid == [True, False, False, True, True, False, False]


def test_warnings(spark):
    raw = ORU.replace("|80|", "|800|").replace("\r", "\n") + "|"
    got = hl7.warnings(spark.createDataFrame([("m", raw), ("n", ORU)], "msg_id string, raw string")).collect()
    assert [r.codes for r in got] == [["SEGMENT_TERMINATOR_NOT_CR", "TRAILING_SEPARATOR", "VALUE_IMPLAUSIBLE"], []]


def test_bundles(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        """{"entry": [{"resource": {"resourceType": "Patient", "name": [{"use": "maiden", "family": "X"}, {"use": "official", "family": "Lind12", "given": ["Ada3"]}], "identifier": [{"value": "9", "type": {"coding": [{"code": "MR"}]}}]}},
        {"resource": {"resourceType": "Observation", "category": [{"coding": [{"code": "vital-signs"}]}], "code": {"coding": [{"code": "85354-9"}]}, "effectiveDateTime": "2024-01-01T00:00:00Z",
        "component": [{"code": {"coding": [{"code": "8480-6"}]}, "valueQuantity": {"value": 120, "code": "mm[Hg]"}}]}}]}"""
    )
    (tmp_path / "hospitalInformation1.json").write_text('{"entry": []}')
    people, vitals = fhir.bundles(spark, str(tmp_path))
    assert [tuple(r) for r in people.collect()] == [("a.json", "9", "Lind", ["Ada"])]
    assert [(r.code, r.unit, r.value) for r in vitals.collect()] == [("8480-6", "mm[Hg]", 120.0)]


def test_capture(spark, tmp_path):
    (tmp_path / "c.bin").write_bytes(b"xx\x0bone\x1c\r\x0b\x1c\r\x0bpart\x0btwo\x1cyy\x0b" + b"z" * 50 + b"\x1c\r\x0bopen")
    rows = readers.scan_capture(spark, str(tmp_path), most=40, kept=4).orderBy("frame_no").collect()
    assert [(bytes(r.bytes), r.oversize, r.total_size, r.missing_trailer) for r in rows[:4]] == [(b"one", False, 3, False), (b"", False, 0, False), (b"two", False, 3, True), (b"zzzz", True, 50, False)]
    assert (rows[4].outside_bytes, rows[4].abandoned) == (4, 2)


def test_model(spark, tmp_path):
    names = ["HR_last", "Temp_last"]
    rows = spark.createDataFrame([(i % 20, "A", i // 20, float(60 + (i * 7) % 50) if i % 6 else None, 36.0 + (i * 3 % 40) / 10, int((i * 7) % 50 > 30)) for i in range(400)], "encounter_id int, site string, hour int, HR_last double, Temp_last double, label int")
    folds = rows.select("encounter_id", "site").distinct().withColumn("fold", (F.col("encounter_id") % 2).cast("int"))
    m, margins = models.fit_boosted(rows, names, folds, 2, 5, rate=0.5)
    assert margins.count() == 400
    auc = ev.ranking(margins, "label", "margin").first().auroc
    assert auc > 0.8
    x = models.contributions(m, rows).collect()
    assert all(abs(sum(r.factors) - r.margin) < 1e-9 for r in x)
    top = models.top_factors(models.contributions(m, rows), names).collect()
    assert all(f.contribution > 0 for r in top for f in r.top) and any(f.label == "Heart rate, latest" for r in top for f in r.top)
    a, b = models.fit_platt(margins)
    assert a > 0
    assert models.fit_platt(margins.where("label = 0")) == (1.0, 0.0)
    knots = models.fit_isotonic(margins)
    assert list(knots[1]) == sorted(knots[1])
    p = spark.createDataFrame([(-1e9,), (1e9,)], "m double").select(models.apply_isotonic(F.col("m"), ([0.0, 1.0], [0.2, 0.7])).alias("p")).collect()
    assert [r.p for r in p] == [0.2, 0.7]
    m.platt, m.knots = (a, b), knots
    models.write_bundle(m, f"{tmp_path}/b", version="v1")
    again, manifest = models.read_bundle(f"{tmp_path}/b")
    assert manifest["version"] == "v1" and [r.margin for r in models.predict_margin(again, rows).collect()] == [r.margin for r in models.predict_margin(m, rows).collect()]
    with pytest.raises(Exception):  # noqa: B017
        models.write_bundle(m, f"{tmp_path}/b")
    assert len(models.feature_labels()) == 164
    with pytest.raises(Exception):  # noqa: B017
        spark.createDataFrame([("nothing",)], "f string").select(models.label_columns(F.col("f"))[0].alias("l")).collect()


def test_curves_are_thinned(spark):
    df = spark.range(1000).select((F.col("id") % 2).cast("int").alias("label"), (F.col("id") * 1.5).alias("s"))
    n = {r.curve: r["count"] for r in ev.curves(df, "label", "s").groupBy("curve").count().collect()}
    want = len({round(i * 999 / 199) for i in range(200)})
    assert n == {"roc": want, "pr": want}


def test_running_sums(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), ((F.col("id") * 37) % 500).alias("v"))
    got = ev.running(df, ["g"], [F.col("v")], {"n": F.lit(1), "t": F.col("v")}).collect()
    seen = {}
    for r in sorted(got, key=lambda r: (r.g, r.v)):
        n, t = seen.get(r.g, (0, 0))
        seen[r.g] = n + 1, t + r.v
        assert (r.n, r.t) == seen[r.g]


def test_stream_of_messages(spark, tmp_path):
    bad = ORU.replace("C1", "C2").replace("||||V1", "||||")
    spark.createDataFrame([("a", 1, ORU), ("b", 2, bad), ("c", 3, "nothing")], "msg_id string, seq long, raw string").write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("msg_id string, seq long, raw string").json(f"{tmp_path}/in")
    jobs.convert_messages(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    read = lambda t: spark.read.parquet(f"{tmp_path}/out/{t}").collect()
    assert [r.mrn for r in read("patients")] == ["MRN1"] and [r.id for r in read("encounters")] == ["V1"] and [r.value for r in read("observations")] == [80.0]
    assert [(r.msg_id, r.error_code) for r in read("errors")] == [("b", "VISIT_NUMBER_MISSING")]


def test_features_that_do_not_vary_reach_no_tree(spark):
    """A constant feature, one never measured, and indicators of blanks that never or always hold are left out of the vector; factors keep the places of all names."""
    names = ["HR_last", "MAP_last", "Temp_last", "SBP_last", "Resp_last"]
    rows = spark.createDataFrame([(i % 20, "A", i // 20, float(60 + (i * 7) % 50) if i % 6 else None, None, 37.0, 120.0 if i % 4 else None, float(i % 9), int((i * 7) % 50 > 30)) for i in range(400)], "encounter_id int, site string, hour int, " + ", ".join(f"{n} double" for n in names) + ", label int")
    folds = rows.select("encounter_id", "site").distinct().withColumn("fold", (F.col("encounter_id") % 2).cast("int"))
    m, _ = models.fit_boosted(rows, names, folds, 2, 5, rate=0.5)
    assert m.used == [0, 4, 5, 8] and m.model.numFeatures == 4 and m.medians[1:4] == [0.0, 37.0, 120.0]
    x = models.contributions(m, rows).collect()
    assert all(len(r.factors) == 6 and r.factors[1] == r.factors[2] == 0.0 and abs(sum(r.factors) - r.margin) < 1e-9 for r in x)
    assert any(r.factors[0] for r in x)
    nothing, _ = models.fit_boosted(rows, ["MAP_last"], folds, 2, 2)
    assert nothing.used == [0] and len({r.margin for r in models.predict_margin(nothing, rows).collect()}) == 1
