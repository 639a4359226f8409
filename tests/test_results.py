"""Results of messages: statuses, fallbacks, what is skipped and what is an error."""

from earlywarn.operators import fhir, hl7


def message(obx, obr="20240101120000", comp="^", rep="~"):
    return "\r".join([f"MSH|{comp}{rep}\\&|A|B|C|D|20240101||ORU{comp}R01|C 1|P|2.5", f"PID|1||MRN1{comp}x", "PV1|1|I" + "|" * 17 + "V1", f"OBR|1||||||{obr}", *obx])


def obx(n, status="F", code="8867-4^HR^LN", kind="NM", value="80", unit="/min", time="20240101130000"):
    return f"OBX|{n}|{kind}|{code}||{value}|{unit}|||||{status}|||{time}"


def test_statuses_and_fallbacks(spark):
    want = dict(zip("FCAUPRSIOXNDW", "final corrected amended final preliminary preliminary preliminary registered registered cancelled cancelled entered-in-error entered-in-error".split(), strict=True))
    rows = [(s, 1, message([obx(1, s)])) for s in want]
    rows += [("bare", 1, message([obx(1, time="", unit="")])), ("own", 1, message([obx(1, code="8867-4!HR!LN")], comp="!", rep="%"))]
    got = {r.msg_id: r for r in hl7.to_observations(spark.createDataFrame(rows, "msg_id string, seq long, raw string")).collect()}
    assert {k: got[k].status for k in want} == want
    assert got["bare"].unit == "/min" and got["bare"].effective.hour == 12 and got["F"].effective.hour == 13
    assert (got["own"].mrn, got["own"].code, got["own"].value, got["own"].id) == ("MRN1", "8867-4", 80.0, "C-1-1")


def test_what_is_skipped_is_no_error(spark):
    rows = [
        ("skipped", 1, message([obx(1, "Z", kind="ST"), obx(2, "Z", code="8867-4^HR^L"), obx(3, "Z", code="1-1^x^LN"), obx(4, "Z", value=""), obx(5)])), ("unmapped", 1, message([obx(1), obx(2, "Z")])),
        ("timeless", 1, message([obx(1, time="")], obr="")), ("skipped timeless", 1, message([obx(1, time="", kind="ST")], obr="")),
    ]
    df = spark.createDataFrame(rows, "msg_id string, seq long, raw string")
    assert {r.msg_id: r.error_code for r in fhir.conversion_errors(df).collect()} == {"unmapped": "RESULT_STATUS_UNMAPPED", "timeless": "OBSERVATION_TIME_MISSING"}
    assert {r.msg_id: r.skipped for r in hl7.skipped_results(df).collect()} == {"skipped": 4, "unmapped": 0, "timeless": 0, "skipped timeless": 1}
    assert [r.id for r in hl7.to_observations(df.where("msg_id = 'skipped'")).collect()] == ["C-1-5"]


def test_error_rules_are_evaluated_once(spark):
    """A filter on the error must not bring the rules, and the split fields below them, into the plan a second time."""
    df = spark.createDataFrame([("timeless", 1, message([obx(1, time="")], obr="")), ("fine", 2, message([obx(1)]))], "msg_id string, seq long, raw string")
    errors = fhir.conversion_errors(df.where("seq > 0"))
    for used in (errors, errors.select("msg_id", "error_code"), errors.where("error_code is not null")):
        assert used._jdf.queryExecution().optimizedPlan().toString().count("RESULT_STATUS_UNMAPPED") == 1
        assert [r.msg_id for r in used.collect()] == ["timeless"]
