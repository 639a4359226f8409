"""The memory of accepted control ids, against a reader that takes one message after the other."""

import random

import pytest

from earlywarn.operators import hl7


def one_by_one(rows, memory):
    held, out = {}, {}
    for msg_id, _, control, digest, error in sorted(rows, key=lambda r: (r[1], r[0])):
        if error:
            out[msg_id] = ("rejected", error)
        elif control in held:
            out[msg_id] = ("retransmission", None) if held[control] == digest else ("rejected", "CONTROL_ID_DUPLICATE")
        else:
            out[msg_id] = ("accepted", None)
            held[control] = digest
            if len(held) > memory:
                del held[next(iter(held))]
    return out


@pytest.mark.parametrize("memory", [0, 1, 5, 40, 100_000])
def test_forgotten_ids_are_accepted_anew(spark, memory):
    rng = random.Random(memory)
    rows = []
    for i in range(600):
        control = "hot" if rng.random() < 0.33 else f"c{rng.randrange(90)}"
        rows.append((f"m{i}", i // 2, control, rng.choice("aaab"), "MRN_MISSING" if rng.random() < 0.1 else None))
    df = spark.createDataFrame(rows, "msg_id string, seq long, control_id string, digest string, error_code string").repartition(7)
    got = {r.msg_id: (r.disposition, r.error_code) for r in hl7.dedupe_control_ids(df, memory).collect()}
    assert got == one_by_one(rows, memory)


def test_no_messages(spark):
    df = spark.createDataFrame([], "msg_id string, seq long, control_id string, digest string, error_code string")
    assert hl7.dedupe_control_ids(df, 3).count() == 0 and hl7.dedupe_control_ids(df, 0).count() == 0


@pytest.mark.parametrize("memory", [100, 300, 500])
def test_sql_forgets_as_the_operator_does(spark, memory):
    """The SQL of the control id query once remembered every id for ever, whatever the memory."""
    import duckdb

    from earlywarn.plans import message_queries as mq

    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    want = con.execute(mq._FORGETFUL.format(memory=memory) + " SELECT * FROM decided").fetchall()
    rows = mq._repeated(spark, "/root/testdata/sf0.001")
    assert sorted((r.msg_id, r.disposition) for r in hl7.dedupe_control_ids(hl7.validate(rows), memory).collect()) == sorted(want)
