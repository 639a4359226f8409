"""Registered queries against their SQL on the smallest tables. ``EARLYWARN_ALL=1`` compares every one."""

import os

import duckdb
import pytest

from earlywarn import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SHORT = ["B9_hl7_validate", "B12_hl7_dedupe_control_id", "B16_hl7_render", "C3_fhir_observations", "D2_classify_observations", "D5_densify_hours", "E8_news2_total", "E10_build_features", "E13_stay_outcomes", "F1_apply_policy", "G1_replay_workflow", "G6_census", "H1_auroc", "H4_utility", "H7_event_metrics", "H15_reliability", "J2_rejects_by_code", "J9_histogram_quantile", "J11_load_summary"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(v):
    return (0, "") if v is None else (1, repr(v) if isinstance(v, float) else str(v).replace(" 00:00:00", ""))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL) if os.environ.get("EARLYWARN_ALL") else SHORT)
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    cur = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == want


def test_uuid_is_version_5(spark):
    import uuid

    rows = registry.QUERIES["F5_alert_uuid5"](spark, DATA).limit(5).collect()
    assert rows
    for r in rows:
        assert r.alert_id == str(uuid.uuid5(uuid.UUID("7d5c6f2e-3a7b-4b8e-9f0d-2c1e6a5b4d30"), f"{r.encounter_id}/{r.hour}/news2"))


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
