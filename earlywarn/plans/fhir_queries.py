"""Resources of messages that the order table gives, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from earlywarn.operators import fhir
from earlywarn.sources.views import LOINC, OBS_SQL, observations, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def admissions(spark, d):
    """One admission or discharge for each order, some with parts missing: ``msg_id, raw``."""
    k = F.col("o_orderkey")
    stamp = F.date_format("o_orderdate", "yyyyMMdd")
    sex = F.get(F.array(*(F.lit(x) for x in "FMOUANX")), (k % 7).cast("int"))
    birth = F.when(k % 3 == 0, F.substring(stamp, 1, 4)).when(k % 3 == 1, F.substring(stamp, 1, 6)).otherwise(stamp)
    trigger = F.when(F.col("o_orderstatus") == "F", "A03").otherwise("A01")
    pid = F.concat(F.lit("PID|1||MRN "), F.col("o_custkey").cast("string"), F.lit("^^^HOSP^MR||FAM"), F.col("o_custkey").cast("string"), F.lit("^"), F.when(k % 2 == 0, "GIVEN").otherwise(""), F.lit("^MID||"), birth, F.lit("|"), sex, F.lit("|||"), F.when(k % 5 == 0, F.lit("^^")).otherwise(F.concat(F.lit("STREET "), F.col("o_custkey").cast("string"), F.lit("^^TOWN"))))
    visit = F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("V"), k.cast("string")))
    end = F.when(k % 17 == 0, "20241350").when(F.col("o_orderstatus") == "F", F.concat(stamp, F.lit("1830"))).otherwise("")
    pv1 = F.concat(F.lit("PV1|1|I|ICU^"), (k % 40).cast("string"), F.lit("||||||||||||||||"), visit, F.repeat(F.lit("|"), F.lit(25)), stamp, F.lit("0800|"), end)
    head = F.concat(F.lit("MSH|^~\\&|ADT|SITE|EW|HOSP|"), stamp, F.lit("||ADT^"), trigger, F.lit("|M"), k.cast("string"), F.lit("|P|2.5.1"))
    lines = F.array(head, F.concat(F.lit("EVN||"), stamp), F.when(k % 13 != 0, pid), F.when(k % 19 != 0, pv1))
    return table(spark, d, "orders").select(k.alias("msg_id"), k.alias("seq"), F.array_join(F.array_compact(lines), "\r").alias("raw"))


@query(
    "C1_fhir_patient",
    """SELECT o_orderkey AS msg_id, 'MRN-' || o_custkey AS id, 'MRN ' || o_custkey AS mrn, 'FAM' || o_custkey AS family, CASE WHEN o_orderkey % 2 = 0 THEN 'GIVEN MID' ELSE 'MID' END AS given,
CASE o_orderkey % 7 WHEN 0 THEN 'female' WHEN 1 THEN 'male' WHEN 2 THEN 'other' WHEN 4 THEN 'other' ELSE 'unknown' END AS gender,
CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS birth_date,
CASE WHEN o_orderkey % 5 <> 0 THEN 'STREET ' || o_custkey END AS street, CASE WHEN o_orderkey % 5 <> 0 THEN 'TOWN' END AS city FROM orders WHERE o_orderkey % 13 <> 0""",
)
def patients(spark, d):
    return fhir.patients(admissions(spark, d)).withColumn("given", F.array_join("given", " "))


@query(
    "C2_fhir_encounter",
    """SELECT o_orderkey AS msg_id, CASE WHEN o_orderkey % 10 <> 0 THEN 'V' || o_orderkey END AS id, CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'in-progress' END AS status, 'ICU ' || o_orderkey % 40 AS bed,
date_trunc('day', o_orderdate) + INTERVAL 8 HOUR AS period_start, CASE WHEN o_orderkey % 17 <> 0 AND o_orderstatus = 'F' THEN date_trunc('day', o_orderdate) + INTERVAL 1110 MINUTE END AS period_end, CASE WHEN o_orderkey % 10 = 0 THEN 'VISIT_NUMBER_MISSING' END AS error
FROM orders WHERE o_orderkey % 19 <> 0""",
)
def encounters(spark, d):
    return fhir.encounters(admissions(spark, d)).drop("trigger")


@query("C4_fhir_errors", "SELECT o_orderkey AS msg_id, CASE WHEN o_orderkey % 13 = 0 THEN 'PID_MISSING' WHEN o_orderkey % 19 = 0 THEN 'PV1_MISSING' WHEN o_orderkey % 10 = 0 THEN 'VISIT_NUMBER_MISSING' ELSE 'TIMESTAMP_INVALID' END AS error_code FROM orders WHERE o_orderkey % 13 = 0 OR o_orderkey % 19 = 0 OR o_orderkey % 10 = 0 OR o_orderkey % 17 = 0")
def errors(spark, d):
    return fhir.conversion_errors(admissions(spark, d)).select("msg_id", "error_code")


_TRIGGER = "CASE l_linenumber % 3 WHEN 0 THEN 'A03' WHEN 1 THEN 'R01' ELSE 'A01' END"


@query(
    "C7_upsert_encounters",
    f"""WITH e AS (SELECT l_orderkey, {_TRIGGER} AS t, l_shipdate AS tm, l_linenumber * 1000000 + l_partkey AS seq FROM lineitem), a AS (SELECT l_orderkey, arg_max(t, ROW(tm, seq, t)) AS t, max(tm) AS tm FROM e WHERE t <> 'R01' GROUP BY 1)
SELECT e.l_orderkey AS encounter_id, CASE WHEN any_value(a.t) = 'A03' THEN 'finished' ELSE 'in-progress' END AS status, coalesce(any_value(a.tm), min(e.tm)) AS updated_at FROM e LEFT JOIN a USING (l_orderkey) GROUP BY 1""",
)
def upserted(spark, d):
    n = F.col("l_linenumber")
    trigger = F.when(n % 3 == 0, "A03").when(n % 3 == 1, "R01").otherwise("A01")
    events = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("encounter_id"), trigger.alias("trigger"), F.col("l_shipdate").alias("at"), (n * 1000000 + F.col("l_partkey")).alias("seq"))
    return fhir.upsert_encounters(events)


_UNIT = "CASE variable " + " ".join(f"WHEN '{v}' THEN '{u}'" for v, (_, u) in LOINC.items()) + " END"


@query(
    "B17_fhir_vitals_to_oru",
    f"""WITH {OBS_SQL}, r AS (SELECT encounter_id AS patient, effective FROM obs WHERE seq % 4 <> 0 AND {_UNIT} IS NOT NULL)
SELECT patient, 'ORU^R01' AS kind, effective AS at, count(*) AS results FROM r GROUP BY 1, 3 UNION ALL SELECT patient, 'ADT^A01', min(effective), 0 FROM r GROUP BY 1 UNION ALL SELECT patient, 'ADT^A03', max(effective), 0 FROM r GROUP BY 1""",
)
def vitals(spark, d):
    code = F.create_map(*(F.lit(x) for v, (c, _) in LOINC.items() for x in (v, c)))[F.col("variable")]
    unit = F.create_map(*(F.lit(x) for v, (_, u) in LOINC.items() for x in (v, u)))[F.col("variable")]
    rows = observations(spark, d).select(F.col("encounter_id").alias("patient"), code.alias("code"), F.when(F.col("seq") % 4 == 0, "lb").otherwise(unit).alias("unit"), "value", "effective")
    return fhir.vitals_messages(rows)
