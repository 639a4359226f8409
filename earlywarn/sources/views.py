"""Clinical views of the event and order tables: a stay per user, an ICU hour of eight table hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earlywarn.functions.clinical import icu_hour

HOUR_SECONDS = 8 * 3600

#: The variables of the feature specification and how long a value stays valid, in hours.
STALENESS = {"HR": 6, "O2Sat": 6, "Temp": 8, "SBP": 6, "MAP": 6, "DBP": 6, "Resp": 6, "FiO2": 12, "Lactate": 24, "WBC": 24, "Creatinine": 24, "Platelets": 24, "Bilirubin_total": 24}
VARIABLES = tuple(STALENESS)
#: The 13 codes of the reference table.
LOINC = {
    "HR": ("8867-4", "/min"), "O2Sat": ("59408-5", "%"), "Temp": ("8310-5", "Cel"), "SBP": ("8480-6", "mm[Hg]"), "MAP": ("8478-0", "mm[Hg]"), "DBP": ("8462-4", "mm[Hg]"), "Resp": ("9279-1", "/min"),
    "FiO2": ("3150-0", "1"), "Lactate": ("2524-7", "mmol/L"), "WBC": ("6690-2", "10*3/uL"), "Creatinine": ("2160-0", "mg/dL"), "Platelets": ("777-3", "10*3/uL"), "Bilirubin_total": ("1975-2", "mg/dL"),
}


#: Display names and plausible ranges of the same codes.
DISPLAY = {
    "HR": ("Heart rate", 0, 300), "O2Sat": ("SpO2", 0, 100), "Temp": ("Temperature", 25, 45), "SBP": ("Systolic BP", 0, 300), "MAP": ("Mean BP", 0, 300), "DBP": ("Diastolic BP", 0, 250), "Resp": ("Respiratory rate", 0, 100),
    "FiO2": ("FiO2", 0.15, 1.0), "Lactate": ("Lactate", 0, 40), "WBC": ("WBC", 0, 500), "Creatinine": ("Creatinine", 0, 30), "Platelets": ("Platelets", 0, 2000), "Bilirubin_total": ("Bilirubin", 0, 75),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``encounter_id, site, admitted_at, id, variable, value, effective, seq, hour``: one narrow pass over events, stays joined by key."""
    ev = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    start = ev.groupBy("user_id").agg(F.min("ts").cast("date").cast("timestamp_ntz").alias("admitted_at"))
    kind, v = F.col("event_type"), F.col("value")
    name = F.when(kind == "view", "HR").when(kind == "click", "Resp").when(kind == "purchase", "SBP").when(kind == "signup", "O2Sat").when(kind == "error", "Temp")
    number = F.when(kind == "view", 55 + v / 2).when(kind == "click", 12 + v / 10).when(kind == "purchase", 150 - v / 2).when(kind == "signup", 100 - v / 12).when(kind == "error", 35.5 + v / 30)
    row = lambda prefix, n, x: F.struct(F.concat(F.lit(prefix), F.col("event_id").cast("string")).alias("id"), n.alias("variable"), x.alias("value"))
    rows = F.array_compact(F.array(row("E", name, number), F.when(kind == "signup", row("F", F.lit("FiO2"), 0.15 + F.col("k") / 200.0)), F.when((kind == "error") & (F.col("k") < 50), row("L", F.lit("Lactate"), v / 25))))
    out = ev.select("user_id", "ts", "event_id", F.explode(rows).alias("o")).join(start, "user_id")
    effective = F.col("ts").cast("timestamp_ntz")
    return out.select(
        F.col("user_id").alias("encounter_id"), F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("site"), "admitted_at", "o.id", "o.variable", "o.value",
        effective.alias("effective"), F.col("event_id").alias("seq"), icu_hour(effective, F.col("admitted_at"), HOUR_SECONDS).alias("hour"),
    )


OBS_SQL = """
base AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
                CAST(CAST(min(ts) OVER (PARTITION BY user_id) AS DATE) AS TIMESTAMP) AS admitted_at FROM events),
obs0 AS (
  SELECT user_id, admitted_at, ts, event_id, 'E' || event_id AS id,
         CASE event_type WHEN 'view' THEN 'HR' WHEN 'click' THEN 'Resp' WHEN 'purchase' THEN 'SBP' WHEN 'signup' THEN 'O2Sat' WHEN 'error' THEN 'Temp' END AS variable,
         CASE event_type WHEN 'view' THEN 55 + value / 2 WHEN 'click' THEN 12 + value / 10 WHEN 'purchase' THEN 150 - value / 2 WHEN 'signup' THEN 100 - value / 12 WHEN 'error' THEN 35.5 + value / 30 END AS value FROM base
  UNION ALL SELECT user_id, admitted_at, ts, event_id, 'F' || event_id, 'FiO2', CAST(0.15 AS DOUBLE) + k / CAST(200.0 AS DOUBLE) FROM base WHERE event_type = 'signup'
  UNION ALL SELECT user_id, admitted_at, ts, event_id, 'L' || event_id, 'Lactate', value / 25 FROM base WHERE event_type = 'error' AND k < 50),
obs AS (SELECT user_id AS encounter_id, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS site, admitted_at, id, variable, value, ts AS effective, event_id AS seq,
               CAST(ceil((epoch_us(ts) - epoch_us(admitted_at)) / 28800000000.0) AS BIGINT) AS hour FROM obs0)"""

BUCKET_SQL = OBS_SQL + """,
bucket AS (SELECT encounter_id, site, hour, variable, value FROM (SELECT *, row_number() OVER (PARTITION BY encounter_id, hour, variable ORDER BY effective DESC, id DESC) AS rn FROM obs WHERE hour >= 1) WHERE rn = 1)"""

HOURS_SQL = BUCKET_SQL + """,
spine AS (SELECT encounter_id, site, CAST(unnest(generate_series(1, max(hour))) AS BIGINT) AS hour FROM bucket GROUP BY encounter_id, site),
wide AS (SELECT s.encounter_id, s.site, s.hour, """ + ", ".join(f"max(CASE WHEN b.variable = '{v}' THEN b.value END) AS {v}" for v in VARIABLES) + """
         FROM spine s LEFT JOIN bucket b ON s.encounter_id = b.encounter_id AND s.hour = b.hour GROUP BY s.encounter_id, s.site, s.hour)"""  # fmt: skip

LABEL_SQL = """,
first_high AS (SELECT encounter_id, min(hour) AS f FROM wide WHERE Temp >= 42 GROUP BY encounter_id),
long AS (SELECT w.*, CAST(coalesce(w.hour >= f.f - 6, false) AS INTEGER) AS label FROM wide w LEFT JOIN first_high f USING (encounter_id))"""
