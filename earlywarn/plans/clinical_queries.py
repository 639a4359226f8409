"""Hourly buckets, features, score, policy and evaluation: queries over the stays of the event table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earlywarn.functions.clinical import PARTS, alert_uuid, hour_ending, round_half_up, severity
from earlywarn.operators import evaluation as ev
from earlywarn.operators import hourly as h
from earlywarn.session import cut
from earlywarn.sources.views import BUCKET_SQL, HOUR_SECONDS, HOURS_SQL, LABEL_SQL, OBS_SQL, STALENESS, VARIABLES, observations

QUERIES: dict = {}
ORACLE_SQL: dict = {}
POLICY = ev.Policy(5.0, 6.0, 2.0)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def hours_of(spark: SparkSession, d: str) -> DataFrame:
    return h.stay_hours(observations(spark, d))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Hours with label, total and a probability."""
    x = h.with_news2(h.with_last_values(h.with_label(hours_of(spark, d)), ("HR", "O2Sat", "Temp", "SBP", "Resp", "FiO2")))
    total = F.col("news2.total")
    return x.select("encounter_id", "site", "hour", "label", "parts", total.alias("score"), F.col("news2.single3").alias("single3"), (1 / (1 + F.exp(-(total - 5) / 2))).alias("p"))


def alerts_of(spark: SparkSession, d: str) -> DataFrame:
    return ev.apply_policy(scored(spark, d), POLICY)


# --- SQL pieces -------------------------------------------------------------------------------------------------------------------------
_W = "OVER (PARTITION BY encounter_id ORDER BY hour ROWS UNBOUNDED PRECEDING)"


def _last_sql(v: str, source: str) -> str:
    return f"(hour - max(CASE WHEN {v} IS NOT NULL THEN hour END) {_W}) AS {v}_age, last_value({v} IGNORE NULLS) {_W} AS {v}_any"


def _lasts(source: str, variables=VARIABLES) -> str:
    return f"""lasts0 AS (SELECT *, {', '.join(_last_sql(v, source) for v in variables)} FROM {source}),
lasts AS (SELECT *, {', '.join(f'CASE WHEN {v}_age <= {STALENESS[v]} THEN {v}_any END AS {v}_last' for v in variables)} FROM lasts0)"""


def _r(x: str, k: int) -> str:
    return f"floor({x} * {10**k} + CAST(0.5 AS DOUBLE) + CAST(1e-9 AS DOUBLE)) / {10**k}"


_BANDS = {"respiratory_rate": ("Resp", 0, [(8, 3), (11, 1), (20, 0), (24, 2)], 3), "spo2": ("O2Sat", 0, [(91, 3), (93, 2), (95, 1)], 0), "systolic_bp": ("SBP", 0, [(90, 3), (100, 2), (110, 1), (219, 0)], 3), "pulse": ("HR", 0, [(40, 3), (50, 1), (90, 0), (110, 1), (130, 2)], 3), "temperature": ("Temp", 1, [(35.0, 3), (36.0, 1), (38.0, 0), (39.0, 1)], 2)}


def _part(name: str) -> str:
    if name == "consciousness":
        return "0"
    if name == "supplemental_o2":
        return "CASE WHEN FiO2_last > CAST(0.21 AS DOUBLE) THEN 2 ELSE 0 END"
    v, k, bands, top = _BANDS[name]
    return f"CASE WHEN {v}_last IS NULL THEN 0 " + " ".join(f"WHEN {_r(v + '_last', k)} <= CAST({b} AS DOUBLE) THEN {p}" for b, p in bands) + f" ELSE {top} END"


NEWS_SQL = HOURS_SQL + LABEL_SQL + ",\n" + _lasts("long", ("HR", "O2Sat", "Temp", "SBP", "Resp", "FiO2")) + f""",
parts AS (SELECT *, {', '.join(f'{_part(p)} AS p_{p}' for p in PARTS)} FROM lasts),
scored AS (SELECT encounter_id, site, hour, label, {', '.join(f'p_{p}' for p in PARTS)}, {' + '.join(f'p_{p}' for p in PARTS)} AS score, greatest({', '.join(f'p_{p}' for p in PARTS)}) = 3 AS single3,
           1 / (1 + exp(-({' + '.join(f'p_{p}' for p in PARTS)} - 5) / CAST(2 AS DOUBLE))) AS p FROM parts)"""
ALERT_SQL = NEWS_SQL.lstrip() + """,
walk(encounter_id, site, hour, score, alert, lh, ls) AS (
  SELECT encounter_id, site, hour, score, score >= 5, CASE WHEN score >= 5 THEN hour END, CASE WHEN score >= 5 THEN score END FROM scored WHERE hour = 1
  UNION ALL
  SELECT s.encounter_id, s.site, s.hour, s.score, f.fire, CASE WHEN f.fire THEN s.hour ELSE w.lh END, CASE WHEN f.fire THEN s.score ELSE w.ls END
  FROM walk w JOIN scored s ON s.encounter_id = w.encounter_id AND s.hour = w.hour + 1,
  LATERAL (SELECT coalesce(s.score >= 5 AND NOT (w.lh IS NOT NULL AND s.hour - w.lh < 6 AND NOT s.score >= w.ls + 2), false) AS fire) f),
outcomes AS (SELECT encounter_id, site, min(CASE WHEN label = 1 THEN hour END) AS p, min(hour) AS first_hour, max(hour) AS last_hour FROM long GROUP BY encounter_id, site),
outcome AS (SELECT encounter_id, site, p IS NOT NULL AS septic, coalesce(p > first_hour, false) AS onset_known, CASE WHEN p > first_hour THEN p + 6 END AS onset_hour, first_hour, last_hour FROM outcomes),
summary0 AS (SELECT w.encounter_id, w.site, septic, onset_known, onset_hour, count(*) AS hours, sum(CASE WHEN alert THEN 1 ELSE 0 END) AS alerts,
            sum(CASE WHEN alert AND onset_known AND hour BETWEEN onset_hour - 48 AND onset_hour THEN 1 ELSE 0 END) AS true_alerts, min(CASE WHEN alert AND onset_known AND hour BETWEEN onset_hour - 48 AND onset_hour THEN hour END) AS first
            FROM walk w JOIN outcome o ON w.encounter_id = o.encounter_id GROUP BY ALL),
summary AS (SELECT encounter_id, site, septic AND NOT onset_known AS excluded, septic, CAST(hours AS BIGINT) AS hours, CAST(alerts AS BIGINT) AS alerts, CAST(true_alerts AS BIGINT) AS true_alerts, true_alerts > 0 AS detected, onset_hour - first AS lead_time FROM summary0)"""
WITH_ALERTS = "WITH RECURSIVE " + ALERT_SQL


# --- buckets ----------------------------------------------------------------------------------------------------------------------------
@query("D1_icu_hour", f"WITH {OBS_SQL} SELECT id, encounter_id, hour, admitted_at + to_hours(hour * 8) AS hour_ending FROM obs")
def icu_hours(spark, d):
    o = observations(spark, d)
    return o.select("id", "encounter_id", "hour", hour_ending(F.col("admitted_at"), F.col("hour"), HOUR_SECONDS).alias("hour_ending"))


@query("D2_classify_observations", f"WITH {OBS_SQL}, twice AS (SELECT * FROM obs UNION ALL SELECT encounter_id, site, admitted_at, id, variable, value, effective, seq + 10000000, hour FROM obs WHERE seq % 7 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY encounter_id, id ORDER BY seq) AS rn FROM twice) SELECT id, seq, CASE WHEN hour < 1 THEN 'before_admission' WHEN rn > 1 THEN 'duplicate' ELSE 'accepted' END AS outcome FROM r")
def classified(spark, d):
    o = observations(spark, d)
    return h.classify(o.unionByName(o.where("seq % 7 = 0").withColumn("seq", F.col("seq") + 10_000_000))).select("id", "seq", "outcome")


@query("D3_bucket_last_value", f"WITH {BUCKET_SQL} SELECT encounter_id, hour, variable, value FROM bucket")
def buckets(spark, d):
    return h.last_in_hour(observations(spark, d)).select("encounter_id", "hour", "variable", "value")


@query("D4_pivot_hours", f"WITH {BUCKET_SQL} SELECT encounter_id, site, hour, {', '.join(f'max(CASE WHEN variable = {chr(39)}{v}{chr(39)} THEN value END) AS {v}' for v in VARIABLES)} FROM bucket GROUP BY encounter_id, site, hour")
def pivoted(spark, d):
    return h.pivot_hours(h.last_in_hour(observations(spark, d)))


@query("D5_densify_hours", f"WITH {HOURS_SQL} SELECT * FROM wide")
def dense(spark, d):
    return hours_of(spark, d)


@query("D6_assert_hourly", f"WITH {HOURS_SQL} SELECT encounter_id, count(*) AS hours, max(hour) AS last_hour FROM wide GROUP BY encounter_id")
def asserted(spark, d):
    return h.assert_hourly(hours_of(spark, d)).groupBy("encounter_id").agg(F.count(F.lit(1)).alias("hours"), F.max("hour").alias("last_hour"))


@query("D7_newest_message_time", f"WITH {HOURS_SQL}, t AS (SELECT encounter_id, hour, max(effective) AS newest FROM obs WHERE hour >= 1 GROUP BY 1, 2) SELECT w.encounter_id, w.hour, max(t.newest) OVER (PARTITION BY w.encounter_id ORDER BY w.hour ROWS UNBOUNDED PRECEDING) AS message_time FROM wide w LEFT JOIN t ON w.encounter_id = t.encounter_id AND w.hour = t.hour")
def message_times(spark, d):
    return h.message_time_by_hour(observations(spark, d)).select("encounter_id", "hour", "message_time")


@query("D8_history_slice", f"WITH {HOURS_SQL}, m AS (SELECT encounter_id, max(hour) AS t FROM wide GROUP BY 1) SELECT w.encounter_id, w.hour, w.HR FROM wide w JOIN m USING (encounter_id) WHERE w.hour BETWEEN m.t - 30 AND m.t")
def history(spark, d):
    x = hours_of(spark, d)
    newest = x.groupBy("encounter_id").agg(F.max("hour").alias("t"))
    return x.join(newest, "encounter_id").where(F.col("hour").between(F.col("t") - 30, F.col("t"))).select("encounter_id", "hour", "HR")


@query("D10_stay_from_long", f"WITH {BUCKET_SQL} SELECT encounter_id, site, hour, variable, value FROM bucket WHERE value IS NOT NULL")
def unpivoted(spark, d):
    return h.unpivot_stays(hours_of(spark, d))


# --- features ---------------------------------------------------------------------------------------------------------------------------
@query("E1_ffill_last", f"WITH {HOURS_SQL}, {_lasts('wide')} SELECT encounter_id, hour, {', '.join(f'{v}_last' for v in VARIABLES)} FROM lasts")
def ffill(spark, d):
    return h.with_last_values(hours_of(spark, d)).select("encounter_id", "hour", *(f"{v}_last" for v in VARIABLES))


@query("E2_measured_flag", f"WITH {HOURS_SQL} SELECT encounter_id, hour, {', '.join(f'CAST({v} IS NOT NULL AS INTEGER) AS {v}_measured' for v in VARIABLES)} FROM wide")
def measured(spark, d):
    return hours_of(spark, d).select("encounter_id", "hour", *(F.col(v).isNotNull().cast("int").alias(f"{v}_measured") for v in VARIABLES))


@query("E3_hours_since", f"WITH {HOURS_SQL}, {_lasts('wide')} SELECT encounter_id, hour, {', '.join(f'CASE WHEN {v}_age <= 24 THEN {v}_age END AS {v}_hours_since' for v in VARIABLES)} FROM lasts")
def since(spark, d):
    return h.build_features(hours_of(spark, d)).select("encounter_id", "hour", *(f"{v}_hours_since" for v in VARIABLES))


_LAG = "OVER (PARTITION BY encounter_id ORDER BY hour)"
_DELTA = ", ".join(f"{v}_last - lag({v}_last, {k}) {_LAG} AS {v}_delta_{k}h" for v in VARIABLES for k in (1, 3, 6))
_ROLL = ", ".join(f"min({v}) OVER f{k} AS {v}_min_{k}h, max({v}) OVER f{k} AS {v}_max_{k}h, round(avg({v}) OVER f{k}, 6) AS {v}_mean_{k}h" for v in VARIABLES for k in (6, 12))
_FRAMES = "WINDOW f6 AS (PARTITION BY encounter_id ORDER BY hour ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), f12 AS (PARTITION BY encounter_id ORDER BY hour ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"


@query("E4_delta_lag", f"WITH {HOURS_SQL}, {_lasts('wide')} SELECT encounter_id, hour, {_DELTA} FROM lasts")
def deltas(spark, d):
    return h.build_features(hours_of(spark, d)).select("encounter_id", "hour", *(f"{v}_delta_{k}h" for v in VARIABLES for k in (1, 3, 6)))


def _rounded_means(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if "_mean_" in c else F.col(c) for c in df.columns))


@query("E5_rolling_stats", f"WITH {HOURS_SQL} SELECT encounter_id, hour, {_ROLL} FROM wide {_FRAMES}")
def rolling(spark, d):
    x = h.build_features(hours_of(spark, d))
    return _rounded_means(x.select("encounter_id", "hour", *(c for c in x.columns if any(k in c for k in ("_min_", "_max_", "_mean_")))))


@query("E6_news2_round", f"WITH {OBS_SQL} SELECT id, {_r('value', 0)} AS whole, {_r('value', 1)} AS tenth FROM obs")
def rounding(spark, d):
    return observations(spark, d).select("id", round_half_up(F.col("value"), 0).cast("double").alias("whole"), round_half_up(F.col("value"), 1).alias("tenth"))


@query("E7_news2_components", f"WITH {NEWS_SQL} SELECT encounter_id, hour, {', '.join(f'p_{p} AS {p}' for p in PARTS)} FROM scored")
def components(spark, d):
    return scored(spark, d).select("encounter_id", "hour", *(F.col("parts")[p].alias(p) for p in PARTS))


@query("E8_news2_total", f"WITH {NEWS_SQL} SELECT encounter_id, hour, score AS total, single3, score >= 5 AS urgent, score >= 7 AS emergency FROM scored")
def totals(spark, d):
    return scored(spark, d).select("encounter_id", "hour", F.col("score").alias("total"), "single3", (F.col("score") >= 5).alias("urgent"), (F.col("score") >= 7).alias("emergency"))


@query("E9_news2_severity", f"WITH {NEWS_SQL} SELECT encounter_id, hour, CASE WHEN score >= 7 THEN 'high' WHEN score >= 5 THEN 'medium' WHEN single3 THEN 'low-medium' ELSE 'low' END AS severity FROM scored")
def severities(spark, d):
    return scored(spark, d).select("encounter_id", "hour", severity(F.col("score"), F.col("single3")).alias("severity"))


_FEATURE_SQL = f"""WITH {HOURS_SQL}, {_lasts('wide')},
f AS (SELECT *, {_DELTA}, {_ROLL} FROM lasts {_FRAMES}), p AS (SELECT *, {', '.join(f'{_part(p)} AS news2_{p}' for p in PARTS if p != 'consciousness')} FROM f)
SELECT encounter_id, site, hour, {', '.join(f'{v}_last, CAST({v} IS NOT NULL AS INTEGER) AS {v}_measured, CASE WHEN {v}_age <= 24 THEN {v}_age END AS {v}_hours_since, ' + ', '.join(f'{v}_delta_{k}h' for k in (1, 3, 6)) + ', ' + ', '.join(f'{v}_{s}_{k}h' for k in (6, 12) for s in ('min', 'max', 'mean')) for v in VARIABLES)},
{', '.join(f'news2_{p}' for p in PARTS if p != 'consciousness')}, {' + '.join(f'news2_{p}' for p in PARTS if p != 'consciousness')} AS news2_total, hour AS icu_hour FROM p"""


@query("E10_build_features", _FEATURE_SQL)
def features(spark, d):
    return _rounded_means(h.build_features(hours_of(spark, d)))


@query("E11_labelled_features", f"WITH {NEWS_SQL} SELECT encounter_id, hour, score AS news2_total, label FROM scored")
def labelled(spark, d):
    x = h.with_label(hours_of(spark, d))
    return h.build_features(x).join(x.select("encounter_id", "hour", "label"), ["encounter_id", "hour"]).select("encounter_id", "hour", "news2_total", "label")


@query("E13_stay_outcomes", WITH_ALERTS + " SELECT * FROM outcome")
def outcomes(spark, d):
    return h.stay_outcomes(h.with_label(hours_of(spark, d)))


@query("E14_cohort_report", f"WITH {HOURS_SQL}{LABEL_SQL}, s AS (SELECT encounter_id, site, count(*) AS n, max(label) AS septic, sum(label) AS pos, {', '.join(f'sum(CASE WHEN {v} IS NULL THEN 1 ELSE 0 END) AS b_{v}' for v in VARIABLES)} FROM long GROUP BY 1, 2) SELECT site, count(*) AS patients, CAST(sum(septic) AS BIGINT) AS septic_patients, CAST(sum(n) AS BIGINT) AS hours, CAST(sum(pos) AS BIGINT) AS positive_hours, quantile_cont(n, 0.5) AS median_hours, {', '.join(f'round(sum(b_{v}) / CAST(sum(n) AS DOUBLE), 9) AS missing_{v}' for v in VARIABLES)} FROM s GROUP BY site")
def cohorts(spark, d):
    return h.cohort(h.with_label(hours_of(spark, d)))


# --- policy and alerts ------------------------------------------------------------------------------------------------------------------
@query("F1_apply_policy", WITH_ALERTS + " SELECT encounter_id, hour, CAST(score AS DOUBLE) AS score, alert FROM walk")
def policy(spark, d):
    return alerts_of(spark, d).select("encounter_id", "hour", "score", "alert")


@query("F2_score_hours", f"WITH {NEWS_SQL} SELECT encounter_id, hour, score AS news2_total, round(p, 9) AS probability FROM scored")
def score_hours(spark, d):
    return scored(spark, d).select("encounter_id", "hour", F.col("score").alias("news2_total"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "p")), 9).alias("probability"))


_UUID = "sha1(unhex('7d5c6f2e3a7b4b8e9f0d2c1e6a5b4d30') || encode(encounter_id || '/' || hour || '/news2'))"


@query("F3_alerts_table", WITH_ALERTS + " SELECT encounter_id, hour AS icu_hour, 'news2' AS source, CAST(score AS DOUBLE) AS raw_score FROM walk WHERE alert")
def alerts_table(spark, d):
    a = alerts_of(spark, d).where("alert")
    return a.select("encounter_id", F.col("hour").alias("icu_hour"), F.lit("news2").alias("source"), F.col("score").alias("raw_score"))


@query("F4_scores_table", WITH_ALERTS + ", adm AS (SELECT encounter_id, min(admitted_at) AS a FROM obs GROUP BY 1) SELECT encounter_id, hour AS icu_hour, score, alert AS alerted, a + to_hours(hour * 8) AS hour_ending FROM (SELECT encounter_id, hour, CAST(score AS DOUBLE) AS score, alert FROM walk) JOIN adm USING (encounter_id)")
def scores_table(spark, d):
    admitted = observations(spark, d).groupBy("encounter_id").agg(F.min("admitted_at").alias("a"))
    return alerts_of(spark, d).join(admitted, "encounter_id").select("encounter_id", F.col("hour").alias("icu_hour"), "score", F.col("alert").alias("alerted"), hour_ending(F.col("a"), F.col("hour"), HOUR_SECONDS).alias("hour_ending"))


@query("F5_alert_uuid5", WITH_ALERTS + f", u AS (SELECT encounter_id, hour, {_UUID} AS x FROM walk WHERE alert) SELECT encounter_id, hour, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(x, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS alert_id FROM u")
def uuids(spark, d):
    return alerts_of(spark, d).where("alert").select("encounter_id", "hour", alert_uuid(F.col("encounter_id"), F.col("hour"), F.lit("news2")).alias("alert_id"))


@query("F12_store_scores", "SELECT o_orderkey AS encounter_id, max(l_linenumber) AS icu_hour, count(*) AS n FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1 GROUP BY 1")
def store_scores(spark, d):
    from pyspark.sql import Window

    li = spark.read.parquet(f"{d}/lineitem.parquet")
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(F.desc("l_shipdate"), F.desc("l_partkey"), F.desc("l_suppkey"))
    kept = li.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return kept.groupBy(F.col("l_orderkey").alias("encounter_id")).agg(F.max("l_linenumber").alias("icu_hour"), F.count(F.lit(1)).alias("n"))


# --- evaluation -------------------------------------------------------------------------------------------------------------------------
_RANK = ", t AS (SELECT score AS s, CAST(sum(label) AS DOUBLE) AS p, CAST(sum(1 - label) AS DOUBLE) AS n FROM scored GROUP BY score), c AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp FROM t), l AS (SELECT tp, fp, coalesce(lag(tp) OVER (ORDER BY s DESC), 0) AS tp0, coalesce(lag(fp) OVER (ORDER BY s DESC), 0) AS fp0 FROM c)"


@query("H1_auroc", f"WITH {NEWS_SQL}{_RANK} SELECT CASE WHEN max(tp) > 0 AND max(fp) > 0 THEN round(sum((fp - fp0) * (tp + tp0) / 2) / max(tp) / max(fp), 9) END AS auroc FROM l")
def auroc(spark, d):
    return ev.ranking(scored(spark, d), "label", "score").select("auroc")


@query("H2_auprc", f"WITH {NEWS_SQL}{_RANK} SELECT CASE WHEN max(tp) > 0 THEN round(sum((tp - tp0) * tp / (tp + fp)) / max(tp), 9) END AS auprc FROM l")
def auprc(spark, d):
    return ev.ranking(scored(spark, d), "label", "score").select("auprc")


_GAIN = "CASE WHEN onset IS NOT NULL AND d > 3 THEN 0 WHEN onset IS NOT NULL AND {a} THEN CASE WHEN d <= -6 THEN greatest(d / 6 + 2, -0.05) ELSE d / -9 + CAST(3.0 AS DOUBLE) / 9 END WHEN onset IS NOT NULL THEN CASE WHEN d > -6 THEN (d + 6) * CAST(-2.0 AS DOUBLE) / 9 ELSE 0 END WHEN {a} THEN CAST(-0.05 AS DOUBLE) ELSE 0 END"
_UTILITY = f""", u0 AS (SELECT w.encounter_id, w.site, w.alert, CAST(row_number() OVER (PARTITION BY w.encounter_id ORDER BY w.hour) - 1 AS DOUBLE) AS t, l.label FROM walk w JOIN long l ON w.encounter_id = l.encounter_id AND w.hour = l.hour),
u1 AS (SELECT *, min(CASE WHEN label = 1 THEN t END) OVER (PARTITION BY encounter_id) + 6 AS onset FROM u0), u2 AS (SELECT *, t - onset AS d FROM u1),
u AS (SELECT encounter_id, site, round(sum({_GAIN.format(a='alert')}), 9) AS observed, round(sum({_GAIN.format(a='coalesce(d >= -12 AND d <= 3, false)')}), 9) AS best, round(sum({_GAIN.format(a='false')}), 9) AS inaction FROM u2 GROUP BY 1, 2)"""


def _with_labels(spark, d):
    return alerts_of(spark, d).join(scored(spark, d).select("encounter_id", "hour", "label"), ["encounter_id", "hour"])


@query("H4_utility", WITH_ALERTS + _UTILITY + " SELECT encounter_id, round(observed, 6) AS observed, round(best, 6) AS best, round(inaction, 6) AS inaction FROM u")
def utility(spark, d):
    return ev.utility_components(_with_labels(spark, d)).select("encounter_id", *(F.round(c, 6).alias(c) for c in ("observed", "best", "inaction")))


@query("H5_normalized_utility", WITH_ALERTS + _UTILITY + " SELECT CASE WHEN sum(best) <> sum(inaction) THEN round((sum(observed) - sum(inaction)) / (sum(best) - sum(inaction)), 6) END AS utility FROM u")
def norm_utility(spark, d):
    return ev.normalized_utility(ev.utility_components(_with_labels(spark, d)))


def _summary(spark, d):
    return ev.stay_summary(alerts_of(spark, d), h.stay_outcomes(h.with_label(hours_of(spark, d))))


@query("H6_stay_summary", WITH_ALERTS + " SELECT * FROM summary")
def summary(spark, d):
    return _summary(spark, d)


_EVENTS = """ SELECT CAST(septic_patients AS INTEGER) AS septic_patients, CAST(unknown_onset_excluded AS INTEGER) AS unknown_onset_excluded, CAST(non_septic_patients AS INTEGER) AS non_septic_patients, CAST(alerts AS BIGINT) AS alerts,
CASE WHEN septic_patients > 0 THEN round(detected * CAST(1.0 AS DOUBLE) / septic_patients, 9) END AS event_sensitivity, CASE WHEN hours > 0 THEN round(alerts * CAST(24.0 AS DOUBLE) / hours, 9) END AS alerts_per_patient_day,
CASE WHEN clean_hours > 0 THEN round(clean_alerts * CAST(24.0 AS DOUBLE) / clean_hours, 9) END AS false_alerts_per_patient_day, CASE WHEN alerts > 0 THEN round(true_alerts * CAST(1.0 AS DOUBLE) / alerts, 9) END AS ppv_per_alert
FROM (SELECT coalesce(sum(CASE WHEN septic AND NOT excluded THEN 1 END), 0) AS septic_patients, coalesce(sum(CASE WHEN excluded THEN 1 END), 0) AS unknown_onset_excluded, coalesce(sum(CASE WHEN NOT septic THEN 1 END), 0) AS non_septic_patients,
coalesce(sum(CASE WHEN septic AND NOT excluded AND detected THEN 1 END), 0) AS detected, coalesce(sum(CASE WHEN NOT excluded THEN hours END), 0) AS hours, coalesce(sum(CASE WHEN NOT excluded THEN alerts END), 0) AS alerts,
coalesce(sum(CASE WHEN NOT excluded THEN true_alerts END), 0) AS true_alerts, coalesce(sum(CASE WHEN NOT septic THEN hours END), 0) AS clean_hours, coalesce(sum(CASE WHEN NOT septic THEN alerts END), 0) AS clean_alerts FROM summary)"""


@query("H7_event_metrics", WITH_ALERTS + _EVENTS)
def events(spark, d):
    x = ev.event_metrics(_summary(spark, d))
    return x.select(*(F.col(c).cast("int").alias(c) if c.endswith("patients") or c == "unknown_onset_excluded" else F.col(c) for c in x.columns))


_LEAD = ", d AS (SELECT lead_time AS v, CAST(count(*) AS DOUBLE) AS w FROM summary WHERE detected AND NOT excluded GROUP BY 1), p0 AS (SELECT v, (sum(w) OVER (ORDER BY v) - w + 0.5) / sum(w) OVER () * 100 AS p, (sum(w) OVER (ORDER BY v) - 0.5) / sum(w) OVER () * 100 AS q FROM d), p1 AS (SELECT *, lead(v) OVER (ORDER BY v) AS v2, lead(p) OVER (ORDER BY v) AS p2, row_number() OVER (ORDER BY v) AS n FROM p0), w AS (SELECT CAST(unnest([25, 50, 75]) AS DOUBLE) AS percent)"


@query("H8_weighted_percentile", WITH_ALERTS + _LEAD + " SELECT percent, round(CAST(CASE WHEN percent <= q OR p2 IS NULL THEN v ELSE v + (v2 - v) * (percent - q) / (p2 - q) END AS DOUBLE), 9) AS result FROM p1 JOIN w ON (percent >= p AND (p2 IS NULL OR percent < p2)) OR (n = 1 AND percent < p)")
def lead_times(spark, d):
    return ev.weighted_percentile(_summary(spark, d).where("detected and not excluded").withColumn("w", F.lit(1.0)), "lead_time", "w", [25.0, 50.0, 75.0])


@query("H10_quantile_grid", f"WITH {NEWS_SQL}, q AS (SELECT unnest(quantile_cont(p, [" + ", ".join(f"{i}/399.0" for i in range(400)) + "])) AS t FROM scored) SELECT DISTINCT round(t, 9) AS threshold FROM q")
def quantile_grid(spark, d):
    return ev.quantiles(scored(spark, d), "p", 400)


@query("H13_news2_operating_point", WITH_ALERTS + ", m AS (" + _EVENTS + ") SELECT alerts_per_patient_day AS target FROM m")
def operating_point(spark, d):
    return ev.event_metrics(_summary(spark, d)).select(F.col("alerts_per_patient_day").alias("target"))


@query("H14_brier", f"WITH {NEWS_SQL} SELECT round(avg((p - label) * (p - label)), 9) AS brier FROM scored")
def brier(spark, d):
    return ev.brier(scored(spark, d), "label", "p")


_BINS = f"WITH {NEWS_SQL}, b AS (SELECT {' + '.join(f'CAST(p >= CAST({i / 10} AS DOUBLE) AS INTEGER)' for i in range(1, 10))} AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(CAST(label AS DOUBLE)), 9) AS rate FROM scored GROUP BY 1), e AS (SELECT CAST(i AS INTEGER) AS bin FROM range(10) t(i)), r AS (SELECT e.bin, coalesce(b.n, 0) AS n, mean_p, rate FROM e LEFT JOIN b USING (bin))"


@query("H15_reliability", _BINS + " SELECT * FROM r")
def reliability(spark, d):
    return ev.reliability(scored(spark, d), "label", "p")


@query("H16_ece", _BINS + " SELECT round(sum(n * abs(mean_p - rate)) / sum(n), 7) AS ece FROM r")
def ece(spark, d):
    return ev.ece(ev.reliability(scored(spark, d), "label", "p"))


@query("H17_stratified_folds", WITH_ALERTS + " SELECT encounter_id, site, septic, CAST((row_number() OVER (PARTITION BY septic ORDER BY md5('2019/' || site || '/' || encounter_id)) - 1) % 5 AS INTEGER) AS fold FROM outcome")
def folds(spark, d):
    return ev.folds(h.stay_outcomes(h.with_label(hours_of(spark, d))))


@query("H18_rows_for", f"WITH {NEWS_SQL} SELECT encounter_id, hour, label FROM scored WHERE encounter_id IN (SELECT encounter_id FROM scored GROUP BY 1 HAVING max(score) >= 9)")
def rows_for(spark, d):
    x = scored(spark, d)
    return ev.rows_for(x, x.groupBy("encounter_id", "site").agg(F.max("score").alias("m")).where("m >= 9")).select("encounter_id", "hour", "label")


@query("H19_leakage_checks", f"WITH {OBS_SQL} SELECT count(*) AS shared FROM (SELECT encounter_id FROM obs WHERE site = 'A' INTERSECT SELECT encounter_id FROM obs WHERE site = 'B')")
def leakage(spark, d):
    o = observations(spark, d)
    return o.where("site = 'A'").select("encounter_id").intersect(o.where("site = 'B'").select("encounter_id")).agg(F.count(F.lit(1)).alias("shared"))


_TABLE = WITH_ALERTS + """, tw AS (SELECT t AS threshold, s.* FROM scored s, (SELECT CAST(unnest(range(1, 13)) AS DOUBLE) AS t)),
wt(threshold, encounter_id, hour, alert, lh, ls) AS (
  SELECT threshold, encounter_id, hour, score >= threshold, CASE WHEN score >= threshold THEN hour END, CASE WHEN score >= threshold THEN score END FROM tw WHERE hour = 1
  UNION ALL
  SELECT s.threshold, s.encounter_id, s.hour, f.fire, CASE WHEN f.fire THEN s.hour ELSE w.lh END, CASE WHEN f.fire THEN s.score ELSE w.ls END
  FROM wt w JOIN tw s ON s.threshold = w.threshold AND s.encounter_id = w.encounter_id AND s.hour = w.hour + 1,
  LATERAL (SELECT coalesce(s.score >= s.threshold AND NOT (w.lh IS NOT NULL AND s.hour - w.lh < 6 AND NOT s.score >= w.ls + 2), false) AS fire) f),
st AS (SELECT threshold, w.encounter_id, septic, count(*) AS hours, sum(CASE WHEN alert THEN 1 ELSE 0 END) AS alerts, max(CASE WHEN alert AND hour BETWEEN onset_hour - 48 AND onset_hour THEN 1 ELSE 0 END) AS hit
       FROM wt w JOIN outcome o USING (encounter_id) WHERE NOT (septic AND NOT onset_known) GROUP BY ALL),
tab AS (SELECT threshold, round(sum(alerts) * CAST(24.0 AS DOUBLE) / sum(hours), 9) AS alerts_per_patient_day, round(CAST(sum(CASE WHEN septic THEN hit ELSE 0 END) AS DOUBLE) / sum(CASE WHEN septic THEN 1 END), 9) AS sensitivity FROM st GROUP BY 1)"""


def _thresholds(spark, d):
    x = h.with_label(hours_of(spark, d))
    return ev.threshold_table(scored(spark, d), h.stay_outcomes(x), [float(t) for t in range(1, 13)], rise_margin=2.0)


@query("H12_choose_fixed_sensitivity", _TABLE + " SELECT * FROM tab WHERE threshold = (SELECT coalesce(max(CASE WHEN sensitivity >= 0.8 THEN threshold END), min(threshold)) FROM tab)")
def fixed_sensitivity(spark, d):
    t = _thresholds(spark, d)
    return ev.choice(t, ev.choose_fixed_sensitivity(t))


@query("H11_choose_matched_burden", _TABLE + ", k AS (SELECT 1.5 AS target, coalesce(max(CASE WHEN alerts_per_patient_day >= 1.5 THEN threshold END), min(threshold)) AS a FROM tab) SELECT tab.* FROM tab, k WHERE threshold IN (a, a + 1) ORDER BY abs(alerts_per_patient_day - target), threshold DESC LIMIT 1")
def matched_burden(spark, d):
    t = _thresholds(spark, d)
    return ev.choice(t, ev.choose_matched_burden(t, 1.5))


# a score of many values: the points, and how long they have been high
_SUSTAINED = """, sustained AS (SELECT encounter_id, site, hour, (100 * score + sum(score) OVER (PARTITION BY encounter_id, site ORDER BY hour ROWS 11 PRECEDING)) / CAST(100 AS DOUBLE) AS score FROM scored),
fold AS (SELECT encounter_id, (row_number() OVER (PARTITION BY septic ORDER BY md5('2019/' || site || '/' || encounter_id)) - 1) % 5 AS fold FROM outcome WHERE site = 'A'),
held AS (SELECT * FROM sustained WHERE encounter_id IN (SELECT encounter_id FROM fold WHERE fold = 0)),
grid AS (SELECT DISTINCT round(t, 9) AS threshold FROM (SELECT unnest(quantile_cont(score, [""" + ", ".join(f"{i}/399.0" for i in range(400)) + """])) AS t FROM held)),
tw AS (SELECT threshold, h.* FROM held h, grid),"""
_SEARCH = WITH_ALERTS + _SUSTAINED + _TABLE.split("FROM scored s, (SELECT CAST(unnest(range(1, 13)) AS DOUBLE) AS t)),", 1)[1] + """,
num AS (SELECT *, CAST(row_number() OVER (ORDER BY threshold) - 1 AS BIGINT) AS i FROM tab), goal AS (SELECT round(sum(alerts) * CAST(24.0 AS DOUBLE) / sum(hours), 9) AS goal FROM summary WHERE NOT excluded AND site = 'A'),
ok AS (SELECT i, {good} AS good FROM num, goal), bis AS (SELECT CAST(0 AS BIGINT) AS low, (SELECT max(i) FROM num) AS high, CAST(-1 AS BIGINT) AS found
  UNION ALL SELECT CASE WHEN good THEN i + 1 ELSE low END, CASE WHEN good THEN high ELSE i - 1 END, CASE WHEN good THEN i ELSE found END FROM bis JOIN ok ON i = (low + high) // 2 WHERE low <= high),
best AS (SELECT max(found) AS found FROM bis)
"""


def _held_out(spark, d):
    """Hours of one fifth of the stays of site A under the sustained score, outcomes, and the points of the whole site."""
    from pyspark.sql import Window

    x = cut(scored(spark, d).where("site = 'A'").select("encounter_id", "site", "hour", "label", "score"))  # outcomes, folds and scores all read it
    outcomes = cut(h.stay_outcomes(x))
    recent = F.sum(F.col("score").cast("long")).over(Window.partitionBy("encounter_id", "site").orderBy("hour").rowsBetween(-11, 0))
    sustained = x.select("encounter_id", "site", "hour", ((100 * F.col("score").cast("long") + recent) / F.lit(100.0)).alias("score"))
    return ev.rows_for(sustained, ev.folds(outcomes).where("fold = 0")), outcomes, x


@query("H11_search_matched_burden", _SEARCH.replace("{good}", "alerts_per_patient_day >= goal") + "SELECT threshold, alerts_per_patient_day, sensitivity FROM num, best, goal WHERE i IN (found, found + 1) ORDER BY abs(alerts_per_patient_day - goal), i DESC LIMIT 1")
def searched_burden(spark, d):
    held, outcomes, points = _held_out(spark, d)
    target = ev.event_metrics(ev.stay_summary(ev.apply_policy(points, POLICY), outcomes)).first().alerts_per_patient_day
    return ev.search_thresholds(held, outcomes, burden=target, rise_margin=2.0)


@query("H12_search_fixed_sensitivity", _SEARCH.replace("{good}", "coalesce(sensitivity >= 0.8, false)") + "SELECT threshold, alerts_per_patient_day, sensitivity FROM num, best WHERE i = greatest(found, 0)")
def searched_sensitivity(spark, d):
    held, outcomes, _ = _held_out(spark, d)
    return ev.search_thresholds(held, outcomes, sensitivity=0.8, rise_margin=2.0)


@query("H3_curves", f"WITH {NEWS_SQL}{_RANK}, g AS (SELECT max(tp) AS p, max(fp) AS n FROM c) SELECT 'roc' AS curve, CAST(s AS DOUBLE) AS threshold, round(fp / n, 9) AS x, round(tp / p, 9) AS y FROM c, g UNION ALL SELECT 'pr', CAST(s AS DOUBLE), round(tp / p, 9), round(tp / (tp + fp), 9) FROM c, g")
def curves(spark, d):
    return ev.curves(scored(spark, d), "label", "score")


@query("H9_bootstrap", WITH_ALERTS + """, st AS (SELECT *, row_number() OVER (ORDER BY site, encounter_id) - 1 AS i FROM summary), n AS (SELECT count(*) AS n FROM st),
dr AS (SELECT r, CAST('0x' || substr(md5('2019/' || r || '/' || j), 1, 8) AS BIGINT) % n AS i FROM n, range(1000) a(r), range(100000) b(j) WHERE j < n), w AS (SELECT r, i, count(*) AS w FROM dr GROUP BY 1, 2),
m AS (SELECT r, sum(CASE WHEN septic AND detected THEN w ELSE 0 END)::DOUBLE / sum(CASE WHEN septic THEN w END) AS a, sum(w * alerts) * CAST(24.0 AS DOUBLE) / sum(w * hours) AS b FROM w JOIN st USING (i) WHERE NOT excluded GROUP BY 1)
SELECT 'event_sensitivity' AS metric, round(quantile_cont(a, 0.025), 9) AS low, round(quantile_cont(a, 0.975), 9) AS high FROM m UNION ALL SELECT 'alerts_per_patient_day', round(quantile_cont(b, 0.025), 9), round(quantile_cont(b, 0.975), 9) FROM m""")
def bootstrapped(spark, d):
    return ev.bootstrap(_summary(spark, d))


@query("H21_cross_site_eval", WITH_ALERTS + """, t AS (SELECT site, score AS s, CAST(sum(label) AS DOUBLE) AS p, CAST(sum(1 - label) AS DOUBLE) AS n FROM scored GROUP BY 1, 2), c AS (SELECT site, p, n, sum(p) OVER (PARTITION BY site ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY site ORDER BY s DESC) AS fp FROM t),
ra AS (SELECT site, CASE WHEN max(tp) > 0 AND max(fp) > 0 THEN round(sum(n * (2 * tp - p) / 2) / max(tp) / max(fp), 9) END AS auroc, CASE WHEN max(tp) > 0 THEN round(sum(p * tp / (tp + fp)) / max(tp), 9) END AS auprc FROM c GROUP BY 1), br AS (SELECT site, round(avg((p - label) * (p - label)), 9) AS brier FROM scored GROUP BY 1),
es AS (SELECT site, round(sum(CASE WHEN septic AND detected THEN 1 ELSE 0 END) * CAST(1.0 AS DOUBLE) / sum(CASE WHEN septic THEN 1 END), 9) AS event_sensitivity, round(sum(alerts) * CAST(24.0 AS DOUBLE) / sum(hours), 9) AS alerts_per_patient_day FROM summary WHERE NOT excluded GROUP BY 1),
u AS (SELECT site, auroc, auprc, event_sensitivity, alerts_per_patient_day, brier FROM ra JOIN br USING (site) JOIN es USING (site))
SELECT CASE site WHEN 'A' THEN 'B' ELSE 'A' END AS train, site AS test, metric, value FROM (SELECT site, 'auroc' AS metric, auroc AS value FROM u UNION ALL SELECT site, 'auprc', auprc FROM u UNION ALL SELECT site, 'event_sensitivity', event_sensitivity FROM u UNION ALL SELECT site, 'alerts_per_patient_day', alerts_per_patient_day FROM u UNION ALL SELECT site, 'brier', brier FROM u)""")
def crossed(spark, d):
    return ev.cross_site(scored(spark, d), h.stay_outcomes(h.with_label(hours_of(spark, d))), POLICY)


@query("F8_stream_late", f"WITH {OBS_SQL}, s AS (SELECT encounter_id, hour < max(hour) OVER (PARTITION BY encounter_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM obs WHERE variable NOT IN ('FiO2', 'Lactate')) SELECT encounter_id, sum(CASE WHEN late THEN 1 ELSE 0 END)::BIGINT AS late, count(*) AS rows FROM s GROUP BY 1")
def late_rows(spark, d):
    x = h.late(observations(spark, d).where("variable not in ('FiO2', 'Lactate')"))
    return x.groupBy("encounter_id").agg(F.sum(F.col("late").cast("long")).alias("late"), F.count(F.lit(1)).alias("rows"))


@query("D9_restore_state", WITH_ALERTS + " SELECT encounter_id, site, max(hour) AS last_hour, max(CASE WHEN alert THEN hour END) AS alert_hour, CAST(arg_max(CASE WHEN alert THEN score END, CASE WHEN alert THEN hour END) AS DOUBLE) AS alert_score, greatest(1, max(hour) - 30) AS first_needed FROM walk GROUP BY 1, 2")
def restored(spark, d):
    a = alerts_of(spark, d)
    return h.restore_state(a, a)


@query("H20_data_fingerprint", WITH_ALERTS + ", st AS (SELECT encounter_id, site, count(*) AS n, sha256(string_agg(hour || ':' || label, ',' ORDER BY hour, label)) AS h FROM long GROUP BY 1, 2), nm AS (SELECT n, sha256(site || '/' || encounter_id || '/' || h) AS h FROM st), b AS (SELECT substr(h, 1, 3) AS b, count(*) AS stays, sum(n) AS rows, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM nm GROUP BY 1) SELECT CAST(sum(stays) AS BIGINT) AS stays, CAST(sum(rows) AS BIGINT) AS rows, sha256(string_agg(h, ',' ORDER BY b)) AS digest FROM b")
def data_fingerprint(spark, d):
    return ev.fingerprint(h.with_label(hours_of(spark, d)))


_SCALES = ", ".join(f"coalesce(avg({v}_last), 0) AS {v}_m, coalesce(nullif(stddev_pop({v}_last), 0), 1) AS {v}_s" for v in VARIABLES)
_SCALED = ", ".join(f"count({v}) AS measured_{v}, round(sum(coalesce(({v}_last - {v}_m) / {v}_s, 0)), 4) + 0.0::DOUBLE AS scaled_{v}" for v in VARIABLES)


@query("E15_sequence_features", f"WITH {HOURS_SQL}, {_lasts('wide')}, sc AS (SELECT {_SCALES} FROM lasts) SELECT encounter_id, count(*) AS steps, {_SCALED} FROM lasts, sc GROUP BY 1")
def sequences(spark, d):
    x = h.sequences(hours_of(spark, d))
    total = lambda k: F.aggregate("steps", F.lit(0.0), lambda a, r: a + r[k])
    both = ((total(f"{v}_mask").cast("long").alias(f"measured_{v}"), (F.round(total(f"{v}_scaled"), 4) + 0.0).alias(f"scaled_{v}")) for v in VARIABLES)
    return x.select("encounter_id", F.size("steps").cast("long").alias("steps"), *(c for pair in both for c in pair))


@query("A2_scan_sites_union", f"WITH {HOURS_SQL} SELECT site, encounter_id, hour, HR FROM wide WHERE site = 'A' UNION ALL SELECT site, encounter_id, hour, HR FROM wide WHERE site = 'B'")
def sites(spark, d):
    x = hours_of(spark, d).select("site", "encounter_id", "hour", "HR")
    return x.where("site = 'A'").unionByName(x.where("site = 'B'"))
