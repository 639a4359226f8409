"""Ward views, workflow and operational tables: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.functions.clinical import hour_ending
from earlywarn.operators import operations as op
from earlywarn.operators import ward as wd
from earlywarn.operators.dates import date_join
from earlywarn.operators.ordered import running
from earlywarn.operators.store import Store
from earlywarn.session import cut, new_dir
from earlywarn.sources.views import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_CODES = "[" + ", ".join(f"'{c}'" for c in wd.CODES) + "]"
WARD_SQL = f"""
patients AS (SELECT 'MRN' || c_custkey AS mrn, c_name AS family, n_name AS given FROM customer JOIN nation ON c_nationkey = n_nationkey),
encounters AS (SELECT o_orderkey AS id, 'MRN' || o_custkey AS mrn, CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'in-progress' END AS status, 'ICU ' || lpad(CAST(o_orderkey % 40 AS VARCHAR), 2, '0') AS bed, o_orderdate AS period_start FROM orders),
observations AS (SELECT l_orderkey AS encounter_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, {_CODES}[CAST(l_partkey % 13 + 1 AS INTEGER)] AS code, l_shipdate AS effective, l_quantity AS value, l_returnflag AS flag FROM lineitem),
scores AS (SELECT l_orderkey AS encounter_id, l_linenumber AS icu_hour, max(CAST(l_quantity AS INTEGER) % 16) AS news2_total FROM lineitem GROUP BY 1, 2)"""
_LATEST = "latest AS (SELECT encounter_id, code, effective, value FROM (SELECT *, row_number() OVER (PARTITION BY encounter_id, code ORDER BY effective DESC, id DESC, value DESC) AS rn FROM observations) WHERE rn = 1)"

ACTION_SQL = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
alerts AS (SELECT event_id AS alert_id, user_id AS encounter_id, CASE WHEN k % 2 = 0 THEN 'model' ELSE 'news2' END AS source, ts AS raised_at, k, value / 30 AS score FROM ev WHERE event_type = 'error'),
acts AS (SELECT user_id AS encounter_id, event_id AS seq, ts AS acted_at, CASE event_type WHEN 'click' THEN 'acknowledge' WHEN 'purchase' THEN 'escalate' WHEN 'signup' THEN 'resolve' END AS transition, k AS ak, 'clin' || (user_id % 5) AS actor FROM ev WHERE event_type IN ('click', 'purchase', 'signup')),
actions AS (SELECT a.alert_id, c.seq, c.acted_at, c.transition, c.actor, row_number() OVER (PARTITION BY a.alert_id ORDER BY c.seq) AS n, row_number() OVER (PARTITION BY a.alert_id ORDER BY c.seq) - CASE WHEN c.ak % 3 = 0 THEN 1 ELSE 0 END AS expected
            FROM alerts a JOIN acts c ON a.encounter_id = c.encounter_id AND c.acted_at > a.raised_at AND c.acted_at <= a.raised_at + INTERVAL 12 HOUR),
walk(alert_id, n, seq, acted_at, transition, actor, result, from_status, to_status, version) AS (
  SELECT alert_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 'open', 1 FROM alerts
  UNION ALL
  SELECT w.alert_id, a.n, a.seq, a.acted_at, a.transition, a.actor, f.result, w.to_status, CASE WHEN f.result = 'applied' THEN f.t ELSE w.to_status END, w.version + CASE WHEN f.result = 'applied' THEN 1 ELSE 0 END
  FROM walk w JOIN actions a ON a.alert_id = w.alert_id AND a.n = w.n + 1,
  LATERAL (SELECT t, CASE WHEN a.expected <> w.version THEN '412' WHEN t IS NULL THEN '409' ELSE 'applied' END AS result FROM (SELECT CASE
    WHEN w.to_status = 'open' AND a.transition = 'acknowledge' THEN 'acknowledged' WHEN w.to_status = 'open' AND a.transition = 'escalate' THEN 'escalated'
    WHEN w.to_status = 'acknowledged' AND a.transition = 'escalate' THEN 'escalated' WHEN w.to_status IN ('acknowledged', 'escalated') AND a.transition = 'resolve' THEN 'resolved' END AS t)) f),
results AS (SELECT alert_id, seq, acted_at, transition, actor, result, from_status, to_status, version FROM walk WHERE n > 0),
state AS (SELECT a.*, coalesce(l.to_status, 'open') AS status, coalesce(l.version, 1) AS version, coalesce(l.acted_at, a.raised_at) AS updated_at, l.actor AS updated_by FROM alerts a LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY seq DESC) AS rn FROM results WHERE result = 'applied') WHERE rn = 1) l ON a.alert_id = l.alert_id)"""
WITH_ACTIONS = "WITH RECURSIVE " + ACTION_SQL


def _replayed(spark, d):
    alerts, actions = wd.alert_actions(spark, d)
    return alerts, wd.replay(alerts, actions)


def _state(spark, d):
    return wd.current_alerts(*_replayed(spark, d))


@query("G1_replay_workflow", WITH_ACTIONS + " SELECT * FROM results")
def replayed(spark, d):
    return _replayed(spark, d)[1]


@query("G2_alert_events_log", WITH_ACTIONS + " SELECT alert_id, seq, transition, from_status, to_status, actor, version FROM results WHERE result = 'applied'")
def audit(spark, d):
    return wd.audit_log(_replayed(spark, d)[1])


@query("G3_escalate_overdue", WITH_ACTIONS + " SELECT alert_id, 'escalate' AS transition, 'system' AS actor, 'unacknowledged_timeout' AS reason, version AS expected FROM state WHERE status = 'open' AND updated_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 15 MINUTE")
def overdue(spark, d):
    return wd.overdue(_state(spark, d), "2024-01-20 00:00:00")


@query("G4_list_alerts", WITH_ACTIONS + " SELECT alert_id, encounter_id, source, raised_at, status, row_number() OVER (ORDER BY raised_at DESC, alert_id) AS place FROM state WHERE status IN ('open', 'acknowledged')")
def listed(spark, d):
    x = _state(spark, d).where(F.col("status").isin("open", "acknowledged"))
    return _placed(x, [F.desc("raised_at"), F.asc("alert_id")]).select("alert_id", "encounter_id", "source", "raised_at", "status", "place")


def _placed(df, order):
    """Number rows by day first, so that only counts of days are ordered in one place."""
    day = F.to_date("raised_at")
    counts = df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    newest_first = "DESC" in str(order[0])
    w = Window.orderBy(F.desc("day") if newest_first else F.asc("day")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("day", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    inner = df.withColumn("day", day).withColumn("r", F.row_number().over(Window.partitionBy("day").orderBy(*order)))
    return inner.join(counts, "day").withColumn("place", F.col("r") + F.col("before"))


_SEV = "CASE WHEN score >= 7 THEN 3 WHEN score >= 5 OR source <> 'news2' THEN 2 ELSE 0 END"


@query("G5_inbox_order", WITH_ACTIONS + f", i AS (SELECT *, {_SEV} AS rank FROM state WHERE status IN ('open', 'acknowledged', 'escalated')) SELECT alert_id, rank, row_number() OVER (PARTITION BY rank ORDER BY raised_at, alert_id) AS place FROM i")
def inbox(spark, d):
    rank = F.when(F.col("score") >= 7, 3).when((F.col("score") >= 5) | (F.col("source") != "news2"), 2).otherwise(0)
    x = _state(spark, d).where(F.col("status").isin(*wd.UNRESOLVED)).withColumn("rank", rank)
    return running(x, ["rank"], [F.col("raised_at"), F.col("alert_id")], {"place": F.lit(1)}).select("alert_id", "rank", "place")


@query("G6_census", f"WITH {WARD_SQL}, {_LATEST}, ua AS (SELECT encounter_id, count(*) AS u FROM observations WHERE flag = 'R' GROUP BY 1), v AS (SELECT encounter_id, count(*) AS n_vitals, round(sum(value), 6) AS vitals_sum FROM latest WHERE list_contains({_CODES}[1:5], code) GROUP BY 1), t AS (SELECT encounter_id, string_agg(CAST(news2_total AS VARCHAR), ',' ORDER BY icu_hour) AS trend, arg_max(news2_total, icu_hour) AS latest_score FROM (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY icu_hour DESC) AS rn FROM scores) WHERE rn <= 12 GROUP BY 1) SELECT e.id AS encounter_id, e.mrn, family, given, bed, coalesce(n_vitals, 0) AS n_vitals, vitals_sum, trend, latest_score, coalesce(u, 0) AS unresolved FROM encounters e JOIN patients p ON e.mrn = p.mrn LEFT JOIN v ON v.encounter_id = e.id LEFT JOIN t ON t.encounter_id = e.id LEFT JOIN ua ON ua.encounter_id = e.id WHERE e.status = 'in-progress'")
def census(spark, d):
    t = wd.ward_tables(spark, d)
    alerts = t["observations"].where("flag = 'R'").select("encounter_id", F.lit("open").alias("status"))
    return wd.census(t["encounters"], t["patients"], t["observations"], t["scores"], alerts)


@query("G7_latest_per_code", f"WITH {WARD_SQL}, {_LATEST} SELECT * FROM latest")
def latest(spark, d):
    return wd.latest_per_code(wd.ward_tables(spark, d)["observations"])


@query("G8_last_n_scores", f"WITH {WARD_SQL} SELECT encounter_id, icu_hour, news2_total FROM (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY icu_hour DESC) AS rn FROM scores) WHERE rn <= 12")
def last_scores(spark, d):
    return wd.last_n_scores(wd.ward_tables(spark, d)["scores"], 12)


@query("G9_unresolved_counts", WITH_ACTIONS + " SELECT encounter_id, count(*) AS unresolved FROM state WHERE status IN ('open', 'acknowledged', 'escalated') GROUP BY 1")
def unresolved(spark, d):
    return wd.unresolved(_state(spark, d))


@query("G10_patient_vitals", f"WITH {WARD_SQL}, shown AS (SELECT id AS encounter_id, mrn FROM (SELECT *, row_number() OVER (PARTITION BY mrn ORDER BY status = 'in-progress' DESC, period_start DESC NULLS LAST, id) AS rn FROM encounters) WHERE rn = 1), o AS (SELECT s.mrn, b.*, max(effective) OVER (PARTITION BY b.encounter_id) AS newest FROM observations b JOIN shown s USING (encounter_id)) SELECT mrn, encounter_id, code, count(*) AS points, string_agg(CAST(CAST(value AS INTEGER) AS VARCHAR), ',' ORDER BY effective, id, value) AS series FROM o WHERE effective >= newest - INTERVAL 720 HOUR GROUP BY 1, 2, 3")
def vitals(spark, d):
    t = wd.ward_tables(spark, d)
    return wd.patient_vitals(t["encounters"], t["observations"], 720)


@query("G11_alert_marker_times", f"WITH {WARD_SQL} SELECT s.encounter_id, s.icu_hour, e.period_start + to_hours(s.icu_hour) AS marker FROM scores s JOIN encounters e ON s.encounter_id = e.id WHERE news2_total >= 7")
def markers(spark, d):
    t = wd.ward_tables(spark, d)
    start = t["encounters"].select(F.col("id").alias("encounter_id"), F.col("period_start").cast("timestamp_ntz").alias("s"))
    return t["scores"].where("news2_total >= 7").join(start, "encounter_id").select("encounter_id", "icu_hour", hour_ending(F.col("s"), F.col("icu_hour").cast("int")).alias("marker"))


@query("G12_search_observations", f"WITH {WARD_SQL} SELECT encounter_id, id, effective, value FROM observations WHERE code = '8867-4' AND effective >= TIMESTAMP '1997-01-01' AND effective < TIMESTAMP '1997-07-01' ORDER BY effective DESC, id LIMIT 50 OFFSET 50")
def search(spark, d):
    o = wd.ward_tables(spark, d)["observations"]
    page, _ = wd.search_observations(o, code="http://loinc.org|8867-4", dates=("ge1997", "lt1997-07"), offset=50)
    return page.select("encounter_id", "id", "effective", "value")


@query("G13_date_interval_filter", "WITH w AS (SELECT * FROM (VALUES ('eq1996-03', TIMESTAMP '1996-03-01', TIMESTAMP '1996-04-01'), ('eq1997', TIMESTAMP '1997-01-01', TIMESTAMP '1998-01-01'), ('eq1998-02-05', TIMESTAMP '1998-02-05', TIMESTAMP '1998-02-06')) t(p, a, b)) SELECT p AS param, count(*) AS n FROM lineitem JOIN w ON l_shipdate >= a AND l_shipdate < b GROUP BY 1")
def date_filter(spark, d):
    li = table(spark, d, "lineitem")
    out = None
    for p in ("eq1996-03", "eq1997", "eq1998-02-05"):
        one = li.where(wd.date_condition(F.col("l_shipdate").cast("timestamp_ntz"), p)).groupBy(F.lit(p).alias("param")).agg(F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


# for every day of the events: a day, a month, half past six in two zones, the second after noon, and a date that is none
_ASKED = {"": ("", "INTERVAL 0 HOUR", "INTERVAL 1 DAY"), "lt": ("", "INTERVAL 0 HOUR", None), "gt": ("T06:30+05:45", "INTERVAL 45 MINUTE", "INTERVAL 1 MINUTE"), "le": ("T06:30-23:30", "INTERVAL 30 HOUR", "INTERVAL 1 MINUTE"), "ge": ("T12:00:01", "INTERVAL 43201 SECOND", None), "ne": ("T12:00:01.5", "INTERVAL 43201500 MILLISECOND", "INTERVAL 100 MILLISECOND")}
_HOLDS = {"": "ts >= a AND ts < b", "lt": "ts < a", "gt": "ts >= b", "le": "ts < b", "ge": "ts >= a", "ne": "NOT (ts >= a AND ts < b)"}
_ASKED_SQL = " UNION ALL ".join(f"SELECT '{op}' || strftime(day, '%Y-%m-%d') || '{tail}' AS param, day + {start} AS a, day + {start} + {step or 'INTERVAL 0 HOUR'} AS b, '{op}' AS op FROM days" for op, (tail, start, step) in _ASKED.items())


@query("G13_date_join", f"WITH days AS (SELECT DISTINCT date_trunc('day', ts) AS day FROM events), asked AS ({_ASKED_SQL}), hit AS (SELECT param, event_id FROM asked JOIN events ON CASE op {' '.join(f"WHEN '{op}' THEN {test}" for op, test in _HOLDS.items())} END) SELECT param, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM hit GROUP BY 1")
def date_params(spark, d):
    """Each day of the events asked for in six forms; the parameters are a table."""
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    day = F.date_format("ts", "yyyy-MM-dd")
    asked = e.select(day.alias("day")).distinct()
    forms = F.array(*(F.concat(F.lit(op), F.col("day"), F.lit(tail)) for op, (tail, _, _) in _ASKED.items()), F.concat(F.col("day"), F.lit("T25:00")))
    return date_join(e, asked.select(F.explode(forms).alias("param")), "ts").groupBy("param").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("G14_search_patients", f"WITH {WARD_SQL} SELECT * FROM patients ORDER BY mrn LIMIT 50")
def patients(spark, d):
    return wd.ward_tables(spark, d)["patients"].orderBy("mrn").limit(50)


# --- current state from a message log ---------------------------------------------------------------------------------------------------
@query("C6_upsert_patients", "SELECT user_id AS id, coalesce(arg_max(value, event_id) FILTER (WHERE event_type = 'signup'), arg_min(value, event_id) FILTER (WHERE event_type <> 'signup')) AS resource FROM events GROUP BY 1")
def upsert_patients(spark, d):
    adt = F.col("event_type") == "signup"
    log = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), adt.alias("authoritative"), F.struct("value").alias("resource"), F.col("ts").alias("at"))
    return _stored(log).select("id", "resource.value").withColumnRenamed("value", "resource")


def _stored(log: DataFrame) -> DataFrame:
    """A message log merged into a stored table by batches: the first half of each key's rows, then all of them, these once more, then the second half again."""
    spark = log.sparkSession
    rank = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
    half = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("id")) / 2)
    placed = cut(log.withColumn("_early", rank <= half))  # each merge reads its rows twice
    store = Store(spark, new_dir(spark))
    log = placed.drop("_early")
    store.merge(placed.where("_early").drop("_early"), 1)
    store.merge(log, 2)  # what is new, and all that was sent before
    store.merge(log, 2)
    store.merge(placed.where("not _early").drop("_early"), 3)
    return store.read()


@query("C8_upsert_observations", "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1")
def upsert_observations(spark, d):
    seq = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    log = table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("id"), seq.alias("seq"), F.lit(True).alias("authoritative"), F.struct("l_quantity").alias("resource"), F.col("l_shipdate").alias("at"))
    return _stored(log).select("id.l_orderkey", "id.l_linenumber", "resource.l_quantity")


@query("C9_change_detect", "WITH x AS (SELECT user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id, max(ts) AS updated_at FROM x WHERE event_type IS DISTINCT FROM before GROUP BY 1")
def changes(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.lit(True).alias("authoritative"), F.struct("event_type").alias("resource"), F.col("ts").alias("at"))
    return _stored(log).select(F.col("id").alias("user_id"), "updated_at")


@query("C10_vitals_events", f"WITH {WARD_SQL} SELECT encounter_id, max(effective) AS newest, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM observations GROUP BY 1")
def vitals_events(spark, d):
    o = wd.ward_tables(spark, d)["observations"]
    return o.groupBy("encounter_id").agg(F.max("effective").alias("newest"), F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"))


@query("C5_observation_records", "WITH u AS (SELECT user_id, event_id, event_type, ts, last_value(CASE WHEN event_type = 'signup' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS encounter_start FROM events) SELECT event_id, encounter_start FROM u WHERE event_type <> 'signup'")
def records(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(F.col("event_type") == "signup", F.col("ts")), True).over(w)
    return table(spark, d, "events").withColumn("encounter_start", start).where("event_type <> 'signup'").select("event_id", "encounter_start")


@query("F11_store_alerts_once", "SELECT event_id AS alert_id, 'open' AS status, 1 AS version FROM events WHERE event_type = 'error' AND user_id % 3 <> 0")
def store_once(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("alert_id"), "user_id")
    stored = e.where("user_id % 3 = 0").select("alert_id")
    return e.unionByName(e).dropDuplicates(["alert_id"]).join(stored, "alert_id", "left_anti").select("alert_id", F.lit("open").alias("status"), F.lit(1).alias("version"))


# --- operations -------------------------------------------------------------------------------------------------------------------------
@query("J1_throughput", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def throughput(spark, d):
    return op.throughput(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query("J2_rejects_by_code", "SELECT time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 2 HOUR * i AS window_start, event_type, count(*) AS n FROM events, range(3) r(i) GROUP BY 1, 2")
def sliding(spark, d):
    return op.sliding_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query("J3_alert_burden", WITH_ACTIONS + " SELECT source, count(*) AS alerts, round(count(*) * CAST(24.0 AS DOUBLE) / (SELECT count(*) FROM events), 9) AS per_patient_day FROM alerts GROUP BY ROLLUP (source)")
def burden(spark, d):
    return op.burden(table(spark, d, "events"), wd.alert_actions(spark, d)[0])


@query("J4_open_alerts", WITH_ACTIONS + ", m AS (SELECT CAST(raised_at AS DATE) AS day, 1 AS d FROM alerts UNION ALL SELECT CAST(acted_at AS DATE), -1 FROM results WHERE result = 'applied' AND from_status = 'open'), s AS (SELECT day, sum(d) AS d FROM m GROUP BY 1) SELECT day, CAST(sum(d) OVER (ORDER BY day) AS BIGINT) AS open_alerts FROM s")
def open_alerts(spark, d):
    return op.open_over_time(*_replayed(spark, d))


@query("J5_time_to_ack", WITH_ACTIONS + ", s AS (SELECT (epoch_us(r.acted_at) - epoch_us(a.raised_at)) / CAST(1000000 AS DOUBLE) AS s FROM alerts a JOIN results r ON a.alert_id = r.alert_id WHERE r.result = 'applied' AND r.transition = 'acknowledge' AND r.version = 2) SELECT count(*) AS n, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.9), 6) AS p90 FROM s")
def time_to_ack(spark, d):
    return op.time_to_ack(*_replayed(spark, d))


@query("J6_transition_counts", WITH_ACTIONS + ", t AS (SELECT transition, CASE WHEN actor = 'system' THEN 'system' ELSE 'clinician' END AS kind FROM results WHERE result = 'applied') SELECT transition, kind, count(*) AS n FROM t GROUP BY CUBE (transition, kind)")
def transitions(spark, d):
    return op.transitions(_replayed(spark, d)[1])


@query("J7_alert_latency", "SELECT event_id, greatest(CAST(0 AS DOUBLE), value / 10 - 1) AS seconds FROM events WHERE value IS NOT NULL")
def latency(spark, d):
    return table(spark, d, "events").where("value is not null").select("event_id", F.greatest(F.lit(0.0), F.col("value") / 10 - 1).alias("seconds"))


_BOUNDS = [0.5, 1.0, 2.5, 5.0, 10.0, 25.0]
_HIST = "h AS (" + " UNION ALL ".join(f"SELECT event_type, '{b}' AS le, CAST({b} AS DOUBLE) AS bound, CAST(sum(CASE WHEN value / 10 <= {b} THEN 1 ELSE 0 END) AS BIGINT) AS n FROM events GROUP BY 1" for b in _BOUNDS) + " UNION ALL SELECT event_type, '+Inf', CAST('Infinity' AS DOUBLE), count(value) FROM events GROUP BY 1)"


def _hist(spark, d):
    return op.histogram(table(spark, d, "events").withColumn("s", F.col("value") / 10), "s", _BOUNDS, ("event_type",))


@query("J8_histogram_buckets", f"WITH {_HIST} SELECT event_type, le, n FROM h")
def histogram(spark, d):
    return _hist(spark, d).select("event_type", "le", "n")


@query("J9_histogram_quantile", f"WITH {_HIST}, x AS (SELECT *, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(bound) OVER w, 0) AS low, max(n) OVER (PARTITION BY event_type) * 0.9 AS rank FROM h WINDOW w AS (PARTITION BY event_type ORDER BY bound)), m AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bound) AS rn FROM x WHERE n >= rank) SELECT event_type, round(CASE WHEN isinf(bound) THEN low ELSE low + (bound - low) * (rank - below) / CASE WHEN n > below THEN n - below ELSE 1 END END, 9) AS quantile FROM m WHERE rn = 1")
def hist_quantile(spark, d):
    return op.histogram_quantile(_hist(spark, d), 0.9, ("event_type",))


@query("J10_outcome_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def counts(spark, d):
    return op.outcome_counts(table(spark, d, "events"), "event_type")


@query("J11_load_summary", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, count(*) AS n, " + ", ".join(f"max(CASE WHEN r = round_even({q} * (n - 1), 0) THEN value END) AS {a}" for q, a in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))) + ", max(value) AS max FROM r GROUP BY 1")
def load_summary(spark, d):
    return op.latency_summary(table(spark, d, "events"), "value", ("event_type",))
