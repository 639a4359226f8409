"""Ward queries over patients, encounters, observations and scores; alert workflow."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earlywarn.sources.views import LOINC, table

CODES = [code for code, _ in LOINC.values()]
UNRESOLVED = ("open", "acknowledged", "escalated")


def ward_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Patients, encounters, observations and scores over the order tables."""
    t = {n: table(spark, sf_dir, n) for n in ("customer", "nation", "orders", "lineitem")}
    patients = t["customer"].join(F.broadcast(t["nation"]), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("MRN"), F.col("c_custkey").cast("string")).alias("mrn"), F.col("c_name").alias("family"), F.col("n_name").alias("given"))  # nation is a fixed code table
    encounters = t["orders"].select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("MRN"), F.col("o_custkey").cast("string")).alias("mrn"), F.when(F.col("o_orderstatus") == "F", "finished").otherwise("in-progress").alias("status"),
        F.concat(F.lit("ICU "), F.lpad((F.col("o_orderkey") % 40).cast("string"), 2, "0")).alias("bed"), F.col("o_orderdate").alias("period_start"),
    )
    code = F.element_at(F.array(*(F.lit(c) for c in CODES)), (F.col("l_partkey") % 13 + 1).cast("int"))
    li = t["lineitem"]
    observations = li.select(F.col("l_orderkey").alias("encounter_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("id"), code.alias("code"), F.col("l_shipdate").alias("effective"), F.col("l_quantity").alias("value"), F.col("l_returnflag").alias("flag"))
    scores = li.groupBy(F.col("l_orderkey").alias("encounter_id"), F.col("l_linenumber").alias("icu_hour")).agg(F.max(F.col("l_quantity").cast("int") % 16).alias("news2_total"))
    return {"patients": patients, "encounters": encounters, "observations": observations, "scores": scores}


def latest_per_code(obs: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """The newest value of each code of an encounter; ties go to the greater id."""
    obs = obs.where(F.col("code").isin(codes)) if codes else obs
    return obs.groupBy("encounter_id", "code").agg(F.max(F.struct("effective", "id", "value")).alias("m")).select("encounter_id", "code", "m.effective", "m.value")


def last_n_scores(scores: DataFrame, n: int = 12) -> DataFrame:
    w = Window.partitionBy("encounter_id").orderBy(F.desc("icu_hour"))
    return scores.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def unresolved(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("status").isin(*UNRESOLVED)).groupBy("encounter_id").agg(F.count(F.lit(1)).alias("unresolved"))


def census(encounters: DataFrame, patients: DataFrame, obs: DataFrame, scores: DataFrame, alerts: DataFrame, codes: list[str] | None = None, n: int = 12) -> DataFrame:
    """Beds in use: patient, latest vital signs, latest scores as a trend, open alerts. Everything is grouped by encounter before it is joined."""
    vitals = latest_per_code(obs, codes or CODES[:5]).groupBy("encounter_id").agg(F.count(F.lit(1)).alias("n_vitals"), F.round(F.sum("value"), 6).alias("vitals_sum"))
    trend = last_n_scores(scores, n).groupBy("encounter_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("icu_hour", "news2_total"))), lambda s: s["news2_total"]).alias("t"))
    base = encounters.where("status = 'in-progress'").join(patients, "mrn").withColumnRenamed("id", "encounter_id")
    out = base.join(vitals, "encounter_id", "left").join(trend, "encounter_id", "left").join(unresolved(alerts), "encounter_id", "left")
    return out.select("encounter_id", "mrn", "family", "given", "bed", F.coalesce("n_vitals", F.lit(0)).alias("n_vitals"), "vitals_sum", F.array_join("t", ",").alias("trend"), F.element_at(F.when(F.size("t") > 0, F.col("t")), -1).alias("latest_score"), F.coalesce("unresolved", F.lit(0)).alias("unresolved"))


def patient_encounter(encounters: DataFrame) -> DataFrame:
    """The encounter shown for each patient: in progress first, then the newest start."""
    w = Window.partitionBy("mrn").orderBy(F.desc(F.col("status") == "in-progress"), F.desc_nulls_last("period_start"), "id")
    return encounters.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def patient_vitals(encounters: DataFrame, obs: DataFrame, hours: int = 12) -> DataFrame:
    """Series of each shown encounter within ``hours`` of its newest observation."""
    shown = patient_encounter(encounters).select(F.col("id").alias("encounter_id"), "mrn")
    own = obs.join(shown, "encounter_id")
    newest = F.max("effective").over(Window.partitionBy("encounter_id"))
    inside = own.withColumn("newest", newest).where(F.col("effective") >= F.timestamp_add("HOUR", F.lit(-hours), F.col("newest")))
    return inside.groupBy("mrn", "encounter_id", "code").agg(F.count(F.lit(1)).alias("points"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("effective", "id", "value"))), lambda s: s["value"].cast("int").cast("string")), ",").alias("series"))


#: The form of a search date.
_DATE = re.compile(r"(eq|ne|lt|le|gt|ge)?((\d{4})(?:-(\d\d)(?:-(\d\d)(?:T(\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,6}))?)?(Z|[+-]\d\d:\d\d)?)?)?)?)")


def date_interval(value: str) -> tuple[str, datetime, datetime]:
    """Prefix and [start, end) of a search date at its own precision, in UTC. A time without a zone is UTC; days, months and years have no zone."""
    m = _DATE.fullmatch(value)
    if not m:
        raise ValueError(f"not a date parameter: {value}")
    year, month, day, hour, minute, second, fraction, zone = m.groups()[2:]
    try:
        local = datetime(int(year), int(month or 1), int(day or 1), int(hour or 0), int(minute or 0), int(second or 0), int((fraction or "").ljust(6, "0")))
    except ValueError as error:
        raise ValueError(f"not a valid date: {value}") from error
    shift = timedelta(0)
    if zone and zone != "Z":
        if zone[1:3] > "23" or zone[4:] > "59":
            raise ValueError(f"not a zone of a date: {value}")
        shift = timedelta(hours=int(zone[1:3]), minutes=int(zone[4:])) * (-1 if zone[0] == "-" else 1)
    start = local - shift
    if day is None:  # the first of the next year or month; the calendar ends with 9999
        after = local.year * 12 + local.month - 1 + (12 if month is None else 1)
        end = datetime(after // 12, after % 12 + 1, 1) if after < 120_000 else datetime.max
    else:
        end = start + (timedelta(days=1) if hour is None else timedelta(minutes=1) if second is None else timedelta(microseconds=10 ** (6 - len(fraction or ""))))
    return m[1] or "eq", start, end


def date_condition(column: Column, value: str) -> Column:
    """A range predicate that reaches the scan."""
    op, start, end = date_interval(value)
    lo, hi = F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz"), F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz")
    inside = (column >= lo) & (column < hi)
    return {"eq": inside, "ne": ~inside, "lt": column < lo, "le": column < hi, "gt": column >= hi, "ge": column >= lo}[op]


def search_observations(obs: DataFrame, subject: str | None = None, code: str | None = None, dates: tuple[str, ...] = (), sort: str = "-date", count: int = 50, offset: int = 0, system: str = "http://loinc.org") -> tuple[DataFrame, DataFrame]:
    """A page of matching observations and the total."""
    if not 1 <= count <= 1000 or offset < 0 or sort not in ("date", "-date"):
        raise ValueError("count, offset or sort out of range")
    if subject is not None:
        obs = obs.where(F.col("mrn") == subject.removeprefix("Patient/"))
    if code is not None:
        given, bar, plain = code.rpartition("|")
        obs = obs.where(F.lit(False)) if bar and given not in ("", system) else obs.where(F.col("code") == plain)
    for d in dates:
        obs = obs.where(date_condition(F.col("effective"), d))
    order = [F.desc("effective") if sort == "-date" else F.asc("effective"), F.asc("id")]
    return obs.orderBy(*order).offset(offset).limit(count), obs.agg(F.count(F.lit(1)).alias("total"))


#: Legal transitions of an alert.
TRANSITIONS = {("open", "acknowledge"): "acknowledged", ("open", "escalate"): "escalated", ("acknowledged", "escalate"): "escalated", ("acknowledged", "resolve"): "resolved", ("escalated", "resolve"): "resolved"}


def alert_actions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Alerts (error events) and what users do within twelve hours after, as (alert_id, seq, transition, actor, expected)."""
    ev = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    alerts = ev.where("event_type = 'error'").select(F.col("event_id").alias("alert_id"), F.col("user_id").alias("encounter_id"), F.when(F.col("k") % 2 == 0, "model").otherwise("news2").alias("source"), F.col("ts").cast("timestamp_ntz").alias("raised_at"), "k", (F.col("value") / 30).alias("score"))
    does = F.when(F.col("event_type") == "click", "acknowledge").when(F.col("event_type") == "purchase", "escalate").when(F.col("event_type") == "signup", "resolve")
    acts = ev.withColumn("transition", does).where("transition is not null").select(F.col("user_id").alias("encounter_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp_ntz").alias("acted_at"), "transition", F.col("k").alias("ak"), F.concat(F.lit("clin"), (F.col("user_id") % 5).cast("string")).alias("actor"))
    # within twelve hours: meet by user and half day, so a user with many events is not crossed with itself
    bucket = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 43_200_000_000)
    left = alerts.withColumn("b", F.explode(F.array(bucket(F.col("raised_at")), bucket(F.col("raised_at")) + 1)))
    j = left.join(acts.withColumn("b", bucket(F.col("acted_at"))), ["encounter_id", "b"]).where((F.col("acted_at") > F.col("raised_at")) & (F.col("acted_at") <= F.timestamp_add("HOUR", F.lit(12), F.col("raised_at"))))
    n = F.row_number().over(Window.partitionBy("alert_id").orderBy("seq"))
    actions = j.withColumn("n", n).select("alert_id", "seq", "acted_at", "transition", "actor", (F.col("n") - F.when(F.col("ak") % 3 == 0, 1).otherwise(0)).cast("int").alias("expected"))
    return alerts, actions


def replay(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per action with its result: applied, 412 (stale version), 409 (illegal), 404 (unknown alert); and the state after it. A fold per alert."""
    rows = actions.groupBy("alert_id").agg(F.sort_array(F.collect_list(F.struct("seq", "acted_at", "transition", "actor", "expected"))).alias("acts"))
    rows = rows.join(alerts.select("alert_id", F.lit(True).alias("known")), "alert_id", "left")
    target = lambda status, tr: F.coalesce(*(F.when((status == s) & (tr == t), to) for (s, t), to in TRANSITIONS.items()))
    out_type = "array<struct<seq:bigint,acted_at:timestamp_ntz,transition:string,actor:string,result:string,from_status:string,to_status:string,version:int>>"
    start = F.struct(F.lit("open").alias("status"), F.lit(1).alias("version"), F.array().cast(out_type).alias("log"))

    def step(acc: Column, a: Column) -> Column:
        to = target(acc["status"], a["transition"])
        result = F.when(a["expected"] != acc["version"], "412").when(to.isNull(), "409").otherwise("applied")
        done = result == "applied"
        status, version = F.when(done, to).otherwise(acc["status"]), acc["version"] + F.when(done, 1).otherwise(0)
        entry = F.struct(a["seq"].alias("seq"), a["acted_at"].alias("acted_at"), a["transition"].alias("transition"), a["actor"].alias("actor"), result.alias("result"), acc["status"].alias("from_status"), status.alias("to_status"), version.cast("int").alias("version"))
        return F.struct(status.alias("status"), version.cast("int").alias("version"), F.concat(acc["log"], F.array(entry)).alias("log"))

    log = F.aggregate("acts", start, step, lambda acc: acc["log"])
    e = rows.select("alert_id", "known", F.explode(log).alias("e"))
    unknown = F.col("known").isNull()
    return e.select("alert_id", "e.seq", "e.acted_at", "e.transition", "e.actor", F.when(unknown, "404").otherwise(F.col("e.result")).alias("result"), "e.from_status", F.when(unknown, F.col("e.from_status")).otherwise(F.col("e.to_status")).alias("to_status"), "e.version")


def audit_log(results: DataFrame) -> DataFrame:
    return results.where("result = 'applied'").select("alert_id", "seq", "transition", "from_status", "to_status", "actor", "version")


def current_alerts(alerts: DataFrame, results: DataFrame) -> DataFrame:
    """Alerts with status, version and updated_at after all applied actions."""
    last = results.where("result = 'applied'").groupBy("alert_id").agg(F.max_by(F.struct("to_status", "version", "acted_at", "actor"), "seq").alias("l"))
    return alerts.join(last, "alert_id", "left").select(*alerts.columns, F.coalesce("l.to_status", F.lit("open")).alias("status"), F.coalesce("l.version", F.lit(1)).alias("version"), F.coalesce("l.acted_at", "raised_at").alias("updated_at"), F.col("l.actor").alias("updated_by"))


def overdue(alerts: DataFrame, as_of: str, after_minutes: int = 15) -> DataFrame:
    """Open alerts not touched for ``after_minutes`` before ``as_of``, as the system's escalations."""
    limit = F.timestamp_add("MINUTE", F.lit(-after_minutes), F.lit(as_of).cast("timestamp_ntz"))
    return alerts.where((F.col("status") == "open") & (F.col("updated_at") < limit)).select("alert_id", F.lit("escalate").alias("transition"), F.lit("system").alias("actor"), F.lit("unacknowledged_timeout").alias("reason"), F.col("version").alias("expected"))
