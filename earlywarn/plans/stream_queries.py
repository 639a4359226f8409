"""Streams over the observations of the event table, replayed from files in the order of arrival, with SQL of what they must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earlywarn.operators import evaluation as ev
from earlywarn.plans.clinical_queries import POLICY, WITH_ALERTS, scored
from earlywarn.session import new_dir
from earlywarn.sources import readers
from earlywarn.sources.capture import scan_capture
from earlywarn.sources.views import HOURS_SQL, OBS_SQL, observations, table
from earlywarn.streaming import scoring

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return add


def _replayed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return scoring.replay(spark, rows, new_dir(spark), {"news2": POLICY})


# events arrive in the order of time, so no record is late and all hours but a stay's last are closed by a later one
_OPEN = "hour < max(hour) OVER (PARTITION BY encounter_id)"


@query("F6_stream_dedupe", f"WITH {OBS_SQL} SELECT encounter_id, 'accepted' AS outcome, count(*) AS n FROM obs WHERE hour >= 1 GROUP BY 1 UNION ALL SELECT encounter_id, 'duplicate', count(*) FROM obs WHERE hour >= 1 AND seq % 3 = 0 GROUP BY 1")
def deduplicated(spark, d):
    """A third of all records arrive a second time, right after the first."""
    rows = observations(spark, d)
    again = rows.where("seq % 3 = 0").withColumn("seq", F.col("seq") + 0.5)
    every = rows.withColumn("seq", F.col("seq").cast("double")).unionByName(again)
    out = _replayed(spark, every).where("kind = 'outcome'").groupBy("encounter_id", "outcome").agg(F.sum("n").alias("n"))
    return out


@query("F7_stream_close_hours", f"WITH {HOURS_SQL} SELECT encounter_id, site, hour AS icu_hour, 'later hour' AS closed_by FROM (SELECT *, {_OPEN} AS closed FROM wide) WHERE closed")
def closed_hours(spark, d):
    return _replayed(spark, observations(spark, d)).where("kind = 'score'").select("encounter_id", "site", "icu_hour", "closed_by")


@query(
    "F9_stream_score",
    WITH_ALERTS + f""", done AS (SELECT * FROM (SELECT *, {_OPEN} AS closed FROM walk) WHERE closed)
SELECT 'score' AS kind, encounter_id, hour AS icu_hour, 'news2' AS source, CAST(score AS DOUBLE) AS raw_score, alert AS alerted FROM done
UNION ALL SELECT 'alert', encounter_id, hour, 'news2', CAST(score AS DOUBLE), NULL FROM done WHERE alert""",
)
def stream_scores(spark, d):
    return _replayed(spark, observations(spark, d)).where("kind <> 'outcome'").select("kind", "encounter_id", "icu_hour", "source", "raw_score", "alerted")


@query("F13_calibrated_parity", f"WITH {HOURS_SQL} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS differing FROM (SELECT *, {_OPEN} AS closed FROM wide) WHERE closed")
def parity(spark, d):
    """The probability of the stream's scores against that of the batch, hour by hour, for hours that are closed."""
    p = lambda score: 1 / (1 + F.exp(-(score - 5) / 2))
    online = _replayed(spark, observations(spark, d)).where("kind = 'score'").select("encounter_id", F.col("icu_hour").alias("hour"), p(F.col("raw_score")).alias("p"))
    batch = scored(spark, d).select("encounter_id", "hour", "p")
    last = batch.groupBy("encounter_id").agg(F.max("hour").alias("last"))
    return ev.parity(batch.join(last, "encounter_id").where("hour < last").drop("last"), online, ["encounter_id", "hour"], "p", 1e-6)


# --- captures and topics written from the events and read back ----------------------------------------------------------------------------
_CAPTURE_SQL = "ev AS (SELECT event_id, event_id || '|' || user_id || '|' || event_type || '|' || props AS body FROM events)"
MOST, KEPT = 36, 12


def _capture(spark: SparkSession, d: str) -> str:
    """The folder of captures of all events, a frame each: every third event after a frame that breaks off, every fifth without its trailer, every seventh after noise."""
    e = table(spark, d, "events")
    body = F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type", "props")
    broken, noise = F.when(F.col("event_id") % 3 == 0, "\x0bbroken").otherwise(""), F.when(F.col("event_id") % 7 == 0, "noise").otherwise("")
    line = F.concat(noise, broken, F.lit("\x0b"), body, F.lit("\x1c"), F.when(F.col("event_id") % 5 == 0, "").otherwise("\r"))
    path = new_dir(spark)
    e.select(line.alias("value")).write.text(path)
    return path


@query("A6_scan_mllp_capture", f"WITH {_CAPTURE_SQL} SELECT CAST(CASE WHEN length(body) > {MOST} THEN left(body, {KEPT}) ELSE body END AS VARCHAR) AS content, length(body) > {MOST} AS oversize, CAST(length(body) AS BIGINT) AS total_size, event_id % 5 = 0 AS missing_trailer FROM ev")
def scanned(spark, d):
    frames = scan_capture(spark, _capture(spark, d), MOST, KEPT)
    return frames.where("bytes is not null").select(F.decode("bytes", "UTF-8").alias("content"), "oversize", "total_size", "missing_trailer")


@query("A6_capture_statistics", f"WITH {_CAPTURE_SQL} SELECT count(*) AS frames, count(*) FILTER (WHERE length(body) > {MOST}) AS oversize, CAST(sum(1 + CASE WHEN event_id % 7 = 0 THEN 5 ELSE 0 END) AS BIGINT) AS outside_bytes, count(*) FILTER (WHERE event_id % 3 = 0) AS abandoned, count(*) FILTER (WHERE event_id % 5 = 0) AS missing_trailers FROM ev")
def capture_statistics(spark, d):
    f = scan_capture(spark, _capture(spark, d), MOST, KEPT)
    return f.agg(F.count("bytes").alias("frames"), F.count_if("oversize").alias("oversize"), F.sum("outside_bytes").alias("outside_bytes"), F.sum("abandoned").alias("abandoned"), F.count_if("missing_trailer").alias("missing_trailers"))


@query("A3_scan_topic_jsonl", "SELECT CAST(user_id AS VARCHAR) AS key, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id END AS event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS event_type FROM events")
def topic(spark, d):
    """Every fourth value breaks off and reads as null."""
    e = table(spark, d, "events")
    whole = F.to_json(F.struct("event_id", "event_type"))
    value = F.when(F.col("event_id") % 4 == 0, F.substring(whole, 1, 15)).otherwise(whole)
    path = new_dir(spark)
    e.select(F.col("user_id").cast("string").alias("key"), value.alias("value")).write.json(path)
    return readers.read_topic(spark, path, "event_id long, event_type string").select("key", "value.event_id", "value.event_type")


@query("A4_sink_topic_jsonl", "SELECT CAST(user_id AS VARCHAR) AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, event_id FROM events")
def ordered_topic(spark, d):
    """The events by user, in the order of time, as they are read back."""
    path = new_dir(spark)
    readers.write_topic(table(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), path, "user_id", ("ts", "event_id"))
    return readers.read_topic_places(spark, path, "event_id long").select("key", F.col("offset").alias("place"), "value.event_id")
