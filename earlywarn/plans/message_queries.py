"""Messages rendered from the stays and parsed back: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earlywarn.operators import hl7, hourly
from earlywarn.sources.views import BUCKET_SQL, HOUR_SECONDS, LOINC, VARIABLES, observations, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def messages(spark, d):
    """One message per stay and hour with results."""
    obs = observations(spark, d)
    admitted = obs.groupBy("encounter_id").agg(F.min("admitted_at").alias("admitted_at"))
    return hl7.render(hourly.pivot_hours(hourly.last_in_hour(obs)).join(admitted, "encounter_id"), HOUR_SECONDS)


_MSG = BUCKET_SQL + ", msg AS (SELECT encounter_id, hour, count(*) AS n, encounter_id || '-' || hour AS msg_id, encounter_id * 100000 + hour AS seq, (encounter_id * 100000 + hour) % 20 AS k FROM bucket GROUP BY 1, 2)"
_CODE = "CASE variable " + " ".join(f"WHEN '{v}' THEN '{c}'" for v, (c, _) in LOINC.items()) + " END"
_ORDER = "CASE variable " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(VARIABLES)) + " END"
_ERROR = "CASE k WHEN 0 THEN 'MSH_MISSING' WHEN 1 THEN 'SEGMENT_MISSING' WHEN 2 THEN 'ENCODING_CHARACTERS_INVALID' WHEN 4 THEN 'VALUE_NOT_NUMERIC' WHEN 5 THEN 'TIMESTAMP_INVALID' WHEN 6 THEN 'MESSAGE_TYPE_UNSUPPORTED' WHEN 7 THEN 'MSH_MISSING' WHEN 8 THEN 'RESULT_STATUS_INVALID' END"


@query("B1_hl7_delimiters", f"WITH {_MSG} SELECT msg_id, CASE WHEN k IN (0, 7) THEN 'MSH_MISSING' WHEN k = 2 THEN 'ENCODING_CHARACTERS_INVALID' END AS header_error FROM msg")
def delimiters(spark, d):
    return hl7.with_delimiters(hl7.damaged(messages(spark, d))).select("msg_id", "header_error")


@query("B2_hl7_segments", f"WITH {_MSG} SELECT msg_id, n + 4 AS segments, n AS results FROM msg")
def segment_counts(spark, d):
    s = hl7.message_segments(messages(spark, d))
    return s.select("msg_id", F.size("segments").cast("long").alias("segments"), F.size(F.filter("segments", lambda x: x["id"] == "OBX")).cast("long").alias("results"))


@query("B3_hl7_pieces", f"WITH {_MSG} SELECT msg_id, 'MRN' || encounter_id AS mrn, 'MR' AS id_type, 'ENC' || encounter_id AS visit, 5 AS components FROM msg")
def pieces(spark, d):
    s = hl7.message_segments(messages(spark, d)).select("msg_id", F.filter("segments", lambda x: x["id"].isin("PID", "PV1")).alias("s")).where(F.size("s") > 0)
    top = lambda seg, n, f: F.array_max(F.transform(F.filter("s", lambda x: x["id"] == seg), lambda x: f(F.get(x["fields"], n))))
    return s.select("msg_id", top("PID", 3, lambda c: hl7.subcomponent(c, 1, 1)).alias("mrn"), top("PID", 3, lambda c: hl7.subcomponent(c, 1, 5)).alias("id_type"), top("PV1", 19, lambda c: c).alias("visit"), top("PID", 3, lambda c: hl7.piece_count(c, "^")).alias("components"))


@query("B4_hl7_nest", f"WITH {_MSG} SELECT msg_id, 'HOSP' AS assigner, 1 AS repetitions FROM msg")
def nested(spark, d):
    s = hl7.segments(messages(spark, d)).where("id = 'PID'").select("msg_id", hl7.nest(F.get("fields", 3)).alias("t"))
    return s.select("msg_id", F.get(F.get(F.get("t", 0), 3), 0).alias("assigner"), F.size("t").alias("repetitions"))


@query("B5_hl7_unescape", "SELECT doc_id, text, CAST(NULL AS VARCHAR) AS error FROM documents")
def unescaped(spark, d):
    x = table(spark, d, "documents").select("doc_id", hl7.escape(F.col("text")).alias("e"))
    return x.select("doc_id", hl7.unescape(F.col("e")).alias("u")).select("doc_id", "u.text", "u.error")


@query("B6_hl7_escape", r"SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(text, '\', '\E\'), '|', '\F\'), '^', '\S\'), '&', '\T\'), '~', '\R\'), chr(13), '\X0D\'), chr(10), '\X0A\') AS escaped FROM documents")
def escaped(spark, d):
    return table(spark, d, "documents").select("doc_id", hl7.escape(F.col("text")).alias("escaped"))


@query("B8_hl7_parse_nm", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS number FROM events")
def numbers(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("value").cast("string"), F.lit("e0"))).otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", hl7.parse_nm(text).alias("number"))


@query("B9_hl7_validate", f"WITH {_MSG} SELECT msg_id, {_ERROR} AS error_code FROM msg")
def validated(spark, d):
    return hl7.validate(hl7.damaged(messages(spark, d))).select("msg_id", "error_code")


def _repeated(spark, d):
    """Messages, a third sent again unchanged, a fifth with the same id and other bytes."""
    m = messages(spark, d).select("msg_id", "seq", "raw")
    again = m.where("seq % 3 = 0").select(F.concat("msg_id", F.lit("r")).alias("msg_id"), (F.col("seq") + 1_000_000_000_000).alias("seq"), "raw")
    other = m.where("seq % 5 = 0").select(F.concat("msg_id", F.lit("x")).alias("msg_id"), (F.col("seq") + 2_000_000_000_000).alias("seq"), F.concat("raw", F.lit("\rNTE|1")).alias("raw"))
    return m.unionByName(again).unionByName(other)


#: The reference's default; the query takes it from the operator.
REMEMBERED = 100_000

# Messages come in three stretches: all once, a third again, a fifth with other bytes. Once a repeat is remembered, all later ones are: their ids were accepted later by one or more each, while the count
# grows by one a message at most. So repeats need no turns; for the others counts and decisions take turns until they agree.
_FORGETFUL = f"""WITH RECURSIVE {_MSG}, m AS MATERIALIZED (SELECT msg_id, seq, row_number() OVER (ORDER BY seq) AS a, count(*) OVER () AS n FROM msg),
again AS MATERIALIZED (SELECT *, n + i AS held, i - 1 + n - a >= {{memory}} AS fresh FROM (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM m WHERE seq % 3 = 0)),
other AS (SELECT m.seq, m.msg_id, CASE WHEN fresh THEN held ELSE m.a END AS last, m.n + (SELECT count(*) FILTER (WHERE fresh) FROM again) AS held FROM m LEFT JOIN again USING (seq) WHERE m.seq % 5 = 0),
t AS (SELECT 0 AS turn, seq, msg_id, last, held, held AS before, false AS fresh, true AS changed FROM other UNION ALL SELECT turn + 1, seq, msg_id, last, held, now, fresh, bool_or(now <> before) OVER () FROM (
SELECT *, CAST(held + count(*) FILTER (WHERE fresh) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) - fresh::INT AS now FROM (SELECT turn, seq, msg_id, last, held, before, before - last >= {{memory}} AS fresh FROM t WHERE changed))),
decided AS (SELECT msg_id, 'accepted' AS disposition FROM m UNION ALL SELECT msg_id || 'r', CASE WHEN fresh THEN 'accepted' ELSE 'retransmission' END FROM again
UNION ALL SELECT msg_id || 'x', CASE WHEN fresh THEN 'accepted' ELSE 'rejected' END FROM t WHERE turn = (SELECT max(turn) FROM t))"""


@query("B12_hl7_dedupe_control_id", _FORGETFUL.format(memory=REMEMBERED) + " SELECT disposition, count(*) AS n FROM decided GROUP BY 1")
def deduped(spark, d):
    return hl7.dedupe_control_ids(hl7.validate(_repeated(spark, d))).groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


#: Accepted messages that the query below remembers: less than the smallest table has.
MEMORY = 500


@query("B12_hl7_dedupe_memory", f"""WITH RECURSIVE {_MSG}, m AS (SELECT msg_id, seq, row_number() OVER (ORDER BY seq) AS a FROM msg), n AS (SELECT count(*) AS n FROM m),
again AS (SELECT msg_id, a, row_number() OVER (ORDER BY seq) AS i FROM m WHERE seq % 3 = 0), r AS (SELECT CAST(0 AS BIGINT) AS i, n AS held, false AS fresh FROM n UNION ALL SELECT r.i + 1, held + (held - a >= {MEMORY})::INT, held - a >= {MEMORY} FROM r JOIN again ON again.i = r.i + 1),
once AS (SELECT msg_id, fresh, CASE WHEN fresh THEN held ELSE a END AS a FROM again JOIN r USING (i)),
other AS (SELECT m.msg_id, coalesce(once.a, m.a) AS a, row_number() OVER (ORDER BY seq) AS i FROM m LEFT JOIN once USING (msg_id) WHERE seq % 5 = 0),
q AS (SELECT CAST(0 AS BIGINT) AS i, (SELECT max(held) FROM r) AS held, false AS fresh UNION ALL SELECT q.i + 1, held + (held - a >= {MEMORY})::INT, held - a >= {MEMORY} FROM q JOIN other ON other.i = q.i + 1)
SELECT msg_id, 'accepted' AS disposition FROM m UNION ALL SELECT msg_id || 'r', CASE WHEN fresh THEN 'accepted' ELSE 'retransmission' END FROM once UNION ALL SELECT msg_id || 'x', CASE WHEN fresh THEN 'accepted' ELSE 'rejected' END FROM other JOIN q USING (i)""")
def deduped_with_memory(spark, d):
    return hl7.dedupe_control_ids(hl7.validate(_repeated(spark, d)), MEMORY).select("msg_id", "disposition")


@query("B13_ack_disposition", f"WITH {_MSG} SELECT msg_id, CASE WHEN k IN (0, 2, 6, 7) THEN 'AR' WHEN k IN (1, 4, 5, 8) THEN 'AE' ELSE 'AA' END AS ack_code FROM msg")
def acks(spark, d):
    return hl7.ack_disposition(hl7.validate(hl7.damaged(messages(spark, d)))).select("msg_id", "ack_code")


@query("B15_hl7_route", f"WITH {_MSG} SELECT CASE WHEN {_ERROR} IS NULL THEN 'validated' ELSE 'deadletter' END AS route, CASE WHEN k IN (0, 2, 7) THEN 'parse' WHEN {_ERROR} IS NOT NULL THEN 'validate' END AS stage, count(*) AS n FROM msg GROUP BY 1, 2")
def routed(spark, d):
    v = hl7.validate(hl7.damaged(messages(spark, d)))
    return v.groupBy(F.when(F.col("error_code").isNull(), "validated").otherwise("deadletter").alias("route"), "stage").agg(F.count(F.lit(1)).alias("n"))


_PARSED = f"WITH {BUCKET_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY encounter_id, hour ORDER BY {_ORDER}) AS rn FROM bucket)"


@query("B16_hl7_render", _PARSED + f" SELECT encounter_id || '-' || hour AS msg_id, {_CODE} AS code, round(value, 4) AS value FROM r")
def rendered(spark, d):
    o = hl7.to_observations(messages(spark, d))
    return o.select("msg_id", "code", F.round("value", 4).alias("value"))


_SEQ = "(encounter_id * 100000 + hour)"
_STATUS = f"CASE {_SEQ} % 13 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate("final corrected amended final preliminary preliminary preliminary registered registered cancelled cancelled entered-in-error entered-in-error".split())) + " END"
_UNITS = "CASE variable " + " ".join(f"WHEN '{v}' THEN '{u}'" for v, (_, u) in LOINC.items()) + " END"


def varied(spark: SparkSession, d: str) -> DataFrame:
    """Messages with every result status; some without OBX-14, without units, with codes of another system, and with delimiters of their own."""
    m, seq, raw = messages(spark, d), F.col("seq"), F.col("raw")
    letter = F.element_at(F.array(*map(F.lit, "FCAUPRSIOXNDW")), (seq % 13 + 1).cast("int"))
    raw = F.regexp_replace(raw, r"\|\|\|\|\|F\|", F.concat(F.lit("|||||"), letter, F.lit("|")))
    raw = F.when(seq % 5 == 0, F.regexp_replace(raw, r"(OBX\|[^\r]*\|)\d{14}\+0000", "$1")).otherwise(raw)
    raw = F.when(seq % 7 == 0, F.regexp_replace(raw, r"(OBX\|\d+\|NM\|[^|]*\|\|[^|]*\|)[^|]*\|", "$1|")).otherwise(raw)
    raw = F.when(seq % 11 == 0, F.replace(raw, F.lit("^LN|"), F.lit("^L|"))).otherwise(raw)
    return m.withColumn("raw", F.when(seq % 4 == 0, F.translate(raw, "^~", "!%")).otherwise(raw))


@query("C3_fhir_observations", _PARSED + f" SELECT 'M' || lpad(CAST(encounter_id AS VARCHAR), 6, '0') || lpad(CAST(hour AS VARCHAR), 6, '0') || '-' || rn AS id, 'MRN' || encounter_id AS mrn, 'ENC' || encounter_id AS encounter, {_CODE} AS code, {_STATUS} AS status, {_UNITS} AS unit, round(value, 4) AS value, (SELECT min(o.admitted_at) FROM obs o WHERE o.encounter_id = r.encounter_id) + to_hours(hour * 8) AS effective FROM r WHERE {_SEQ} % 11 <> 0")
def observations_parsed(spark, d):
    return hl7.to_observations(varied(spark, d)).select("id", "mrn", "encounter", "code", "status", "unit", F.round("value", 4).alias("value"), "effective")


@query("D11_parse_dtm", "SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN CASE WHEN event_id % 4 = 1 THEN date_trunc('second', ts) + INTERVAL 250 MILLISECOND ELSE date_trunc('second', ts) END END AS ts, CASE event_id % 4 WHEN 0 THEN 'second' WHEN 1 THEN 'fraction' WHEN 2 THEN 'second' END AS \"precision\", CASE WHEN event_id % 4 = 2 THEN -90 END AS minutes, CASE WHEN event_id % 4 = 3 THEN 'TIMESTAMP_INVALID' END AS error FROM events")
def dtm(spark, d):
    k, text = F.col("event_id") % 4, F.date_format("ts", "yyyyMMddHHmmss")
    given = F.when(k == 1, F.concat(text, F.lit(".25"))).when(k == 2, F.concat(text, F.lit("-0130"))).when(k == 3, F.concat(text, F.lit("+0175"))).otherwise(text)
    p = hl7.parse_dtm(given)
    return table(spark, d, "events").select("event_id", p.alias("p")).select("event_id", "p.ts", "p.precision", F.col("p.offset").alias("minutes"), "p.error")


@query("B7_hl7_composites", "SELECT c_custkey, 'MRN' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'HOSP' END AS authority, c_custkey % 5 <> 0 AS id_valid, c_name AS family, c_custkey % 7 <> 0 AS name_valid, c_mktsegment AS code_text, c_custkey % 11 <> 0 AS code_valid FROM customer".replace("'MRN' || c_custkey AS id", "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'MRN' || c_custkey END AS id").replace("c_name AS family", "CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS family").replace("c_mktsegment AS code_text", "CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_mktsegment END AS code_text"))
def composites(spark, d):
    k = F.col("c_custkey")
    either = lambda n, c: F.when(k % n == 0, "").otherwise(c)
    ids = F.concat(either(5, F.concat(F.lit("MRN"), k.cast("string"))), F.lit("^^^"), either(3, F.lit("HOSP")), F.lit("^MR"))
    x = table(spark, d, "customer").select("c_custkey", hl7.cx(ids).alias("i"), hl7.xpn(either(7, F.col("c_name"))).alias("n"), hl7.cwe(F.concat(F.lit("^"), either(11, F.col("c_mktsegment")), F.lit("^L"))).alias("c"))
    return x.select("c_custkey", "i.id", "i.authority", F.col("i.valid").alias("id_valid"), "n.family", F.col("n.valid").alias("name_valid"), F.col("c.text").alias("code_text"), F.col("c.valid").alias("code_valid"))


_WARNED = "CASE seq % 6 WHEN 0 THEN 'SEGMENT_TERMINATOR_NOT_CR' WHEN 1 THEN 'TRAILING_SEPARATOR' WHEN 2 THEN 'NON_ASCII_BYTES' WHEN 3 THEN 'OBSERVATION_CODE_UNKNOWN' ELSE '' END"


@query("B10_hl7_warnings", f"WITH {_MSG} SELECT msg_id, {_WARNED} AS codes FROM msg")
def warned(spark, d):
    raw, k = F.col("raw"), F.col("seq") % 6
    marked = F.when(k == 0, F.replace(raw, F.lit("\r"), F.lit("\n"))).when(k == 1, F.concat(raw, F.lit("|"))).when(k == 2, F.replace(raw, F.lit("FAMILY"), F.lit("FAMÌLIA"))).when(k == 3, F.regexp_replace(raw, "\\^LN\\|", "^L|")).otherwise(raw)
    plain = messages(spark, d).withColumn("raw", F.regexp_replace(marked, "\\|{3,}(?=\r|\n|$)", ""))
    # implausible values come with the data, so that code is left to the tests
    return hl7.warnings(plain).select("msg_id", F.array_join(F.filter("codes", lambda c: c != "VALUE_IMPLAUSIBLE"), ",").alias("codes"))


@query("B11_hl7_value_types", "SELECT event_id, CASE event_id % 8 WHEN 1 THEN 'VALUE_NOT_NUMERIC' WHEN 3 THEN 'VALUE_TYPE_MISMATCH' WHEN 5 THEN 'VALUE_TYPE_MISMATCH' WHEN 6 THEN 'VALUE_TYPE_MISMATCH' END AS error FROM events")
def value_types(spark, d):
    k, v, t = F.col("event_id") % 8, F.col("value").cast("string"), F.date_format("ts", "yyyyMMddHHmmss")
    cases = {0: ("NM", v), 1: ("NM", F.concat(v, F.lit("~x"))), 2: ("CWE", F.concat(F.lit("A^"), v, F.lit("~^text"))), 3: ("CE", F.concat(F.lit("A~^^"), v)), 4: ("DTM", F.concat(t, F.lit("~"), t)), 5: ("TS", F.concat(t, F.lit("99"))), 6: ("", v), 7: ("ST", v)}
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (a, b) in cases.items():
        kind, value = F.when(k == i, F.lit(a)).otherwise(kind), F.when(k == i, b).otherwise(value)
    return table(spark, d, "events").select("event_id", hl7.value_type_error(kind, value).alias("error"))


@query("B14_hl7_sniff_header", f"WITH {_MSG}" + " SELECT msg_id, CASE WHEN k NOT IN (0, 7) THEN 'M' || lpad(CAST(encounter_id AS VARCHAR), 6, '0') || lpad(CAST(hour AS VARCHAR), 6, '0') END AS control_id, CASE WHEN k NOT IN (0, 7) THEN CASE WHEN k = 6 THEN 'ORM^O01' ELSE 'ORU^R01' END END AS kind FROM msg")
def sniffed(spark, d):
    return hl7.damaged(messages(spark, d)).select("msg_id", hl7.sniff_header(F.col("raw")).alias("h")).select("msg_id", "h.control_id", "h.kind")
