"""Validated messages as FHIR-like resources, conversion errors, encounter state, and vital signs of bundles. Native expressions over ``hl7.split_message``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earlywarn.operators import hl7
from earlywarn.sources.views import LOINC

#: Administrative sex.
GENDERS = {"F": "female", "M": "male", "O": "other", "U": "unknown", "A": "other", "N": "unknown"}


def _lookup(table: dict[str, str], key: Column, default: str | None = None) -> Column:
    out = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]
    return out if default is None else F.coalesce(out, F.lit(default))


def _f(segment: str, n: int) -> Column:
    return F.coalesce(F.get(F.col(segment), n), F.lit(""))


def _c(segment: str, n: int, comp: int) -> Column:
    first = F.get(hl7.split_by(_f(segment, n), F.col("repetition_sep"), "~"), 0)
    return F.coalesce(F.get(hl7.split_by(F.coalesce(first, F.lit("")), F.col("component_sep"), "^"), comp - 1), F.lit(""))


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


fhir_id = hl7.resource_id


def _date(text: Column) -> Column:
    """A date at its own precision: year, month or day."""
    d = F.substring(text, 1, 8)
    return F.when(F.length(d) >= 8, F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))).when(F.length(d) >= 6, F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2))).otherwise(F.substring(d, 1, 4))


def patients(msgs: DataFrame) -> DataFrame:
    """``msg_id, id, mrn, family, given, gender, birth_date, street, city``: PID as a patient. An address needs a street or a city."""
    x = hl7.split_message(msgs).where("PID is not null")
    given = F.filter(F.array(_c("PID", 5, 2), _c("PID", 5, 3)), lambda g: g != "")
    mrn = _c("PID", 3, 1)
    return x.select("msg_id", fhir_id(mrn).alias("id"), mrn.alias("mrn"), _c("PID", 5, 1).alias("family"), given.alias("given"), _lookup(GENDERS, _f("PID", 8), "unknown").alias("gender"), F.when(_f("PID", 7) != "", _date(_f("PID", 7))).alias("birth_date"), _some(_c("PID", 11, 1)).alias("street"), _some(_c("PID", 11, 3)).alias("city"))


def encounters(msgs: DataFrame) -> DataFrame:
    """``msg_id, id, trigger, status, bed, period_start, period_end, error``: PV1 as an encounter; a discharge finishes it."""
    x = hl7.split_message(msgs).where("PV1 is not null")
    trigger, visit = _c("MSH", 8, 2), _c("PV1", 19, 1)
    bed = F.concat_ws(" ", *(_some(_c("PV1", 3, i)) for i in (1, 2, 3)))
    time = lambda n: hl7.parse_dtm(_f("PV1", n))["ts"]
    return x.select("msg_id", _some(fhir_id(visit)).alias("id"), trigger.alias("trigger"), F.when(trigger == "A03", "finished").otherwise("in-progress").alias("status"), _some(bed).alias("bed"), time(44).alias("period_start"), time(45).alias("period_end"), F.when(visit == "", "VISIT_NUMBER_MISSING").alias("error"))


def conversion_errors(msgs: DataFrame) -> DataFrame:
    """``msg_id, error_code, payload``: messages that convert to nothing, by the first rule that fails, with their bytes. Nothing else of such a message is stored."""
    x = hl7.split_message(msgs)
    at = lambda f, n: F.coalesce(F.get(f, n), F.lit(""))
    # as hl7.usable: what is not converted can't fail to convert
    known = lambda f: (at(f, 2) == "NM") & (at(f, 5) != "") & (hl7.first_piece(at(f, 3), 3) == "LN") & hl7.first_piece(at(f, 3), 1).isin(*(c for c, _ in LOINC.values()))
    obx = F.filter("fields", lambda f: (f[0] == "OBX") & known(f))
    bad_time = lambda n, seg: (_f(seg, n) != "") & ~hl7.dtm_valid(_f(seg, n))
    no_time = F.exists(obx, lambda f: (at(f, 14) == "") & (_f("OBR", 7) == ""))
    error = F.coalesce(
        F.when(F.col("PID").isNull(), "PID_MISSING"), F.when(F.col("PV1").isNull(), "PV1_MISSING"), F.when(_c("PV1", 19, 1) == "", "VISIT_NUMBER_MISSING"),
        F.when((fhir_id(_c("PID", 3, 1)) == "") | (fhir_id(_c("PV1", 19, 1)) == ""), "FHIR_ID_EMPTY"), F.when(bad_time(44, "PV1") | bad_time(45, "PV1") | bad_time(7, "PID"), "TIMESTAMP_INVALID"),
        F.when(F.exists(obx, lambda f: _lookup(hl7.STATUSES, at(f, 11)).isNull()), "RESULT_STATUS_UNMAPPED"), F.when(no_time, "OBSERVATION_TIME_MISSING"),
    )
    # exploding an array of one or none, since a filter would be pushed down and evaluate the rules again from the raw text, each field anew
    return x.select("msg_id", "raw", F.explode(F.array_compact(F.array(error))).alias("error_code")).select("msg_id", "error_code", F.base64(F.col("raw").cast("binary")).alias("payload"))


def decode_payload(record: Column, raw_base64: Column) -> Column:
    """The original bytes where they can be decoded, else the record itself."""
    return F.coalesce(F.try_to_binary(raw_base64, F.lit("base64")), record.cast("binary"))


def upsert_encounters(events: DataFrame) -> DataFrame:
    """``encounter_id, status, updated_at``: the state after all events (encounter_id, trigger, at, seq). Admissions and discharges are authoritative, the latest of them wins;
    a result only opens an encounter that none of them has named, so it never overwrites nor reopens one. One aggregate with partial sums, no sort."""
    authoritative = F.col("trigger").isin("A01", "A03")
    order = F.struct("at", "seq")
    a = events.groupBy("encounter_id").agg(F.max(F.when(authoritative, F.struct(order.alias("o"), F.col("trigger"), F.col("at")))).alias("last"), F.min("at").alias("first"))
    return a.select("encounter_id", F.when(F.col("last.trigger") == "A03", "finished").otherwise("in-progress").alias("status"), F.coalesce("last.at", "first").alias("updated_at"))


def bundles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Patients (``file, mrn, family, given``) and vital signs (``file, code, unit, value, effective``) of a folder of bundle files; components of panels are rows of their own.

    A file without exactly one patient, or a patient without a medical record number, is an error. Digits at the end of names are left out."""
    coding = "array<struct<system:string,code:string>>"
    quantity = "struct<value:double,unit:string,code:string>"
    schema = f"entry array<struct<resource:struct<resourceType:string,name:array<struct<use:string,family:string,given:array<string>>>,identifier:array<struct<value:string,type:struct<coding:{coding}>>>,category:array<struct<coding:{coding}>>,code:struct<coding:{coding}>,valueQuantity:{quantity},effectiveDateTime:string,component:array<struct<code:struct<coding:{coding}>,valueQuantity:{quantity}>>>>>"
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    read = spark.read.schema(schema).option("multiLine", True).json(path).select(name.alias("file"), "entry").where(~F.col("file").rlike("^(hospital|practitioner)Information"))
    r = read.select("file", F.explode("entry").alias("e")).select("file", "e.resource.*")
    people = r.where("resourceType = 'Patient'")
    best = F.coalesce(F.get(F.filter("name", lambda n: n["use"] == "official"), 0), F.get("name", 0))
    mrn = F.get(F.filter("identifier", lambda i: F.exists(i["type"]["coding"], lambda c: c["code"] == "MR")), 0)["value"]
    plain = lambda c: F.regexp_replace(c, "[0-9]+$", "")
    needed = F.coalesce(mrn, F.raise_error(F.concat(F.col("file"), F.lit(": no medical record number"))).cast("string"))
    named = people.select("file", needed.alias("mrn"), plain(best["family"]).alias("family"), F.transform(best["given"], plain).alias("given"))
    count = F.count(F.lit(1)).over(Window.partitionBy("file"))
    single = named.withColumn("_n", count).withColumn("mrn", F.when(F.col("_n") == 1, F.col("mrn")).otherwise(F.raise_error(F.concat(F.col("file"), F.lit(": more than one patient"))).cast("string"))).drop("_n")
    vital = r.where("resourceType = 'Observation'").where(F.exists("category", lambda c: F.exists(c["coding"], lambda x: x["code"] == "vital-signs")))
    own = F.struct(F.col("code"), F.col("valueQuantity"))
    parts = F.filter(F.concat(F.array(own), F.coalesce("component", F.array())), lambda p: p["valueQuantity"]["value"].isNotNull())
    rows = vital.select("file", "effectiveDateTime", F.explode(parts).alias("p"))
    code = F.get(F.col("p.code.coding"), 0)["code"]
    return single, rows.select("file", code.alias("code"), F.col("p.valueQuantity.code").alias("unit"), F.col("p.valueQuantity.value").alias("value"), F.to_timestamp("effectiveDateTime").alias("effective"))


def known_vitals(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose code and unit are in the table, and counts of the others by code and unit. The table has 13 rows."""
    table = F.create_map(*(F.lit(x) for c, u in LOINC.values() for x in (c, u)))
    fits = F.coalesce(table[F.col("code")] == F.col("unit"), F.lit(False))
    return rows.where(fits), rows.where(~fits).groupBy("code", "unit").agg(F.count(F.lit(1)).alias("skipped"))


def vitals_messages(rows: DataFrame) -> DataFrame:
    """``patient, kind, at, results``: one result message for each patient and instant, an admission at the first and a discharge at the last."""
    kept, _ = known_vitals(rows)
    at = kept.groupBy("patient", F.col("effective").alias("at")).agg(F.count(F.lit(1)).alias("results"))
    ends = kept.groupBy("patient").agg(F.min("effective").alias("a"), F.max("effective").alias("z"))
    moves = ends.select("patient", F.explode(F.array(F.struct(F.lit("ADT^A01").alias("kind"), F.col("a").alias("at")), F.struct(F.lit("ADT^A03").alias("kind"), F.col("z").alias("at")))).alias("m"))
    return at.select("patient", F.lit("ORU^R01").alias("kind"), "at", "results").unionByName(moves.select("patient", "m.kind", "m.at", F.lit(0).cast("long").alias("results")))
