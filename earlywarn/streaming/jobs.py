"""Structured Streaming jobs: windowed counts with a watermark, observations deduplicated and scored hour by hour."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from earlywarn.operators import fhir, hl7, hourly
from earlywarn.operators.store import Store


def throughput_stream(log: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Messages per tumbling window and kind; a window closes ``late`` after its end."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def dedupe_stream(obs: DataFrame, ttl: str = "2 days") -> DataFrame:
    """Observations whose id was not seen within ``ttl``."""
    return obs.withColumn("effective", F.col("effective").cast("timestamp")).withWatermark("effective", ttl).dropDuplicatesWithinWatermark(["encounter_id", "id"])


def score_batches(obs: DataFrame, store: str, sink: Callable[[DataFrame, int], None], checkpoint: str, history_hours: int = 31) -> StreamingQuery:
    """Append observations to ``store`` and give ``sink`` the scored hours that each batch closes.

    An hour is closed by an accepted record of a later hour of its stay. Only the last ``history_hours`` hours of the stays in the batch are read back, so the
    work of a batch follows the batch. Scores are keyed by stay and hour: a batch that runs again gives the same rows.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.withColumn("batch", F.lit(number).cast("long")).write.mode("append").partitionBy("batch").parquet(store)
        every = spark.read.parquet(store).where(F.col("batch") <= number).dropDuplicates(["encounter_id", "id"])
        touched = df.groupBy("encounter_id").agg(F.max("hour").alias("newest"), F.min("hour").alias("oldest"))
        near = every.join(touched, "encounter_id").where(F.col("hour") >= F.col("oldest") - history_hours)
        before = near.where(F.col("batch") < number).groupBy("encounter_id").agg(F.max("hour").alias("seen"))
        hours = hourly.stay_hours(near.drop("newest", "oldest", "batch"))
        scored = hourly.with_news2(hourly.with_last_values(hours, ("HR", "O2Sat", "Temp", "SBP", "Resp", "FiO2")))
        closed = scored.join(touched, "encounter_id").join(before, "encounter_id", "left").where((F.col("hour") < F.col("newest")) & (F.col("hour") >= F.coalesce("seen", F.lit(1))))
        sink(closed.select("encounter_id", "site", "hour", F.col("news2.total").alias("score")), number)

    return obs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def convert_messages(msgs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Validated messages of a stream (``msg_id, seq, raw``) as resource tables below ``out``: patients, encounters, observations, and the errors of what does not convert.

    A batch writes its own partition of each table, by overwriting, and is committed after that: a batch that runs again gives the same rows. It then merges the resources into the
    current state below ``out/state`` (``operators.store``): admissions and discharges replace a patient or an encounter, results only add what is missing; an observation is
    replaced by a later message."""
    state = {name: Store(msgs.sparkSession, f"{out}/state/{name}") for name in ("patients", "encounters", "observations")}

    def batch(df: DataFrame, number: int) -> None:
        valid = hl7.validate(df).where("error_code is null").select("msg_id")
        kept = df.join(valid, "msg_id", "left_semi").persist()
        errors = fhir.conversion_errors(kept)
        fine = kept.join(errors.select("msg_id"), "msg_id", "left_anti")
        tables = {"patients": fhir.patients(fine), "encounters": fhir.encounters(fine), "observations": hl7.to_observations(fine), "errors": errors}
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        log = kept.select("msg_id", "seq")
        kind = hl7.split_message(fine).select("msg_id", F.split(F.get("MSH", 8), "\\^", 3).alias("kind"))
        adt = {"patients": F.get("kind", 0) == "ADT", "encounters": F.get("kind", 1).isin("A01", "A03"), "observations": F.lit(True)}
        for name, store in state.items():
            columns = [c for c in tables[name].columns if c not in ("msg_id", "id", "seq")]
            rows = tables[name].drop("seq").where("id is not null").join(log, "msg_id").join(kind, "msg_id")
            store.merge(rows.select("id", "seq", F.coalesce(adt[name], F.lit(False)).alias("authoritative"), F.struct(*columns).alias("resource"), F.col("seq").alias("at")), number)
        kept.unpersist()

    return msgs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
