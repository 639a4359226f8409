"""Readers and sinks: stay files, keyed JSON topics, the code table, metric tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from earlywarn.operators.ordered import running
from earlywarn.sources.capture import scan_capture  # noqa: F401
from earlywarn.sources.views import LOINC

#: The 41 columns of a stay file, in order.
STAY_COLUMNS = (
    "HR O2Sat Temp SBP MAP DBP Resp EtCO2 BaseExcess HCO3 FiO2 pH PaCO2 SaO2 AST BUN Alkalinephos Calcium Chloride Creatinine Bilirubin_direct Glucose Lactate Magnesium Phosphate Potassium "
    "Bilirubin_total TroponinI Hct Hgb PTT WBC Fibrinogen Platelets Age Gender Unit1 Unit2 HospAdmTime ICULOS SepsisLabel"
).split()
STAY_SCHEMA = T.StructType([T.StructField(c, T.DoubleType()) for c in STAY_COLUMNS])
TOPIC_SCHEMA = "key string, value string"


def read_stays(spark: SparkSession, path: str, site: str, limit: int | None = None) -> DataFrame:
    """Stay files (``|``-separated, ``NaN`` missing) as the long table. Another header than the 41 columns fails the read; ``limit`` keeps the first stays by id."""
    raw = spark.read.schema(STAY_SCHEMA).option("sep", "|").option("header", True).option("enforceSchema", False).option("nullValue", "NaN").option("mode", "FAILFAST").csv(path)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.psv$", "")
    long = raw.select(F.lit(site).alias("site"), name.alias("patient_id"), F.col("ICULOS").cast("int").alias("hour"), *(F.col(c).cast("int").alias(c) if c == "SepsisLabel" else F.col(c) for c in STAY_COLUMNS))
    if limit is not None:
        first = long.select("patient_id").distinct().orderBy("patient_id").limit(limit)
        long = long.join(first, "patient_id", "left_semi")
    return long


def read_sites(spark: SparkSession, root: str, sites: tuple[str, ...] = ("A", "B")) -> DataFrame:
    """The stays of several sites, stacked with their tag."""
    out = None
    for s in sites:
        one = read_stays(spark, f"{root}/training_set{s}/*.psv", s)
        out = one if out is None else out.unionByName(one)
    return out


def read_topic(spark: SparkSession, path: str, schema: str, streaming: bool = False) -> DataFrame:
    """Keyed JSON lines as ``key`` and a parsed ``value``; a value that does not parse is null."""
    reader = spark.readStream if streaming else spark.read
    raw = reader.schema(TOPIC_SCHEMA).json(path)
    return raw.select("key", F.from_json("value", schema).alias("value"))


def read_topic_places(spark: SparkSession, path: str, schema: str, streaming: bool = False) -> DataFrame:
    """``read_topic`` with ``batch`` and ``offset``: the rows of a key in the order of these are the rows in the order that was written."""
    reader = spark.readStream if streaming else spark.read
    raw = reader.schema(TOPIC_SCHEMA + ", offset long, batch long").json(path)
    return raw.select("key", F.from_json("value", schema).alias("value"), "batch", "offset")


def topic_rows(df: DataFrame, key: str) -> DataFrame:
    """``key, value`` with every column in the JSON of value."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_topic(df: DataFrame, path: str, key: str, order: tuple[str, ...] = (), batch: int | None = None) -> None:
    """One batch of keyed JSON lines. Each line has the ``offset`` of its row among the rows of its key, in the order of the columns ``order`` and then of the values.

    Lines are in order of key and offset within and across a batch's files, so a key that holds a large share of all rows fills several files instead of one task. A batch that is
    written again under its number replaces itself; without a number it comes after all batches written so far by the clock. Null keys are a key. Feed a topic by a stream or by
    calls, not by both."""
    number = time.time_ns() // 1000 if batch is None else batch
    names = [f"_s{i}" for i in range(len(order))]
    rows = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"), *(F.col(c).alias(n) for c, n in zip(order, names, strict=True)))
    placed = running(rows, ["key"], [*map(F.col, names), F.col("value")], {"offset": F.lit(1)}).select("key", "value", (F.col("offset") - 1).alias("offset"))
    placed.repartitionByRange("key", "offset").sortWithinPartitions("key", "offset").write.mode("overwrite").json(f"{path}/batch={number}")


def write_topic_stream(stream: DataFrame, path: str, key: str, order: tuple[str, ...], checkpoint: str, **trigger) -> StreamingQuery:
    """A stream's rows by ``write_topic``, batch by batch under the stream's own numbers, so a batch that runs again after a failure is not doubled. ``trigger`` as in ``DataStreamWriter.trigger``."""
    writer = stream.writeStream.foreachBatch(lambda df, n: write_topic(df, path, key, order, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def loinc_table(spark: SparkSession) -> DataFrame:
    """The 13 codes: variable, code, unit."""
    return spark.createDataFrame([(v, c, u) for v, (c, u) in LOINC.items()], "variable string, code string, unit string")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The long metric table, NaN as null; an existing table is never overwritten."""
    numbers = [f.name for f in metrics.schema.fields if isinstance(f.dataType, T.DoubleType)]
    metrics.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in numbers}).write.mode("errorifexists").parquet(path)
