"""Current state of keyed resources, stored by buckets of the key and merged batch by batch.

A table is a folder of bucket files and a log. A merge reads, changes and writes only the buckets that its batch touches; it then adds one version to the log, which names the
folder of each touched bucket, so readers see a batch whole or not at all. A batch that was merged before changes nothing, rows that a key has already taken are left out, and
what a failed attempt wrote is named by no version.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64
LOG = "version long, batch long, bucket int, folder string"


def applied(current: DataFrame | None, updates: DataFrame) -> DataFrame:
    """``id, seq, resource, updated_at`` after updates (id, seq, authoritative, resource, at), in the order of ``seq``.

    Authoritative updates replace the resource, others only fill a missing one; ``updated_at`` moves only where the resource changes. Updates at or below the key's ``seq`` were
    taken before and are left out."""
    new = updates.select("id", "seq", "authoritative", "resource", F.col("at").alias("updated_at"), F.lit(1).alias("_new"))
    every = new
    if current is not None:
        stored = current.select("id", "seq", F.lit(True).alias("authoritative"), "resource", "updated_at", F.lit(0).alias("_new"))
        every = stored.unionByName(new)
    # one exchange by key serves both windows and the aggregate
    order = Window.partitionBy("id").orderBy("_new", "seq")
    taken = F.max(F.when(F.col("_new") == 0, F.col("seq"))).over(Window.partitionBy("id"))
    x = every.withColumn("_taken", taken).where((F.col("_new") == 0) | F.col("_taken").isNull() | (F.col("seq") > F.col("_taken")))
    x = x.withColumn("_first", F.row_number().over(order) == 1).withColumn("_last", F.max("seq").over(Window.partitionBy("id")))
    x = x.where(F.col("authoritative") | F.col("_first")).withColumn("_changed", F.col("_first") | ~F.col("resource").eqNullSafe(F.lag("resource").over(order)))
    at = F.struct("_new", "seq")
    return x.groupBy("id").agg(F.max("_last").alias("seq"), F.max_by("resource", at).alias("resource"), F.max_by(F.col("updated_at"), F.when(F.col("_changed"), at)).alias("updated_at"))


class Store:
    """A stored table of keyed resources."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _log(self) -> list:
        try:
            log = self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error.getCondition()):
                raise
            return []
        newest = log.groupBy("bucket").agg(F.max_by("folder", "version").alias("folder"), F.max("version").alias("version"), F.collect_set("batch").alias("batches"))
        return newest.collect()  # a row a bucket

    def read(self, only: set[int] | None = None, log: list | None = None) -> DataFrame | None:
        """The state, or that of some buckets; None before the first merge that touched them."""
        found = [r.folder for r in (self._log() if log is None else log) if r.folder and (only is None or r.bucket in only)]
        return self.spark.read.parquet(*found) if found else None

    def merge(self, updates: DataFrame, batch: int) -> list[int]:
        """Merge one batch and return the buckets it wrote; none if the batch was merged before."""
        log = self._log()
        if any(batch in r.batches for r in log):
            return []
        version = max((r.version for r in log), default=0) + 1
        dealt = updates.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int"))
        touched = sorted(r.bucket for r in dealt.select("bucket").distinct().collect())  # at most the buckets
        folder = f"{self.path}/data/v{version}-{uuid.uuid4().hex}"
        if touched:
            state = applied(self.read(set(touched), log), updates)
            state = state.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int"))
            state.repartition("bucket").write.partitionBy("bucket").parquet(folder)
        rows = [(version, batch, b, f"{folder}/bucket={b}") for b in touched] or [(version, batch, -1, None)]
        if max((r.version for r in self._log()), default=0) + 1 != version:
            raise RuntimeError(f"another merge wrote version {version} of {self.path}")
        self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/log/v={version}")
        return touched
