"""Operational tables: throughput, rejects, burden, latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.operators.ordered import at_ranks, between


def throughput(log: DataFrame, every: str = "1 hour") -> DataFrame:
    """Messages per tumbling window and kind."""
    return log.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def sliding_counts(log: DataFrame, window: str = "6 hours", slide: str = "2 hours") -> DataFrame:
    return log.groupBy(F.window("ts", window, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def burden(scored: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alerts per patient day, by source and over all (source null)."""
    hours = scored.agg(F.count(F.lit(1)).alias("hours"))
    by = alerts.rollup("source").agg(F.count(F.lit(1)).alias("alerts"))
    h = hours.first().hours  # one number
    return by.select("source", "alerts", F.round(F.col("alerts") * 24.0 / max(h, 1), 9).alias("per_patient_day"))


def open_over_time(alerts: DataFrame, log: DataFrame) -> DataFrame:
    """Open alerts after each day: a running sum of arrivals less departures, over daily sums."""
    up = alerts.select(F.to_date("raised_at").alias("day"), F.lit(1).alias("d"))
    down = log.where("from_status = 'open' and result = 'applied'").select(F.to_date("acted_at").alias("day"), F.lit(-1).alias("d"))
    daily = up.unionByName(down).groupBy("day").agg(F.sum("d").alias("d"))
    return daily.select("day", F.sum("d").over(Window.orderBy("day")).alias("open_alerts"))


def time_to_ack(alerts: DataFrame, results: DataFrame) -> DataFrame:
    """p50 and p90 of seconds from raised to the first acknowledge that applied to version 1."""
    first = results.where("result = 'applied' and transition = 'acknowledge' and version = 2").select("alert_id", "acted_at")
    s = alerts.join(first, "alert_id").select((F.timestamp_diff("MICROSECOND", F.col("raised_at"), F.col("acted_at")) / 1e6).alias("s"))
    n = F.col("n") - 1
    at = at_ranks(s, [], "s", {"a5": F.floor(n * 0.5), "b5": F.ceil(n * 0.5), "a9": F.floor(n * 0.9), "b9": F.ceil(n * 0.9)})
    return at.select("n", F.round(between(F.col("a5"), F.col("b5"), n * 0.5), 6).alias("p50"), F.round(between(F.col("a9"), F.col("b9"), n * 0.9), 6).alias("p90"))


def transitions(results: DataFrame) -> DataFrame:
    """Applied transitions by kind of actor, with margins."""
    kind = F.when(F.col("actor") == "system", "system").otherwise("clinician")
    return results.where("result = 'applied'").withColumn("kind", kind).cube("transition", "kind").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, bounds: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative buckets: one scan with conditional counts, unpivoted after."""
    cols = [F.sum((F.col(value) <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)] + [F.count(value).alias(f"b{len(bounds)}")]
    wide = df.groupBy(*by).agg(*cols) if by else df.agg(*cols)
    pairs = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate([*bounds, float("inf")])))
    return wide.select(*by, F.explode(pairs).alias("p")).select(*by, F.when(F.col("p.le") == float("inf"), "+Inf").otherwise(F.col("p.le").cast("string")).alias("le"), F.col("p.le").alias("bound"), "p.n")


def histogram_quantile(hist: DataFrame, q: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Linear inside the first bucket that reaches the rank; the last finite bound caps."""
    w = Window.partitionBy(*by).orderBy("bound")
    total = F.max("n").over(Window.partitionBy(*by))
    x = hist.select(*by, "bound", "n", F.coalesce(F.lag("n").over(w), F.lit(0)).alias("below"), F.coalesce(F.lag("bound").over(w), F.lit(0.0)).alias("low"), (total * q).alias("rank"))
    hit = x.where(F.col("n") >= F.col("rank")).groupBy(*by).agg(F.min_by(F.struct("bound", "n", "below", "low", "rank"), "bound").alias("m"))
    m = F.col("m")
    inside = m["low"] + (m["bound"] - m["low"]) * (m["rank"] - m["below"]) / F.when(m["n"] > m["below"], m["n"] - m["below"]).otherwise(1)
    return hit.select(*by, F.round(F.when(m["bound"] == float("inf"), m["low"]).otherwise(inside), 9).alias("quantile"))


def latency_summary(df: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """Nearest-rank p50, p95, p99 and maximum. Ranks are half-even of q * (n - 1)."""
    ranks = {name: F.bround((F.col("n") - 1) * q, 0).cast("long") for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))}
    return at_ranks(df, list(by), value, ranks).select(*by, "n", "p50", "p95", "p99", "max")


def outcome_counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
