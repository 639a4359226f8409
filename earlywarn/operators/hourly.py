"""Hourly buckets of a stay and the features of each hour. Everything is partitioned by stay: one exchange serves buckets, windows and policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.functions.clinical import PARTS, news2, news2_components
from earlywarn.sources.views import STALENESS, VARIABLES

STAY = ("encounter_id", "site")
CAP = 24


def last_in_hour(obs: DataFrame) -> DataFrame:
    """One value per (stay, hour, variable): the one with the greatest (effective, id)."""
    return obs.where("hour >= 1").groupBy(*STAY, "hour", "variable").agg(F.max_by("value", F.struct("effective", "id")).alias("value"))


def pivot_hours(long: DataFrame) -> DataFrame:
    """One row per hour with a column for each variable; conditional maxima, so no second pass to find the variables."""
    return long.groupBy(*STAY, "hour").agg(*(F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in VARIABLES))


def densify(hours: DataFrame, first: int = 1) -> DataFrame:
    """Every hour from ``first`` to the newest one of a stay; unseen hours are blank."""
    spine = hours.groupBy(*STAY).agg(F.max("hour").alias("last")).select(*STAY, F.explode(F.sequence(F.lit(first).cast("long"), "last")).alias("hour"))
    return spine.join(hours, [*STAY, "hour"], "left")


def stay_hours(obs: DataFrame) -> DataFrame:
    """The dense hourly table of observations."""
    return densify(pivot_hours(last_in_hour(obs)))


def hour_steps(hours: DataFrame) -> DataFrame:
    """Rows whose hour does not follow the one before it in their stay by exactly 1."""
    step = F.col("hour") - F.lag("hour").over(Window.partitionBy(*STAY).orderBy("hour"))
    return hours.withColumn("step", step).where("step <> 1")


def assert_hourly(hours: DataFrame) -> DataFrame:
    """The same rows; the job fails where an hour is missing."""
    step = F.col("hour") - F.lag("hour").over(Window.partitionBy(*STAY).orderBy("hour"))
    ok = F.when(F.coalesce(step, F.lit(1)) == 1, F.col("hour")).otherwise(F.raise_error(F.lit("hours of a stay must follow each other")).cast("long"))
    return hours.withColumn("hour", ok)


def message_time_by_hour(obs: DataFrame) -> DataFrame:
    """The newest message time per hour, carried on over hours without results."""
    seen = obs.where("hour >= 1").groupBy(*STAY, "hour").agg(F.max("effective").alias("newest"))
    running = F.max("newest").over(Window.partitionBy(*STAY).orderBy("hour").rowsBetween(Window.unboundedPreceding, 0))
    return densify(seen).select(*STAY, "hour", running.alias("message_time"))


def classify(obs: DataFrame) -> DataFrame:
    """``outcome`` of each observation: unknown_code, before_admission, duplicate or accepted. Only accepted ids are remembered."""
    usable = F.col("variable").isin(*VARIABLES) & (F.col("hour") >= 1)
    rank = F.row_number().over(Window.partitionBy("encounter_id", "id", usable).orderBy("seq"))
    return obs.withColumn("outcome", F.when(~F.col("variable").isin(*VARIABLES), "unknown_code").when(F.col("hour") < 1, "before_admission").when(rank > 1, "duplicate").otherwise("accepted"))


def unpivot_stays(hours: DataFrame) -> DataFrame:
    """Observations of an hourly table, blanks dropped."""
    return hours.unpivot([*STAY, "hour"], list(VARIABLES), "variable", "value").where("value IS NOT NULL")


def _window() -> object:
    return Window.partitionBy(*STAY).orderBy("hour")


def hours_since(v: str) -> Column:
    """Hours since the variable was recorded, not capped."""
    return F.col("hour") - F.last(F.when(F.col(v).isNotNull(), F.col("hour")), True).over(_window().rowsBetween(Window.unboundedPreceding, 0))


def last_value(v: str, staleness: int) -> Column:
    """The last recorded value, blank once it is older than ``staleness`` hours."""
    return F.when(hours_since(v) <= staleness, F.last(v, True).over(_window().rowsBetween(Window.unboundedPreceding, 0)))


def with_last_values(hours: DataFrame, variables=VARIABLES) -> DataFrame:
    return hours.select("*", *(last_value(v, STALENESS[v]).alias(f"{v}_last") for v in variables), *(hours_since(v).alias(f"{v}_age") for v in variables))


def build_features(hours: DataFrame, variables=VARIABLES, also: tuple[str, ...] = ()) -> DataFrame:
    """Keys, twelve features for each variable, the parts of the score, its total and the ICU hour, and the columns of ``hours`` named in ``also``. Two projections over one sort of each stay."""
    base = with_last_values(hours, variables)
    w = _window()
    cols: list[Column] = []
    for v in variables:
        cols += [F.col(f"{v}_last"), F.col(v).isNotNull().cast("int").alias(f"{v}_measured"), F.when(F.col(f"{v}_age") <= CAP, F.col(f"{v}_age")).alias(f"{v}_hours_since")]
        cols += [(F.col(f"{v}_last") - F.lag(f"{v}_last", k).over(w)).alias(f"{v}_delta_{k}h") for k in (1, 3, 6)]
        for k in (6, 12):
            frame = w.rowsBetween(-(k - 1), 0)
            cols += [F.min(v).over(frame).alias(f"{v}_min_{k}h"), F.max(v).over(frame).alias(f"{v}_max_{k}h"), F.avg(v).over(frame).alias(f"{v}_mean_{k}h")]
    parts = with_news2(base).select(*STAY, "hour", *cols, *(F.col("parts")[p].alias(f"news2_{p}") for p in PARTS if p != "consciousness"), F.col("news2.total").alias("news2_total"), F.col("hour").alias("icu_hour"), *also)
    return parts


def with_news2(base: DataFrame) -> DataFrame:
    """``parts`` and ``news2`` from the last values."""
    parts = news2_components(*(F.col(f"{v}_last") for v in ("Resp", "O2Sat", "FiO2", "SBP", "HR", "Temp")))
    return base.withColumn("parts", parts).withColumn("news2", news2(F.col("parts")))


def with_label(hours: DataFrame, lead: int = 6) -> DataFrame:
    """``label``: 1 from ``lead`` hours before the first hour with a temperature of 42 or more."""
    first = F.min(F.when(F.col("Temp") >= 42, F.col("hour"))).over(Window.partitionBy(*STAY))
    return hours.withColumn("label", F.coalesce(F.col("hour") >= first - lead, F.lit(False)).cast("int"))


def stay_outcomes(long: DataFrame, lead: int = 6) -> DataFrame:
    """Per stay: septic, onset_known, onset_hour, first_hour, last_hour."""
    agg = long.groupBy(*STAY).agg(F.min(F.when(F.col("label") == 1, F.col("hour"))).alias("p"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))
    known = F.col("p").isNotNull() & (F.col("p") > F.col("first_hour"))
    return agg.select(*STAY, F.col("p").isNotNull().alias("septic"), known.alias("onset_known"), F.when(known, F.col("p") + lead).alias("onset_hour"), "first_hour", "last_hour")


def cohort(long: DataFrame) -> DataFrame:
    """Per site: stays, septic stays, hours, positive hours, median stay, share of blank hours of the vital signs."""
    stays = long.groupBy(*STAY).agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("septic"), F.sum("label").alias("positive"), *(F.sum(F.col(v).isNull().cast("long")).alias(f"blank_{v}") for v in VARIABLES))
    return stays.groupBy("site").agg(
        F.count(F.lit(1)).alias("patients"), F.sum("septic").cast("long").alias("septic_patients"), F.sum("n").alias("hours"), F.sum("positive").alias("positive_hours"), F.percentile("n", F.lit(0.5)).alias("median_hours"),
        *(F.round(F.sum(f"blank_{v}") / F.sum("n"), 9).alias(f"missing_{v}") for v in VARIABLES),
    )


def sequences(hours: DataFrame, variables=VARIABLES) -> DataFrame:
    """Per stay the ordered steps for sequence models: scaled last value (0 when blank), mask, hours since over the cap (1 when blank)."""
    base = with_last_values(hours, variables)
    r = base.agg(*(F.avg(f"{v}_last").alias(f"{v}_m") for v in variables), *(F.stddev_pop(f"{v}_last").alias(f"{v}_s") for v in variables)).first()  # two numbers for each variable
    parts = []
    for v in variables:
        mean, sd = r[f"{v}_m"] or 0.0, r[f"{v}_s"] or 1.0
        parts += [F.coalesce((F.col(f"{v}_last") - mean) / sd, F.lit(0.0)).alias(f"{v}_scaled"), F.col(v).isNotNull().cast("double").alias(f"{v}_mask"), F.coalesce(F.when(F.col(f"{v}_age") <= CAP, F.col(f"{v}_age") / CAP), F.lit(1.0)).alias(f"{v}_since")]
    return base.groupBy(*STAY).agg(F.sort_array(F.collect_list(F.struct("hour", *parts))).alias("steps"))


def late(obs: DataFrame) -> DataFrame:
    """``obs`` with ``late``: an earlier arrival (``seq``) of the stay was of a later hour, so this hour is scored already. Late values serve the hours after; the hour is not scored again."""
    seen = F.max("hour").over(Window.partitionBy("encounter_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return obs.withColumn("late", F.coalesce(F.col("hour") < seen, F.lit(False)))


def restore_state(scored: DataFrame, alerts: DataFrame, history: int = 31) -> DataFrame:
    """Per stay: the last scored hour, the hour and score of the last alert, and the first hour that later features need."""
    last = scored.groupBy(*STAY).agg(F.max("hour").alias("last_hour"))
    fired = alerts.where("alert").groupBy(*STAY).agg(F.max(F.struct("hour", "score")).alias("a"))
    return last.join(fired, list(STAY), "left").select(*STAY, "last_hour", F.col("a.hour").alias("alert_hour"), F.col("a.score").alias("alert_score"), F.greatest(F.lit(1), F.col("last_hour") - history + 1).alias("first_needed"))
