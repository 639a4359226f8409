"""Alert policy and evaluation of scores: events, utility, ranking, calibration."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from earlywarn.operators.hourly import STAY
from earlywarn.operators.ordered import at_ranks, between, even_quantiles, running
from earlywarn.session import cut


#: Stays of five slim columns that are sent to every task.
BROADCAST = 1_000_000


@dataclass(frozen=True)
class Policy:
    threshold: float
    refractory_hours: float = 6.0
    rise_margin: float = math.inf


def apply_policy(scored: DataFrame, policy: Policy) -> DataFrame:
    """``encounter_id, site, hour, score, alert``. The policy depends on its own last alert, so each stay's hours are folded in order by a native aggregate."""
    empty = F.struct(F.lit(None).cast("double").alias("h"), F.lit(None).cast("double").alias("s"), F.array().cast("array<boolean>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        held = acc["h"].isNotNull() & (x["hour"] - acc["h"] < policy.refractory_hours)
        risen = x["score"] >= acc["s"] + F.lit(policy.rise_margin)
        fire = F.coalesce((x["score"] >= policy.threshold) & ~F.isnan(x["score"]) & (~held | risen), F.lit(False))
        return F.struct(F.when(fire, x["hour"].cast("double")).otherwise(acc["h"]).alias("h"), F.when(fire, x["score"].cast("double")).otherwise(acc["s"]).alias("s"), F.concat(acc["out"], F.array(fire)).alias("out"))

    rows = scored.groupBy(*STAY).agg(F.sort_array(F.collect_list(F.struct("hour", F.col("score").cast("double").alias("score")))).alias("rows"))
    fired = F.aggregate("rows", empty, step, lambda acc: acc["out"])
    return rows.withColumn("fired", fired).select(*STAY, F.posexplode("rows").alias("i", "r"), "fired").select(*STAY, "r.hour", "r.score", F.get("fired", F.col("i")).alias("alert"))


def stay_summary(alerts: DataFrame, outcomes: DataFrame, window: int = 48) -> DataFrame:
    """Per stay: excluded, septic, hours, alerts, true_alerts, detected, lead_time."""
    j = alerts.join(outcomes, list(STAY))
    true = F.col("alert") & F.col("onset_known") & F.col("hour").between(F.col("onset_hour") - window, F.col("onset_hour"))
    out = j.groupBy(*STAY, "septic", "onset_known", "onset_hour").agg(F.count(F.lit(1)).alias("hours"), F.sum(F.col("alert").cast("long")).alias("alerts"), F.sum(F.coalesce(true, F.lit(False)).cast("long")).alias("true_alerts"), F.min(F.when(true, F.col("hour"))).alias("first"))
    return out.select(*STAY, (F.col("septic") & ~F.col("onset_known")).alias("excluded"), "septic", "hours", "alerts", "true_alerts", (F.col("true_alerts") > 0).alias("detected"), (F.col("onset_hour") - F.col("first")).alias("lead_time"))


def event_metrics(summary: DataFrame) -> DataFrame:
    """Event-level results; null where nothing can be divided."""
    kept, clean, septic = ~F.col("excluded"), ~F.col("septic"), F.col("septic") & ~F.col("excluded")
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, c)), F.lit(0))
    one = F.lit(1)
    a = summary.agg(
        total(one, septic).alias("septic_patients"), total(one, F.col("excluded")).alias("unknown_onset_excluded"), total(one, clean).alias("non_septic_patients"), total(one, septic & F.col("detected")).alias("detected"),
        total(F.col("hours"), kept).alias("hours"), total(F.col("alerts"), kept).alias("alerts"), total(F.col("true_alerts"), kept).alias("true_alerts"), total(F.col("hours"), clean).alias("clean_hours"), total(F.col("alerts"), clean).alias("clean_alerts"),
    )
    ratio = lambda x, y, k=1.0: F.when(F.col(y) > 0, F.round(F.col(x) * k / F.col(y), 9))
    return a.select("septic_patients", "unknown_onset_excluded", "non_septic_patients", "alerts", ratio("detected", "septic_patients").alias("event_sensitivity"), ratio("alerts", "hours", 24.0).alias("alerts_per_patient_day"), ratio("clean_alerts", "clean_hours", 24.0).alias("false_alerts_per_patient_day"), ratio("true_alerts", "alerts").alias("ppv_per_alert"))


def weighted_percentile(df: DataFrame, value: str, weight: str, percents: list[float]) -> DataFrame:
    """``percent, result`` by mid-weight positions and linear interpolation; equal values count with their mean weight each.

    Rows are summed by value, values by range; a percent then needs the last value that begins at or below it and the first one above, which are two aggregates."""
    by = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("c"))
    x = running(by, [], [F.col("v")], {"cum": F.col("w")}).crossJoin(F.broadcast(by.agg(F.sum("w").alias("total"))))  # one row
    half = F.col("w") / F.col("c") / 2
    x = x.select("v", ((F.col("cum") - F.col("w") + half) / F.col("total") * 100).alias("p"), ((F.col("cum") - half) / F.col("total") * 100).alias("q"))
    ends = []
    for i, percent in enumerate(percents):
        here = F.col("p") <= percent
        ends += [F.max_by(F.struct("v", "q"), F.when(here, F.col("v"))).alias(f"a{i}"), F.min_by(F.struct("v", "p"), F.when(~here, F.col("v"))).alias(f"b{i}")]

    def result(i: int) -> Column:
        low, high, percent = F.col(f"a{i}"), F.col(f"b{i}"), F.lit(float(percents[i]))
        inside = low["v"] + (high["v"] - low["v"]) * (percent - low["q"]) / (high["p"] - low["q"])
        return F.when(low.isNull(), high["v"]).when((percent <= low["q"]) | high.isNull(), low["v"]).otherwise(inside)

    pairs = F.array(*(F.struct(F.lit(float(p)).alias("percent"), F.round(result(i).cast("double"), 9).alias("result")) for i, p in enumerate(percents)))
    return x.agg(*ends).select(F.explode(pairs).alias("r")).select("r.*").where("result is not null")


def _down() -> list[Column]:
    """The highest score first (NaN above all)."""
    return [~F.isnan("s"), -F.col("s")]


def _steps(df: DataFrame, label: str, score: str, weight: str | None) -> DataFrame:
    """``s, p, n, tp, fp``: true and false positives at each distinct score and at it or above, highest first."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    by = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(w * F.col(label)).alias("p"), F.sum(w * (1 - F.col(label))).alias("n"))
    return running(by, [], _down(), {"tp": F.col("p"), "fp": F.col("n")})


def ranking(df: DataFrame, label: str, score: str, weight: str | None = None) -> DataFrame:
    """``auroc, auprc``: exact, ties as one step; null when a class is absent."""
    steps = _steps(df, label, score, weight)
    x = steps.select("tp", "fp", (F.col("tp") - F.col("p")).alias("tp0"), (F.col("fp") - F.col("n")).alias("fp0"))
    a = x.agg(F.max("tp").alias("P"), F.max("fp").alias("N"), F.sum((F.col("fp") - F.col("fp0")) * (F.col("tp") + F.col("tp0")) / 2).alias("area"), F.sum((F.col("tp") - F.col("tp0")) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    return a.select(F.when((F.col("P") > 0) & (F.col("N") > 0), F.round(F.col("area") / F.col("P") / F.col("N"), 9)).alias("auroc"), F.when(F.col("P") > 0, F.round(F.col("ap") / F.col("P"), 9)).alias("auprc"))


def utility_components(alerts: DataFrame, label: str = "label") -> DataFrame:
    """Observed, best and inaction utility per stay (rewarded from 12 hours before to 3 after the sixth hour after the first positive row)."""
    stay, order = Window.partitionBy(*STAY), Window.partitionBy(*STAY).orderBy("hour")
    x = alerts.withColumn("t", (F.row_number().over(order) - 1).cast("double"))
    x = x.withColumn("onset", F.min(F.when(F.col(label) == 1, F.col("t"))).over(stay) + 6)
    d = F.col("t") - F.col("onset")
    septic = F.col("onset").isNotNull()
    late = septic & (d > 3)
    hit = F.when(d <= -6, F.greatest(d / 6 + 2, F.lit(-0.05))).otherwise(d / -9 + F.lit(3.0) / 9)
    miss = F.when(d > -6, (d + 6) * F.lit(-2.0) / 9).otherwise(0.0)
    gain = lambda alert: F.when(late, 0.0).when(septic & alert, hit).when(septic, miss).when(alert, -0.05).otherwise(0.0)
    best = septic & (d >= -12) & (d <= 3)
    return x.groupBy(*STAY).agg(F.round(F.sum(gain(F.col("alert"))), 9).alias("observed"), F.round(F.sum(gain(F.coalesce(best, F.lit(False)))), 9).alias("best"), F.round(F.sum(gain(F.lit(False))), 9).alias("inaction"))


def normalized_utility(components: DataFrame) -> DataFrame:
    a = components.agg(F.sum("observed").alias("o"), F.sum("best").alias("b"), F.sum("inaction").alias("i"))
    return a.select(F.when(F.col("b") != F.col("i"), F.round((F.col("o") - F.col("i")) / (F.col("b") - F.col("i")), 6)).alias("utility"))


def brier(df: DataFrame, label: str, p: str) -> DataFrame:
    return df.agg(F.round(F.avg((F.col(p) - F.col(label)) ** 2), 9).alias("brier"))


def reliability(df: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    """``bin, n, mean_p, rate`` with empty bins; an edge belongs to the upper bin, 1 to the last."""
    edges = [i / bins for i in range(1, bins)]
    which = F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: F.col(p) >= e))
    got = df.groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 9).alias("mean_p"), F.round(F.avg(F.col(label).cast("double")), 9).alias("rate"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "rate")


def ece(bins: DataFrame) -> DataFrame:
    return bins.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n"), 7).alias("ece"))


def folds(outcomes: DataFrame, k: int = 5, seed: int = 2019) -> DataFrame:
    """Stays dealt into k folds, stratified by septic, in the order of a hash of seed and key; hours of a stay stay together."""
    order = F.md5(F.concat_ws("/", F.lit(str(seed)), "site", F.col("encounter_id").cast("string")))
    numbered = running(outcomes.select(*STAY, "septic", order.alias("_order")), ["septic"], [F.col("_order")], {"_n": F.lit(1)})
    return numbered.select(*STAY, "septic", ((F.col("_n") - 1) % k).cast("int").alias("fold"))


def rows_for(df: DataFrame, stays: DataFrame) -> DataFrame:
    return df.join(stays.select(*STAY), list(STAY), "left_semi")


def quantiles(df: DataFrame, score: str, n: int) -> DataFrame:
    """``n`` linear quantiles of a score, distinct."""
    return even_quantiles(df, score, n).select(F.round("quantile", 9).alias("threshold")).distinct()


def threshold_table(scored: DataFrame, outcomes: DataFrame, candidates: list[float], refractory_hours: float = 6.0, rise_margin: float = math.inf) -> DataFrame:
    """Burden and sensitivity of every candidate threshold in one job: each stay's hours are folded once per candidate, then summed."""
    return folded_thresholds(stay_rows(scored, outcomes), candidates, refractory_hours, rise_margin)


def stay_rows(scored: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Each stay with its outcome and its hours in order."""
    rows = scored.groupBy(*STAY).agg(F.sort_array(F.collect_list(F.struct("hour", F.col("score").cast("double").alias("score")))).alias("rows"))
    return rows.join(outcomes, list(STAY))


def folded_thresholds(stays: DataFrame, candidates: list[float], refractory_hours: float = 6.0, rise_margin: float = math.inf) -> DataFrame:
    """The threshold table of ``stay_rows``: one narrow pass, then a sum by candidate."""
    rows = stays.withColumn("threshold", F.explode(F.array(*(F.lit(float(c)) for c in candidates)).cast("array<double>")))
    start = F.struct(F.lit(None).cast("double").alias("h"), F.lit(None).cast("double").alias("s"), F.lit(0).alias("alerts"), F.lit(False).alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        held = acc["h"].isNotNull() & (x["hour"] - acc["h"] < refractory_hours)
        fire = F.coalesce((x["score"] >= F.col("threshold")) & (~held | (x["score"] >= acc["s"] + F.lit(rise_margin))), F.lit(False))
        true = fire & F.coalesce(x["hour"].between(F.col("onset_hour") - 48, F.col("onset_hour")), F.lit(False))
        return F.struct(F.when(fire, x["hour"].cast("double")).otherwise(acc["h"]).alias("h"), F.when(fire, x["score"]).otherwise(acc["s"]).alias("s"), (acc["alerts"] + fire.cast("int")).alias("alerts"), (acc["hit"] | true).alias("hit"))

    f = rows.withColumn("f", F.aggregate("rows", start, step)).where(~(F.col("septic") & ~F.col("onset_known")))
    a = f.groupBy("threshold").agg(F.sum("f.alerts").alias("alerts"), F.sum(F.size("rows")).alias("hours"), F.sum((F.col("septic") & F.col("f.hit")).cast("int")).alias("hits"), F.sum(F.col("septic").cast("int")).alias("septic"))
    return a.select("threshold", F.round(F.col("alerts") * 24.0 / F.col("hours"), 9).alias("alerts_per_patient_day"), F.when(F.col("septic") > 0, F.round(F.col("hits") / F.col("septic"), 9)).alias("sensitivity"))


def choose_fixed_sensitivity(table: DataFrame, target: float = 0.8) -> float | None:
    """The highest candidate that reaches the target, else the lowest one."""
    r = table.agg(F.max(F.when(F.col("sensitivity") >= target, F.col("threshold"))).alias("a"), F.min("threshold").alias("b")).first()
    return r.b if r.a is None else r.a


def choose_matched_burden(table: DataFrame, target: float) -> float | None:
    """The candidate whose burden is nearest the target among the highest one at or above it and the next; ties go to the higher threshold."""
    rows = sorted((r.threshold, r.alerts_per_patient_day) for r in table.collect())  # at most the candidates
    if not rows:
        return None
    lo, hi = 0, len(rows) - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if rows[mid][1] >= target else (lo, mid - 1)
    near = rows[lo : lo + 2]
    return max(near, key=lambda r: (-abs(r[1] - target), r[0]))[0]


def highest_good(look: Callable[[list[int]], dict[int, Row]], n: int, good: Callable[[Row], bool], levels: int = 3) -> tuple[int, dict[int, Row]]:
    """The highest of ``n`` candidates that is good, found as a bisection finds it (-1 if none), and what was looked up.

    One bisection step a job would wait for a fold of all stays each time, so a round looks up every middle that its next ``levels`` steps can reach: ``2 ** levels - 1`` candidates in one job."""
    low, high, found, seen = 0, n - 1, -1, {}
    while low <= high:
        middle = (low + high) // 2
        if middle not in seen:
            spans, asked = [(low, high)], []
            for _ in range(levels):
                spans = [s for s in spans if s[0] <= s[1]]
                asked += [(a + b) // 2 for a, b in spans]
                spans = [t for a, b in spans for t in ((a, (a + b) // 2 - 1), ((a + b) // 2 + 1, b))]
            seen |= look(asked)
        if good(seen[middle]):
            found, low = middle, middle + 1
        else:
            high = middle - 1
    return found, seen


def search_thresholds(held_out: DataFrame, outcomes: DataFrame, burden: float | None = None, sensitivity: float | None = None, candidates: int = 400, refractory_hours: float = 6.0, rise_margin: float = math.inf) -> DataFrame:
    """``threshold, alerts_per_patient_day, sensitivity`` of one quantile of the held-out scores: the nearest to a ``burden`` among the highest at or above it and the next (ties go to the higher), or the highest
    that reaches a ``sensitivity`` (else the lowest). Without scores there are no rows."""
    scored = cut(held_out.select(*STAY, "hour", "score"))
    stays = cut(stay_rows(scored, outcomes))  # every round reads them
    grid = sorted(r.threshold for r in quantiles(scored, "score", candidates).where("threshold is not null").collect())  # at most ``candidates``
    table = lambda at: folded_thresholds(stays, [grid[i] for i in at], refractory_hours, rise_margin)
    place = {t: i for i, t in enumerate(grid)}
    look = lambda at: {place[r.threshold]: r for r in table(at).collect()}
    if burden is None:
        found, _ = highest_good(look, len(grid), lambda r: r.sensitivity is not None and r.sensitivity >= sensitivity)
        return table([max(found, 0)] if grid else [])
    found, seen = highest_good(look, len(grid), lambda r: r.alerts_per_patient_day >= burden)
    options = [i for i in (found, found + 1) if 0 <= i < len(grid)]
    seen |= look([i for i in options if i not in seen]) if any(i not in seen for i in options) else {}
    return table(sorted(options, key=lambda i: (abs(seen[i].alerts_per_patient_day - burden), -i))[:1])


def choice(table: DataFrame, threshold: float | None) -> DataFrame:
    """The row of a threshold table that was chosen."""
    return table.where(F.col("threshold") == F.lit(threshold))


def curves(df: DataFrame, label: str, score: str, most: int = 200) -> DataFrame:
    """``curve, threshold, x, y``: ROC (false and true positive rate) and PR (recall, precision) at distinct scores, at most ``most`` evenly spaced ones of them."""
    steps = running(_steps(df, label, score, None), [], _down(), {"i": F.lit(1)})
    total = df.where(F.col(score).isNotNull()).agg(F.sum(F.col(label)).cast("double").alias("_P"), F.sum(1 - F.col(label)).cast("double").alias("_N"), F.count_distinct(score).alias("m"))
    x = steps.crossJoin(F.broadcast(total))  # one row
    place, last = F.col("i") - 1, F.col("m") - 1
    # positions are rounded half to even: the i-th is kept if a multiple of the step rounds to it
    step = last / F.lit(most - 1)
    near = F.round(place / step)
    kept = (F.col("m") <= most) | (F.bround(near * step) == place) | (F.bround((near - 1) * step) == place) | (F.bround((near + 1) * step) == place)
    x = x.where(kept)
    roc = x.select(F.lit("roc").alias("curve"), F.col("s").cast("double").alias("threshold"), F.round(F.col("fp") / F.col("_N"), 9).alias("x"), F.round(F.col("tp") / F.col("_P"), 9).alias("y"))
    return roc.unionByName(x.select(F.lit("pr").alias("curve"), F.col("s").cast("double").alias("threshold"), F.round(F.col("tp") / F.col("_P"), 9).alias("x"), F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 9).alias("y")))


def bootstrap(summaries: DataFrame, resamples: int = 1000, seed: int = 2019) -> DataFrame:
    """``metric, low, high``: 2.5 and 97.5 percentiles of event sensitivity and of alerts a patient day over resamples of stays.

    A resample draws as many stays as there are, by a hash of seed, resample and draw, so reruns agree. Stays and results of resamples are written once: what numbers and ranks them reads them several times.
    Each draw meets its stay and is summed by resample in the same task; up to ``BROADCAST`` stays are sent to the tasks, of more both sides are dealt by number."""
    summaries = cut(summaries)
    stays = running(summaries, [], [F.col("site"), F.col("encounter_id")], {"_i": F.lit(1)}).withColumn("_i", F.col("_i") - 1)
    n = summaries.count()
    spark = summaries.sparkSession
    draws = spark.range(resamples * n).select(F.expr(f"id div {max(n, 1)}").alias("r"), F.expr(f"id % {max(n, 1)}").alias("j"))
    pick = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("r").cast("string"), F.col("j").cast("string"))), 1, 8), 16, 10).cast("long") % max(n, 1)
    kept = cut(stays.where("not excluded").select("_i", "septic", "detected", "alerts", "hours"))
    x = draws.select("r", pick.alias("_i")).join(F.broadcast(kept) if n <= BROADCAST else kept.hint("shuffle_hash"), "_i")
    by = cut(x.groupBy("r").agg(
        (F.sum((F.col("septic") & F.col("detected")).cast("long")) / F.sum(F.when(F.col("septic"), 1))).alias("event_sensitivity"), (F.sum("alerts") * 24.0 / F.sum("hours")).alias("alerts_per_patient_day"),
    ))
    long = by.unpivot(["r"], ["event_sensitivity", "alerts_per_patient_day"], "metric", "value")
    n = F.col("n") - 1
    ranks = {f"{k}{i}": f(n * q) for k, q in (("low", 0.025), ("high", 0.975)) for i, f in enumerate((F.floor, F.ceil))}
    at = at_ranks(long, ["metric"], "value", ranks)
    return at.select("metric", *(F.round(between(F.col(f"{k}0"), F.col(f"{k}1"), n * q), 9).alias(k) for k, q in (("low", 0.025), ("high", 0.975))))


def cross_site(scored: DataFrame, outcomes: DataFrame, policy: Policy, sites: tuple[str, ...] = ("A", "B")) -> DataFrame:
    """``train, test, metric, value``: each direction on the stays of the other site. The policy's threshold is fixed, so nothing is fitted on the training site."""
    out = None
    for train, test in zip(sites, reversed(sites), strict=True):
        mine = scored.where(F.col("site") == test)
        rank = ranking(mine, "label", "score")
        events = event_metrics(stay_summary(apply_policy(mine, policy), outcomes.where(F.col("site") == test))).select("event_sensitivity", "alerts_per_patient_day")
        one = rank.crossJoin(events).crossJoin(brier(mine, "label", "p"))  # one row each
        long = one.unpivot([], ["auroc", "auprc", "event_sensitivity", "alerts_per_patient_day", "brier"], "metric", "value").select(F.lit(train).alias("train"), F.lit(test).alias("test"), "metric", "value")
        out = long if out is None else out.unionByName(long)
    return out


def parity(left: DataFrame, right: DataFrame, keys: list[str], column: str, tolerance: float) -> DataFrame:
    """``rows, missing, differing``: rows of either side, those that only one has, and those whose values differ by more than the tolerance."""
    r = right.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(column).alias("_v"), F.lit(True).alias("_in"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    j = left.select(*keys, column, F.lit(True).alias("_is")).join(r, cond, "full")
    both = F.col("_is").isNotNull() & F.col("_in").isNotNull()
    far = both & ~(F.col(column).eqNullSafe(F.col("_v")) | F.coalesce(F.abs(F.col(column) - F.col("_v")) <= tolerance, F.lit(False)))
    return j.agg(F.count(F.lit(1)).alias("rows"), F.sum((~both).cast("long")).alias("missing"), F.sum(far.cast("long")).alias("differing"))


def fingerprint(long: DataFrame) -> DataFrame:
    """Stays, rows and a digest of keys, hours and labels: rows by stay, stays by bucket, buckets at the top, so no list grows with the table."""
    stay = long.groupBy(*STAY).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hour", "label"))), lambda r: F.concat_ws(":", r["hour"].cast("string"), r["label"].cast("string"))), ","), 256).alias("h"))
    named = stay.select("n", F.sha2(F.concat_ws("/", "site", F.col("encounter_id").cast("string"), "h"), 256).alias("h"))
    bucket = named.groupBy(F.substring("h", 1, 3).alias("b")).agg(F.count(F.lit(1)).alias("stays"), F.sum("n").alias("rows"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("h"))
    return bucket.agg(F.sum("stays").alias("stays"), F.sum("rows").alias("rows"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda r: r["h"]), ","), 256).alias("digest"))
