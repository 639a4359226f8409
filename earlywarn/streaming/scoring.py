"""Observations scored hour by hour as they arrive: one stateful query per stay, with tagged scores, alerts and outcomes.

An hour closes when a record of a later hour is accepted, or when its stay has been quiet for the settle time (a processing-time timer). Hours without records are scored as
blank ones, each hour once. A record of a closed hour is late: later hours see its value, the closed one is not scored again. Alert ids derive from stay, hour and source, so
a batch that runs again after a lost executor or a restart gives the same rows.

The state of a stay is what later hours need: ``history_hours`` hours of last values, the ids seen in them, the last closed hour, and the last alert. It does not grow with the stay.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from earlywarn.functions.clinical import ALERT_NAMESPACE, BANDS, ROOM_AIR
from earlywarn.operators.evaluation import Policy
from earlywarn.session import cut
from earlywarn.sources.views import STALENESS

TAGGED = "kind string, encounter_id long, site string, icu_hour long, source string, raw_score double, alerted boolean, alert_id string, message_time string, outcome string, n long, closed_by string"
STATE = "body string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARAMETERS = {"respiratory_rate": "Resp", "spo2": "O2Sat", "systolic_bp": "SBP", "pulse": "HR", "temperature": "Temp"}
#: A second score source: gets the last values of the stay's variables at an hour.
Model = Callable[[dict[str, float]], float]


def points(last: dict[str, float]) -> int:
    """The points score of last values; what was not measured has none."""
    total = 2 if last.get("FiO2", 0.0) > ROOM_AIR else 0
    for name, variable in PARAMETERS.items():
        if variable in last:
            decimals, bounds, worth = BANDS[name]
            x = math.floor(last[variable] * 10**decimals + 0.5 + 1e-9) / 10**decimals
            total += worth[sum(x > b for b in bounds)]
    return total


class Stay:
    """The window of one stay."""

    def __init__(self, body: str | None, history: int):
        b = json.loads(body) if body else {"closed": 0, "alerts": {}, "hours": {}, "seen": {}, "times": {}, "said": ""}
        self.closed: int = b["closed"]
        self.alerts: dict[str, list[float]] = b["alerts"]
        self.hours: dict[int, dict[str, list]] = {int(h): v for h, v in b["hours"].items()}
        self.seen: dict[str, int] = b["seen"]
        self.times: dict[int, str] = {int(h): v for h, v in b["times"].items()}
        #: The newest message time of the hours that have left the window.
        self.said: str = b["said"]
        self.history = history

    def body(self) -> str:
        first = self.closed - self.history + 1
        self.said = max([self.said, *(t for h, t in self.times.items() if h < first)])
        keep = lambda d: {h: v for h, v in d.items() if h >= first}
        return json.dumps({"closed": self.closed, "alerts": self.alerts, "hours": keep(self.hours), "seen": {i: h for i, h in self.seen.items() if h >= first}, "times": keep(self.times), "said": self.said})

    @property
    def newest(self) -> int:
        return max(self.hours, default=0)

    def add(self, observation: str, variable: str, hour: int, effective: str, value: float) -> str:
        if observation in self.seen:
            return "duplicate"
        if variable not in STALENESS:
            return "unknown_code"
        if hour < 1:
            return "before_admission"
        self.seen[observation] = hour
        slot = self.hours.setdefault(hour, {})
        if variable not in slot or (effective, observation) > tuple(slot[variable][:2]):
            slot[variable] = [effective, observation, value]
        self.times[hour] = max(self.times.get(hour, ""), effective)
        return "late" if hour <= self.closed else "accepted"

    def last_values(self, hour: int) -> dict[str, float]:
        out = {}
        for variable, stale in STALENESS.items():
            for h in range(hour, max(0, hour - stale - 1), -1):
                if variable in self.hours.get(h, {}):
                    out[variable] = self.hours[h][variable][2]
                    break
        return out


class HourCloser(StatefulProcessor):
    """Closes, scores and alerts; see the module."""

    def __init__(self, policies: dict[str, Policy], settle_seconds: float, history_hours: int, model: Model | None):
        self.policies, self.settle, self.history, self.model = policies, settle_seconds, history_hours, model

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stay", STATE)

    def close(self) -> None:
        pass

    def _stay(self) -> Stay:
        return Stay(self.state.get()[0] if self.state.exists() else None, self.history)

    def _closed(self, key: tuple, stay: Stay, upto: int, by: str) -> list[dict]:
        rows = []
        for hour in range(stay.closed + 1, upto + 1):
            last = stay.last_values(hour)
            said = max([stay.said, *(t for h, t in stay.times.items() if h <= hour)])
            scores = {"news2": float(points(last))} | ({"model": self.model(last)} if self.model else {})
            fired = []
            for source, score in scores.items():
                if self._fires(stay, source, hour, score):
                    fired.append({"kind": "alert", "encounter_id": key[0], "site": key[1], "icu_hour": hour, "source": source, "raw_score": score, "alert_id": str(uuid.uuid5(uuid.UUID(ALERT_NAMESPACE), f"{key[0]}/{hour}/{source}")), "message_time": said, "closed_by": by})
            rows += fired
            rows += [{"kind": "score", "encounter_id": key[0], "site": key[1], "icu_hour": hour, "source": s, "raw_score": v, "alerted": bool(fired), "message_time": said, "closed_by": by} for s, v in scores.items()]
            stay.closed = hour
        return rows

    def _fires(self, stay: Stay, source: str, hour: int, score: float) -> bool:
        policy = self.policies[source]
        if math.isnan(score) or score < policy.threshold:
            return False
        if source in stay.alerts:
            at, was = stay.alerts[source]
            if hour - at < policy.refractory_hours and not score >= was + policy.rise_margin:
                return False
        stay.alerts[source] = [hour, score]
        return True

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stay, out, outcomes, arrived = self._stay(), [], Counter(), False
        batch = pd.concat(list(rows)).sort_values(["seq", "id"], kind="stable")
        for r in batch.itertuples(index=False):
            outcome = stay.add(str(r.id), r.variable, int(r.hour), str(r.effective), float(r.value))
            outcomes[outcome] += 1
            arrived |= outcome in ("accepted", "late")
            if outcome == "accepted":
                out += self._closed(key, stay, int(r.hour) - 1, "later hour")
        out += [{"kind": "outcome", "encounter_id": key[0], "site": key[1], "outcome": o, "n": n} for o, n in outcomes.items()]
        self.state.update((stay.body(),))
        if arrived:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if stay.newest > stay.closed:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.settle * 1000))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stay = self._stay()
        out = self._closed(key, stay, stay.newest, "timer")
        self.state.update((stay.body(),))
        yield _frame(out)


def _frame(rows: list[dict]) -> pd.DataFrame:
    kinds = {"long": "Int64", "double": "float64", "boolean": "boolean", "string": object}
    return pd.DataFrame({name: pd.Series([r.get(name) for r in rows], dtype=kinds[kind]) for name, kind in (c.split() for c in TAGGED.split(", "))})


def score_stream(obs: DataFrame, policies: dict[str, Policy], settle_seconds: float = 1.0, history_hours: int = 31, model: Model | None = None) -> DataFrame:
    """Tagged rows of a stream of observations (encounter_id, site, id, variable, value, effective, hour, seq).

    ``kind`` is ``score`` (one row a closed hour and source), ``alert``, or ``outcome`` (``n`` records of a batch by what became of them). Needs the RocksDB state store."""
    rows = obs.select("encounter_id", "site", "id", "variable", "value", obs["effective"].cast("string").alias("effective"), "hour", "seq")
    return rows.groupBy("encounter_id", "site").transformWithStateInPandas(statefulProcessor=HourCloser(policies, settle_seconds, history_hours, model), outputStructType=TAGGED, outputMode="append", timeMode="ProcessingTime")


def start(tagged: DataFrame, out: str, checkpoint: str, seconds: float | None = None) -> StreamingQuery:
    """Write the tagged rows below ``out``, a folder for each batch that a repeated batch overwrites. Without ``seconds`` what is there is read and the query ends."""
    spark = tagged.sparkSession
    # pending timers ask for another batch without end, so a query that is to end runs batches with data only
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB} | ({"spark.sql.streaming.noDataMicroBatches.enabled": "false"} if seconds is None else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        writer = tagged.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def arrivals(rows: DataFrame, path: str, order: str = "seq", batches: int = 4) -> Iterator[None]:
    """Write rows below ``path``, one append for each stretch of a number, and stop after each. A stretch is written by as many tasks as hold it."""
    stretches = cut(rows)
    low, high = stretches.selectExpr(f"min({order})", f"max({order})").first()
    if low is None:
        stretches.write.mode("append").parquet(path)
        yield
        return
    step = (high - low) // batches + 1
    for i in range(batches):
        stretches.where((F.col(order) >= low + i * step) & (F.col(order) < low + (i + 1) * step)).write.mode("append").parquet(path)
        yield


def replay(spark: SparkSession, rows: DataFrame, path: str, policies: dict[str, Policy], order: str = "seq", batches: int = 4, **options) -> DataFrame:
    """The tagged rows of a table of observations that arrive in an order: the query goes on from its checkpoint after each stretch, which is one batch. Hours that nothing closes stay open."""
    settle = options.pop("settle_seconds", 1e6)
    for _ in arrivals(rows, f"{path}/in", order, batches):
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        start(score_stream(stream, policies, settle_seconds=settle, **options), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(TAGGED).parquet(f"{path}/out").drop("batch")
