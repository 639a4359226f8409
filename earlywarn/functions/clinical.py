"""Clinical scores and time arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds of the bands of each parameter and their points.
BANDS = {
    "respiratory_rate": (0, (8, 11, 20, 24), (3, 1, 0, 2, 3)),
    "spo2": (0, (91, 93, 95), (3, 2, 1, 0)),
    "systolic_bp": (0, (90, 100, 110, 219), (3, 2, 1, 0, 3)),
    "pulse": (0, (40, 50, 90, 110, 130), (3, 1, 0, 1, 2, 3)),
    "temperature": (1, (35.0, 36.0, 38.0, 39.0), (3, 1, 0, 1, 2)),
}
ROOM_AIR = 0.21
URGENT, EMERGENCY = 5, 7


def icu_hour(effective: Column, admitted: Column, hour_seconds: int = 3600) -> Column:
    """The hour bucket since admission; a full hour belongs to the earlier bucket, values below 1 are before admission."""
    return F.ceil(F.timestamp_diff("MICROSECOND", admitted, effective) / (hour_seconds * 1e6)).cast("long")


def hour_ending(admitted: Column, hour: Column, hour_seconds: int = 3600) -> Column:
    """When an hour bucket ends."""
    return F.timestamp_add("SECOND", hour * hour_seconds, admitted)


def round_half_up(x: Column, decimals: int) -> Column:
    """Halves go up, with the tolerance of 1e-9 that the score uses before banding."""
    scale = 10**decimals
    return F.floor(x * scale + F.lit(0.5) + F.lit(1e-9)) / scale


def banded(x: Column, name: str) -> Column:
    """Points of one parameter, 0 when it was not measured."""
    decimals, bounds, points = BANDS[name]
    rounded = round_half_up(x, decimals)
    out = F.when(x.isNull(), 0)
    for bound, p in zip(bounds, points, strict=False):
        out = out.when(rounded <= F.lit(float(bound)), p)
    return out.otherwise(points[-1])


def supplemental_o2(fio2: Column) -> Column:
    return F.when(fio2 > ROOM_AIR, 2).otherwise(0)


def news2_components(rr: Column, spo2: Column, fio2: Column, sbp: Column, pulse: Column, temp: Column) -> Column:
    """The seven parts of the score; consciousness has no source and is 0."""
    parts = {"respiratory_rate": banded(rr, "respiratory_rate"), "spo2": banded(spo2, "spo2"), "supplemental_o2": supplemental_o2(fio2), "systolic_bp": banded(sbp, "systolic_bp"), "pulse": banded(pulse, "pulse"), "consciousness": F.lit(0), "temperature": banded(temp, "temperature")}
    return F.struct(*(c.cast("int").alias(k) for k, c in parts.items()))


PARTS = ("respiratory_rate", "spo2", "supplemental_o2", "systolic_bp", "pulse", "consciousness", "temperature")


def news2(parts: Column) -> Column:
    """``total, single3, urgent, emergency`` of the parts."""
    total = sum((parts[p] for p in PARTS[1:]), parts[PARTS[0]])
    return F.struct(total.alias("total"), (F.greatest(*(parts[p] for p in PARTS)) == 3).alias("single3"), (total >= URGENT).alias("urgent"), (total >= EMERGENCY).alias("emergency"))


def severity(total: Column, single3: Column) -> Column:
    """The band of a score; unknown without one."""
    return F.when(total.isNull(), "unknown").when(total >= EMERGENCY, "high").when(total >= URGENT, "medium").when(single3, "low-medium").otherwise("low")


#: Fixed value: the namespace of alert ids.
ALERT_NAMESPACE = "7d5c6f2e-3a7b-4b8e-9f0d-2c1e6a5b4d30"


def alert_uuid(encounter: Column, hour: Column, source: Column, namespace: str = ALERT_NAMESPACE) -> Column:
    """A version-5 UUID of encounter, hour and source."""
    name = F.concat_ws("/", encounter.cast("string"), hour.cast("string"), source)
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
