"""Search dates as a table: each parameter names an interval at its own precision, and rows meet the parameters that they satisfy.

An interval, or a half line, is covered by buckets of fixed widths, each width a multiple of the one before: the coarsest buckets that lie wholly inside, finer ones at its ends.
So a row satisfies a parameter if and only if one of the row's buckets is in the cover, and the join is one of equal keys that makes no false candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86_400 * SECOND
#: Bucket widths in microseconds. Bounds of whole minutes or days use no finer ones.
WIDTHS = (1, 100, 10_000, SECOND, MINUTE, HOUR, DAY, 32 * DAY, 1024 * DAY, 32 * 1024 * DAY, 1024 * 1024 * DAY)
#: Half lines end here: multiples of the widest bucket before year 1 and after year 9999.
FIRST, LAST = -WIDTHS[-1], 3 * WIDTHS[-1]
#: From this width on a bucket may hold a large share of all rows, so its rows are dealt to ``SALTS`` keys.
WIDE, SALTS = 32 * DAY, 16

#: The form of a search date, its prefixes first.
_FORM = r"^(eq|ne|lt|le|gt|ge)?(\d{4})(?:-(\d{2})(?:-(\d{2})(?:T(\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,6}))?)?(Z|[+-]\d{2}:\d{2})?)?)?)?\z"


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a time without a zone, read as UTC whatever the session's zone (differences of times would go through it)."""
    of_day = F.hour(time).cast("long") * HOUR + F.minute(time).cast("long") * MINUTE + (F.date_part(F.lit("SECOND"), time) * SECOND).cast("long")
    return F.unix_date(time.cast("date")).cast("long") * DAY + of_day


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), then), 0)


def date_bounds(text: Column) -> Column:
    """A struct ``op, low, high, error`` of a search date: its interval [low, high) in microseconds since 1970. A time without a zone is UTC; days, months and years have no zone.

    ``error`` says why a text is no date (the rest is null then). A null text has neither interval nor error."""
    parts = F.array(*(F.nullif(F.regexp_extract(text, _FORM, i), F.lit("")) for i in range(1, 10)))
    return let(parts, lambda p: let(_start(p), lambda at: _interval(text, p, at)))


def _start(p: Column) -> Column:
    """``local`` (whole seconds, by the date's own clock) and ``shift`` (microseconds ahead of UTC) of a date in parts; null where a part is out of range."""
    number = lambda i, default: F.coalesce(F.get(p, i - 1).cast("int"), F.lit(default))
    zone = F.get(p, 8)
    hours, minutes = F.substring(zone, 2, 2).cast("int"), F.substring(zone, 5, 2).cast("int")
    ahead = F.when((hours < 24) & (minutes < 60), (hours * 60 + minutes) * F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1))
    second = F.when(number(7, 0) < 60, number(7, 0)).cast("decimal(8,6)")
    local = F.try_make_timestamp_ntz(F.nullif(number(2, 0), F.lit(0)), number(3, 1), number(4, 1), number(5, 0), number(6, 0), second)
    return F.struct(local.alias("local"), (F.when(zone.isNull() | (zone == "Z"), 0).otherwise(ahead).cast("long") * MINUTE).alias("shift"))


def _interval(text: Column, p: Column, at: Column) -> Column:
    part = lambda i: F.get(p, i - 1)
    low = micros(at["local"]) + F.coalesce(F.rpad(part(8), 6, "0").cast("long"), F.lit(0)) - at["shift"]
    tenths = F.get(F.array(*(F.lit(10 ** (6 - i)) for i in range(7))), F.coalesce(F.length(part(8)), F.lit(0)))  # a second, a tenth, ..., a microsecond
    unit = F.when(part(5).isNull(), DAY).when(part(7).isNull(), MINUTE).otherwise(tenths)
    months = F.when(part(3).isNull(), 12).otherwise(1)
    high = F.when(part(4).isNull(), micros(at["local"] + F.make_ym_interval(F.lit(0), months)) - at["shift"]).otherwise(low + unit)
    op = F.when(low.isNotNull(), F.coalesce(part(1), F.lit("eq")))
    error = F.when(part(2).isNull() & text.isNotNull(), "not a date parameter").when(low.isNull() & text.isNotNull(), "not a valid date")
    return F.struct(op.alias("op"), low.alias("low"), F.when(low.isNotNull(), high).alias("high"), error.alias("error"))


def stretches(bounds: Column) -> Column:
    """The ranges ``low, high`` of microseconds that satisfy a parameter: one, or two for ``ne``."""
    range_ = lambda low, high: F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"))

    def of(b: Column) -> Column:
        low, high, first, last = b["low"], b["high"], F.lit(FIRST), F.lit(LAST)
        out = F.when(b["op"] == "ne", F.array(range_(first, low), range_(high, last)))
        for op, ends in {"eq": (low, high), "lt": (first, low), "le": (first, high), "gt": (high, last), "ge": (low, last)}.items():
            out = out.when(b["op"] == op, F.array(range_(*ends)))
        return out

    return let(bounds, of)


def cover(ranges: DataFrame) -> DataFrame:
    """``ranges`` (with ``_low`` and ``_high``) and the buckets ``_w`` (width), ``_a`` (start) that make up each."""
    next_ = [*WIDTHS[1:], None]
    widths = F.array(*(F.struct(F.lit(w).cast("long").alias("w"), F.lit(n).cast("long").alias("n")) for w, n in zip(WIDTHS, next_, strict=True)))
    up, down = lambda x, w: x + F.pmod(-x, w), lambda x, w: x - F.pmod(x, w)
    low, high = F.col("_low"), F.col("_high")
    x = ranges.withColumn("_v", F.explode(widths)).withColumn("_w", F.col("_v.w")).withColumn("_n", F.col("_v.n"))
    x = x.withColumns({"_from": up(low, F.col("_w")), "_to": down(high, F.col("_w")), "_in": up(low, F.col("_n")), "_out": down(high, F.col("_n"))})
    steps = lambda a, b: F.when(F.col(a) < F.col(b), F.sequence(F.col(a), F.col(b) - F.col("_w"), F.col("_w"))).otherwise(F.array().cast("array<bigint>"))
    # what whole buckets of this width fill, less what the next width fills
    starts = F.when(F.col("_in") < F.col("_out"), F.concat(steps("_from", "_in"), steps("_out", "_to"))).otherwise(steps("_from", "_to"))
    return x.withColumn("_a", F.explode(starts)).drop("_v", "_n", "_from", "_to", "_in", "_out")


def date_join(rows: DataFrame, params: DataFrame, column: str = "effective", param: str = "param") -> DataFrame:
    """The columns of ``rows`` and of ``params`` for each row and parameter that it satisfies; a row of repeated parameters meets each. ``column`` is a time without a zone, in UTC.

    Null times, and null or faulty parameters (see ``date_bounds``), match nothing. Names may clash, as in any join. Rows take one key for each bucket width in use (at most 11, and
    3 or 4 where all bounds are days); whether a side is broadcast is Spark's choice by its size. Wide buckets, which a third of all rows may share, are dealt to ``SALTS`` keys."""
    names, given = [f"r{i}" for i in range(len(rows.columns))], [f"p{i}" for i in range(len(params.columns))]
    p = params.toDF(*given).withColumn("_b", date_bounds(F.col(given[params.columns.index(param)]))).where("_b.op is not null")
    p = cover(p.withColumn("_s", F.explode(stretches(F.col("_b")))).select(*given, F.col("_s.low").alias("_low"), F.col("_s.high").alias("_high")))
    salts = F.when(F.col("_w") >= WIDE, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    p = p.select(*given, "_w", "_a", F.explode(salts).alias("_salt"))
    used = sorted(r._w for r in p.select("_w").distinct().collect())  # of the 11 widths
    x = rows.toDF(*names)
    at = micros(F.col(names[rows.columns.index(column)]))
    plain = [n for n, f in zip(names, rows.schema.fields, strict=True) if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    x = x.withColumn("_t", at).where(F.col("_t").isNotNull()).withColumn("_w", F.explode(F.array(*map(F.lit, used)).cast("array<bigint>")))
    salt = F.when(F.col("_w") >= WIDE, F.pmod(F.xxhash64(*plain), F.lit(SALTS))).otherwise(0).cast("int")
    x = x.withColumn("_a", F.col("_t") - F.pmod("_t", "_w")).withColumn("_salt", salt)
    return x.join(p, ["_w", "_a", "_salt"]).select(*(F.col(n).alias(c) for n, c in zip(names, rows.columns, strict=True)), *(F.col(n).alias(c) for n, c in zip(given, params.columns, strict=True)))
