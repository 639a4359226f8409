"""Total orders without a task that holds them all: ranges whose bounds are values.

The bounds are sampled once and kept by the driver as literals, so every branch of a plan that asks for a row's range computes the same number from the row alone,
however Spark deals, coalesces or runs the branches again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows sampled for each range: the driver sorts at most this many rows times ``spark.sql.shuffle.partitions``.
SAMPLED = 40


def bounds(df: DataFrame, order: list[Column], ranges: int | None = None) -> Column:
    """An ascending array of keys (structs of ``order``, nulls first) that cut ``df`` into even ranges. Rows are picked by a hash of key and place."""
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))).alias("k"))
    some = keys.orderBy(F.xxhash64("k", F.monotonically_increasing_id())).limit(ranges * SAMPLED)
    found = some.orderBy("k").collect()  # bounded by the limit
    kind = keys.schema["k"].dataType
    step = max(1, len(found) // ranges, min(SAMPLED, len(found) // 2))
    cut: list = []
    for r in found[step::step]:
        if not cut or cut[-1] != r.k:
            cut.append(r.k)
    literal = lambda k: F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(k, kind.fields, strict=True)))
    return F.array(*map(literal, cut)).cast(f"array<{kind.simpleString()}>")


def range_of(order: list[Column], cuts: Column) -> Column:
    """The number of bounds at or below a row's key: a binary search over the array. The key is carried, since lambdas that name columns break the optimizer's constraints of unions."""
    key = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"), key.alias("key"))

    def step(acc: Column, _: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        above = (lo < hi) & (acc["key"] >= F.get(cuts, mid))
        return F.struct(F.when(above, mid + 1).otherwise(lo).alias("lo"), F.when(above | (lo >= hi), hi).otherwise(mid).alias("hi"), acc["key"].alias("key"))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(cuts) + 1.0)).cast("int"))
    return F.aggregate(rounds, start, step, lambda acc: acc["lo"])


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """``df`` with running sums within ``by`` in an ascending total order. No group is one task: each range sums itself, and begins with what its group holds in the ranges before.

    One exchange by range and group; what the ranges before hold comes in as a row of its own (one a range and group) ahead of the others, so nothing is joined."""
    cuts = bounds(df, [*map(F.col, by), *order], ranges)
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.select("*", *(c.alias(n) for n, c in zip(names, order, strict=True)), *(c.alias(f"_s_{k}") for k, c in sums.items()))
    dealt = keyed.withColumn("_at", range_of([*map(F.col, by), *map(F.col, names)], cuts)).withColumn("_own", F.lit(1))
    part = dealt.groupBy("_at", *by).agg(*(F.sum(f"_s_{k}").alias(f"_p_{k}") for k in sums))
    before = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    heads = part.select("_at", *by, F.lit(0).alias("_own"), *(F.sum(f"_p_{k}").over(before).alias(f"_s_{k}") for k in sums))
    every = dealt.unionByName(heads, allowMissingColumns=True)
    if ranges:  # a task for each range that was asked for, however many partitions the session shuffles to
        every = every.repartition(ranges, "_at", *by)
    inside = Window.partitionBy("_at", *by).orderBy("_own", *names).rowsBetween(Window.unboundedPreceding, 0)
    summed = every.select("*", *(F.sum(f"_s_{k}").over(inside).alias(f"_r_{k}") for k in sums)).where("_own = 1")
    return summed.select(*df.columns, *(F.col(f"_r_{k}").alias(k) for k in sums))


def previous(df: DataFrame, order: list[Column], value: str, out: str = "before") -> DataFrame:
    """``df`` with the ``value`` of the row before in an ascending total order, null for the first. As in ``running``, what the ranges before hold (here their last value) comes in as a row of its own."""
    cuts = bounds(df, order)
    names = [f"_o{i}" for i in range(len(order))]
    dealt = df.select("*", *(c.alias(n) for n, c in zip(names, order, strict=True))).withColumn("_at", range_of([*map(F.col, names)], cuts)).withColumn("_own", F.lit(1))
    part = dealt.groupBy("_at").agg(F.max_by(value, F.struct(*names)).alias("_last"))
    heads = part.select("_at", F.lit(0).alias("_own"), F.lag("_last").over(Window.orderBy("_at")).alias(value))  # one row a range
    every = dealt.unionByName(heads, allowMissingColumns=True)
    inside = Window.partitionBy("_at").orderBy("_own", *names)
    return every.withColumn(out, F.lag(value).over(inside)).where("_own = 1").select(*df.columns, out)


def counted_values(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, v, c, upto, n``: distinct values with their count, the rows at or below them, and the rows of the group. No window holds a group, no value is held twice."""
    one = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    summed = running(one, by, [F.col("v")], {"upto": F.col("c")})
    if not by:
        return summed.crossJoin(F.broadcast(one.agg(F.sum("c").alias("n"))))  # one row
    total = one.groupBy(*by).agg(F.sum("c").alias("n")).withColumnsRenamed({k: f"_{k}" for k in by})
    cond = F.lit(True)
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return summed.join(total, cond).drop(*(f"_{k}" for k in by))


def at_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """``by, n, max`` and the value at each rank, from 0; ranks are columns of ``n``. Exact: each rank lies in one distinct value's stretch of rows."""
    x = counted_values(df, by, value)
    at = lambda r: F.max(F.when((F.col("upto") > r) & (F.col("upto") - F.col("c") <= r), F.col("v")))
    return x.groupBy(*by).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.max("v").alias("max"), *(at(r).alias(k) for k, r in ranks.items()))


def between(low: Column, high: Column, position: Column) -> Column:
    """The value at a position between two ranks, linearly."""
    return low + (high - low) * (position - F.floor(position))


def even_quantiles(df: DataFrame, value: str, m: int) -> DataFrame:
    """``i, quantile`` for the ``m`` evenly spaced linear quantiles 0, 1 / (m - 1), ..., 1. Only values that a quantile touches leave their range."""
    x = counted_values(df, [], value)
    per = F.when(F.col("n") > 1, (m - 1) / (F.col("n") - 1))
    first = F.coalesce(F.greatest(F.lit(0), F.floor((F.col("upto") - F.col("c") - 1) * per)), F.lit(0)).cast("int")
    last = F.coalesce(F.least(F.lit(m - 1), F.ceil(F.col("upto") * per)), F.lit(m - 1)).cast("int")
    near = x.where(first <= last).withColumn("i", F.explode(F.sequence(first, last)))
    position = F.col("i") * (F.col("n") - 1) / F.lit(float(m - 1))
    holds = lambda r: (F.col("upto") > r) & (F.col("upto") - F.col("c") <= r)
    ends = near.groupBy("i").agg(F.max(F.when(holds(F.floor(position)), F.col("v"))).alias("low"), F.max(F.when(holds(F.ceil(position)), F.col("v"))).alias("high"), F.max(position).alias("p"))
    return ends.select("i", between(F.col("low"), F.col("high"), F.col("p")).alias("quantile"))
