"""Exact percentiles per group by bisection, and day states that combine.

Every (group, percentile) has an interval of values that holds its target rank. A pass over the rows
counts, per interval, the rows below each of ``2 ** levels - 1`` midpoints (``levels`` halvings at once),
and the interval shrinks to the part with the rank, and there to the least and greatest value seen.
Passes go on until all intervals are single values: the error bound is 0. Rows never move: a pass
shuffles counts only, partially aggregated where the rows are read.

States of single days hold counts in value buckets of relative width 2 ** -BITS. They add up over any
span; the percentile of a span is found by the same bisection over buckets, within one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators.skew import salted_lookup
from evidra.session import materialize, release

#: Bits of mantissa of the day states' buckets: a bucket's width is at most 2 ** -BITS of its lower end.
BITS = 7
#: Up to this many open intervals their table is broadcast (a row per group and part of the values still in question, well under 10 MB);
#: beyond, it is joined by shuffle. It changes the plan, never the rows.
BROADCAST_INTERVALS = 10_000
#: Percentiles are taken to a ten-thousandth of a per cent.
GRAIN = 10_000


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, percents: list[float], *, weight: str | None = None, levels: int = 10, max_passes: int = 70) -> DataFrame:
    """(*keys, percentile, value, n): the smallest value with at least ``percentile`` % of the group's rows at or below it.

    ``percents`` may be fractions, such as 99.9; if all are whole they come out as integers. Null values are
    no rows; null keys form a group; repeated values and rows count as they stand (``weight`` times each, if
    given). An empty table gives no rows. Values must lie within +-2**61.

    Percentiles of a group that are still in one interval share it, so a pass counts every row once for it.
    """
    spark, parts = rows.sparkSession, 1 << levels
    w = F.col(weight) if weight else F.lit(1)
    base = rows.where(F.col(value).isNotNull()).select(F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))).alias("g"), F.col(value).cast("bigint").alias("v"), w.cast("bigint").alias("w"))
    ranges = base.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("n"), F.count(F.lit(1)).alias("lines"))
    whole = all(float(p).is_integer() for p in percents)
    wanted = [F.struct(F.lit(int(p) if whole else float(p)).alias("p"), F.lit(round(p * GRAIN)).cast("bigint").alias("grains")) for p in percents]
    first = ranges.select("g", "n", "lines", F.explode(F.array(*wanted)).alias("x"), "lo", "hi", F.lit(0).cast("bigint").alias("below")).select("g", "n", "lines", "x.*", "lo", "hi", "below")
    rank = F.expr(f"greatest(1, (n div {100 * GRAIN}) * grains + ((n % {100 * GRAIN}) * grains + {100 * GRAIN - 1}) div {100 * GRAIN})")
    columns = ["g", "n", "lines", "p", "lo", "hi", "below", "rank"]
    state, path = materialize(first.withColumn("rank", rank).select(*columns), "intervals")
    for _ in range(max_passes):
        open_ = state.where(F.col("lo") < F.col("hi"))
        at = open_.groupBy("g", "lo", "hi").agg(F.max("lines").alias("lines")).withColumn("step", F.expr(f"(hi - lo) div {parts} + 1"))
        intervals = at.count()
        if not intervals:
            break
        if intervals <= BROADCAST_INTERVALS:
            one = at.select(F.col("g").alias("og"), "lo", "hi", "step")
            met = base.join(F.broadcast(one), (F.col("g") == F.col("og")) & F.col("v").between(F.col("lo"), F.col("hi"))).select("g", "v", "w", "lo", F.expr("(v - lo) div step").alias("part"))
        else:
            per = at.groupBy("g").agg(F.collect_list(F.struct("lo", "hi", "step")).alias("wanted"), F.max("lines").alias("lines"))  # at most one a percentile
            inside = F.expr("transform(filter(wanted, x -> v between x.lo and x.hi), x -> struct(x.lo as lo, (v - x.lo) div x.step as part))")
            met = salted_lookup(base, per, "g", "lines", base.count(), F.col("v")).where(F.col("wanted").isNotNull()).select("g", "v", "w", F.explode(inside).alias("x")).select("g", "v", "w", "x.lo", "x.part")
        counts = met.groupBy("g", "lo", "part").agg(F.sum("w").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("g", "lo").orderBy("part"))).withColumnRenamed("lo", "from")
        cut = upto.join(open_.select(F.col("g").alias("og"), F.col("lo").alias("from0"), "p", "below", "rank", "n", "lines"), (F.col("g") == F.col("og")) & (F.col("from") == F.col("from0")))
        cut = cut.where((F.col("below") + F.col("upto") >= F.col("rank")) & (F.col("below") + F.col("upto") - F.col("c") < F.col("rank")))
        narrowed = cut.select("g", "n", "lines", "p", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("upto") - F.col("c")).alias("below"), "rank")
        state, new = materialize(state.where(F.col("lo") == F.col("hi")).select(*columns).union(narrowed), "intervals")
        release(spark, path)
        path = new
    else:
        raise RuntimeError(f"intervals still open after {max_passes} passes")
    return state.select(*(F.col("g")[f"k{i}"].alias(k) for i, k in enumerate(keys)), F.col("p").alias("percentile"), F.col("lo").alias("value"), "n")


def bucket_of(v: Column) -> Column:
    """Bucket of a value: exact below 2 ** BITS, then 2 ** BITS buckets to each power of two; negative values mirror positive ones, so order is kept."""
    a = F.abs(v)
    e = F.length(F.bin(a)) - 1 - BITS
    b = F.when(a < (1 << BITS), a).otherwise((e.cast("bigint") + 1) * (1 << BITS) + F.call_function("shiftright", a, e) - (1 << BITS))
    return (b * F.signum(v).cast("bigint")).cast("bigint")


def bucket_bounds(b: Column) -> tuple[Column, Column]:
    """Least and greatest value of a bucket."""
    a = F.abs(b)
    e = F.floor(a / F.lit(1 << BITS)).cast("int") - 1
    low = F.when(a < (1 << BITS), a).otherwise(F.call_function("shiftleft", a - e.cast("bigint") * (1 << BITS), e))
    high = F.when(a < (1 << BITS), a).otherwise(low + F.call_function("shiftleft", F.lit(1).cast("bigint"), e) - 1)
    return F.when(b < 0, -high).otherwise(low), F.when(b < 0, -low).otherwise(high)


def day_states(rows: DataFrame, day: str, keys: list[str], value: str) -> DataFrame:
    """(*keys, day, bucket, n, total): what a day adds to any span. Null values are no rows."""
    known = rows.where(F.col(value).isNotNull())
    return known.groupBy(*keys, day, bucket_of(F.col(value).cast("bigint")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("bigint")).alias("total"))


def combine(states: DataFrame, keys: list[str]) -> DataFrame:
    """States of days as the state of their span (or of coarser keys): counts and totals add up."""
    return states.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def state_percentiles(states: DataFrame, keys: list[str], percents: list[float]) -> DataFrame:
    """(*keys, percentile, value_low, value_high, n) from states; the exact percentile lies between the two."""
    p = exact_percentiles(states, keys, "bucket", percents, weight="n")
    low, high = bucket_bounds(F.col("value"))
    return p.select(*keys, "percentile", low.alias("value_low"), high.alias("value_high"), "n")
