"""Joins and prefix sums that hold when one key owns a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is heavy from this share of the rows on, so there are at most 1 / HEAVY_SHARE heavy keys: a proven bound for a broadcast.
HEAVY_SHARE = 1 / 256
SALT = 64


def salted_lookup(rows: DataFrame, lookup: DataFrame, key: str, count: str, total: int, spread: Column) -> DataFrame:
    """Left-join ``lookup`` (one row per ``key``, with ``count``, the rows that carry the key) to ``rows``.

    Keys of at least ``HEAVY_SHARE`` of ``total`` rows are spread over ``SALT`` places by ``spread`` (any
    expression of ``rows`` that varies within a key) and copied there on the lookup's side, so no task
    gets all rows of one key. The broadcast holds heavy keys only: at most 256.
    A null key finds no match and keeps nulls; null keys are spread as well.
    """
    least = max(1, int(total * HEAVY_SHARE))
    heavy = lookup.where(F.col(count) >= least).select(F.col(key).alias("__hk"), F.lit(True).alias("__heavy"))
    salt = F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int")
    left = rows.join(F.broadcast(heavy), F.col(key) == F.col("__hk"), "left").withColumn("__salt", F.when(F.col("__heavy") | F.col(key).isNull(), salt).otherwise(F.lit(0))).drop("__hk", "__heavy")
    slots = F.when(F.col(count) >= least, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    right = lookup.withColumn("__rsalt", F.explode(slots)).withColumnRenamed(key, "__rkey").drop(count)
    return left.join(right, (F.col(key) == F.col("__rkey")) & (F.col("__salt") == F.col("__rsalt")), "left").drop("__salt", "__rsalt", "__rkey")


def two_level_running(df: DataFrame, group: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` per ``group`` in the order (bucket, *order).

    The window only ever sees one (group, bucket); the offsets of buckets are summed over the small
    table of bucket totals. ``bucket`` must be fine enough for a bucket to fit in a task.
    """
    w = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(group, bucket).agg(F.sum(value).alias("__t"))
    offs = totals.select(
        F.col(group).alias("__g"),
        F.col(bucket).alias("__b"),
        F.coalesce(F.sum("__t").over(Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
    )
    inner = df.withColumn("__in", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return inner.join(offs, F.col(group).eqNullSafe(F.col("__g")) & (F.col(bucket) == F.col("__b"))).withColumn(out, F.col("__off") + F.col("__in")).drop("__g", "__b", "__off", "__in")


def two_level_last(df: DataFrame, group: str, bucket: str, order: list[str], value: str, out: str, include_own: bool = True) -> DataFrame:
    """The last ``value`` that is not null per ``group`` up to each row in the order (bucket, *order); with ``include_own`` False before it.

    As above, windows only see one (group, bucket); what earlier buckets end with is carried over their totals.
    """
    w = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include_own else -1)
    known = F.col(value).isNotNull()
    ends = df.where(known).groupBy(group, bucket).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__e"))
    every = df.select(group, bucket).distinct().join(ends.select(F.col(group).alias("__g"), F.col(bucket).alias("__b"), "__e"), F.col(group).eqNullSafe(F.col("__g")) & (F.col(bucket) == F.col("__b")), "left")
    carried = every.select(F.col(group).alias("__cg"), F.col(bucket).alias("__cb"), F.last("__e", ignorenulls=True).over(Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
    inner = df.withColumn("__in", F.last(value, ignorenulls=True).over(w))
    return inner.join(carried, F.col(group).eqNullSafe(F.col("__cg")) & (F.col(bucket) == F.col("__cb"))).withColumn(out, F.coalesce(F.col("__in"), F.col("__carry.v"))).drop("__cg", "__cb", "__carry", "__in")
