"""As-of and fallback joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.operators.skew import two_level_last


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], stretch: int = 30 * 86_400) -> DataFrame:
    """``left`` with ``values`` of the latest ``right`` row of its key at or before its time (numbers of seconds); nulls where there is none.

    Both sides are put in one order per key and the last right row is carried on: no pairs, and no task
    orders more than a ``stretch`` of a key. Right rows of the same time: the greatest values win.
    """
    names = left.columns
    empty = F.lit(None)
    sides = [
        left.select(F.col(key).alias("__k"), F.col(left_ts).alias("__t"), F.lit(1).alias("__side"), F.struct(*names).alias("__row"), empty.alias("__v")),
        right.select(F.col(key).alias("__k"), F.col(right_ts).alias("__t"), F.lit(0).alias("__side"), empty.alias("__row"), F.struct(*values).alias("__v")),
    ]
    both = sides[0].unionByName(sides[1]).where(F.col("__t").isNotNull() | F.col("__row").isNotNull()).withColumn("__bucket", F.coalesce(F.floor(F.col("__t") / stretch), F.lit(-(1 << 60))))
    met = two_level_last(both, "__k", "__bucket", ["__t", "__side", "__v"], "__v", "__last").where("__side = 1")
    return met.select("__row.*", *(F.col(f"__last.{v}").alias(v if v not in names else f"{v}_right") for v in values))


def first_available(left: DataFrame, key: str, options: list[DataFrame], value: str, standing: str) -> DataFrame:
    """``left`` with ``value`` from the first of ``options`` (a row per key) that has its key, else ``standing``."""
    out = left
    for i, o in enumerate(options):
        out = out.join(o.select(F.col(key).alias(f"__k{i}"), F.col(value).alias(f"__v{i}")), F.col(key) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
    return out.withColumn(value, F.coalesce(*(F.col(f"__v{i}") for i in range(len(options))), F.lit(standing))).drop(*(f"__v{i}" for i in range(len(options))))
