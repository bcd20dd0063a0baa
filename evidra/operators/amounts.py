"""Robust amount statistics: capped sums, counts and a mergeable histogram, and the median it gives.

States are rows of additive columns, so partial states of batches, days or keys merge by summing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.money import BUCKETS, CAP_CENTS, amount_bucket

SCALARS = ["cases", "raw_claim_cents", "raw_claim_rows", "raw_award_cents", "raw_award_rows", "capped_cents", "capped_rows", "above_cap"]
HISTOGRAM = [f"hb{i:02d}" for i in range(BUCKETS)]
STATE = SCALARS + HISTOGRAM


def tally(rows: DataFrame, keys: list[str], claim: str, award: str, cap: int = CAP_CENTS) -> DataFrame:
    """One state per key in a single hash aggregate. Null amounts add nothing but a case; the cap is inclusive."""
    c, a = F.col(claim), F.col(award)
    capped, bucket = c <= cap, amount_bucket(c)
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("bigint")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"),
        zero(F.sum(c)).alias("raw_claim_cents"), F.count(c).alias("raw_claim_rows"), zero(F.sum(a)).alias("raw_award_cents"), F.count(a).alias("raw_award_rows"),
        zero(F.sum(F.when(capped, c))).alias("capped_cents"), F.count(F.when(capped, 1)).alias("capped_rows"), F.count(F.when(c > cap, 1)).alias("above_cap"),
        *(F.count(F.when(capped & (bucket == i), 1)).alias(h) for i, h in enumerate(HISTOGRAM)),
    )


def merge(states: DataFrame, keys: list[str]) -> DataFrame:
    """States of batches as one state per key; without keys one row over all."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in STATE]
    return states.groupBy(*keys).agg(*sums) if keys else states.agg(*sums)


def with_total(states: DataFrame, key: str) -> DataFrame:
    """The states and one over all keys (``is_total`` 1), by grouping sets in one pass."""
    g = states.groupingSets([[key], []], key).agg(*(F.sum(c).cast("bigint").alias(c) for c in STATE), F.grouping(key).cast("int").alias("is_total"))
    return g


def median_cents() -> Column:
    """The grouped median of a state's histogram, rounded half up; null when empty. Within its bucket, so within a factor of two."""
    total = sum((F.col(h) for h in HISTOGRAM), F.lit(0))
    half, below, out = total / F.lit(2.0), F.lit(0), F.lit(None).cast("double")
    steps = []
    for i, h in enumerate(HISTOGRAM):
        f = F.col(h)
        low, width = (0, 1) if i == 0 else (2 ** (i - 1), 2 ** (i - 1))
        steps.append(((f > 0) & (below + f >= half), F.lit(float(low)) + (half - below) / F.when(f > 0, f) * F.lit(float(width))))
        below = below + f
    for cond, value in reversed(steps):
        out = F.when(cond, value).otherwise(out)
    return F.when(total > 0, F.floor(out + 0.5)).cast("bigint")
