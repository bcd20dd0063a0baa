"""Money as integer cents; cells that are not plainly an amount give null, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidra.functions.text import trim_all

#: The cap of the robust statistics, the buckets of its histogram, and the largest exact amount.
CAP_CENTS = 2_500_000
BUCKETS = 23
MOST_CENTS = 9_007_199_254_740_991
CLAIM_KEYS = ["claim amt consumer", "claim amount consumer"]
AWARD_KEYS = ["award amt consumer", "award amount consumer"]

_CELL = r"^\$?\s*(\d{1,3}(?:,\d{3})*|\d+)(?:\.(\d{1,2}))?$"


def parse_dollars(cell: Column) -> Column:
    """``$1,234.56``, ``1234``, ``1234.5`` as cents; anything else, and amounts beyond 2**53 - 1 cents, null."""
    t = trim_all(cell)
    whole = F.replace(F.regexp_extract(t, _CELL, 1), F.lit(","), F.lit(""))
    cents = F.rpad(F.regexp_extract(t, _CELL, 2), 2, "0")
    n = F.when(t.rlike(_CELL) & (F.length(whole) <= 16), F.concat(whole, cents)).try_cast("decimal(20,0)")
    return F.when(n <= MOST_CENTS, n).cast("bigint")


def amount_bucket(cents: Column) -> Column:
    """0 up to nothing, else floor(log2) + 1, at most 22: exact, from the length in binary."""
    return F.when(cents <= 0, 0).otherwise(F.least(F.lit(BUCKETS - 1), F.length(F.bin(cents)))).cast("int")


def dollars_floor(cents: Column) -> Column:
    return F.format_number(F.floor(cents / F.lit(100)), 0)


def dollars_near_ten(cents: Column) -> Column:
    return F.format_number(F.floor(cents / F.lit(1000.0) + 0.5).cast("bigint") * 10, 0)
