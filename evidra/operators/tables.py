"""Table changes without a table format: each gives the new state of a table as a DataFrame.

Everything is a join or an aggregate on the key, so a table of any size is changed by shuffling keys;
callers write the result to a new path and swap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators.skew import two_level_last, two_level_running


#: Fixed value: what separates two 64-bit numbers packed into one decimal.
_SPAN = "10000000000000000000"


def pack(high: Column, low: Column) -> Column:
    """Two 64-bit numbers as one number of the same order. A hash aggregate can keep its extremes, which it cannot of structs."""
    wide = lambda c: c.cast("decimal(38,0)")
    return (wide(high) * F.lit(_SPAN).cast("decimal(20,0)") + wide(low)).cast("decimal(38,0)")


def unpack_low(packed: Column) -> Column:
    """The lower of the two: the remainder nearest to zero, so of either sign up to half the span."""
    span = F.lit(_SPAN).cast("decimal(20,0)")
    rest = F.pmod(packed, span)
    return F.when(rest * 2 >= span, rest - span).otherwise(rest).cast("bigint")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``, the last column of which is a unique number; null is a key like any other.

    Keys are hashed, never sorted: the least order of each key is aggregated, and its row is fetched by the unique number.
    ``order`` has one or two columns of numbers, nulls last.
    """
    known = [F.coalesce(F.col(c).cast("bigint"), F.lit((1 << 62))) for c in order]
    least = F.min(known[0] if len(order) == 1 else pack(*known))
    first = rows.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(least.alias("__m"))
    number = F.col("__m") if len(order) == 1 else unpack_low(F.col("__m"))
    same = known[-1] == F.col("__first")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(first.withColumn("__first", number).drop("__m"), same, "left_semi")


def insert_new(existing: DataFrame, arriving: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``arriving`` to append: the first of each key, if ``existing`` lacks the key. Null keys are never equal, so all are new."""
    whole = arriving.where(" and ".join(f"`{k}` is not null" for k in keys))
    loose = arriving.where(" or ".join(f"`{k}` is null" for k in keys))
    return first_per_key(whole, keys, order).join(existing.select(*keys), keys, "left_anti").select(*arriving.columns).union(loose)


def delete_keys(table: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return table.join(keys.select(on).distinct(), on, "left_anti").select(*table.columns)


def set_column(table: DataFrame, changes: DataFrame, on: str, column: str, keep_if_null: bool = True) -> DataFrame:
    """``column`` from ``changes``(on, column) where the key is there; with ``keep_if_null`` a null change keeps the old value."""
    new = changes.select(F.col(on).alias("__on"), F.col(column).alias("__new"), F.lit(True).alias("__hit"))
    value = F.coalesce("__new", column) if keep_if_null else F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(column))
    return table.join(new, F.col(on) == F.col("__on"), "left").withColumn(column, value).select(*table.columns)


def update_columns(table: DataFrame, changes: DataFrame, on: str, overwrite: list[str], keep_if_null: list[str]) -> DataFrame:
    """``table`` after an update by key: ``overwrite`` columns take the change, even a null; ``keep_if_null`` columns only one that is not null.

    ``changes`` has at most one row a key; rows without a change stay as they are.
    """
    columns = [*overwrite, *keep_if_null]
    new = changes.select(F.col(on).alias("__on"), *(F.col(c).alias(f"__new_{c}") for c in columns), F.lit(True).alias("__hit"))
    value = {c: F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)) for c in overwrite} | {c: F.coalesce(f"__new_{c}", c) for c in keep_if_null}
    joined = table.join(new, F.col(on) == F.col("__on"), "left")
    return joined.select(*(value[c].alias(c) if c in value else F.col(c) for c in table.columns))


def guarded_set(table: DataFrame, keys: DataFrame, on: str, column: str, only_from: str, to: str) -> DataFrame:
    """``table`` with ``changed``: ``column`` goes from ``only_from`` to ``to`` for the ``keys``, and from no other value. Counting ``changed`` gives the number of updates."""
    hit = keys.select(F.col(on).alias("__on")).distinct().withColumn("__hit", F.lit(True))
    joined = table.join(hit, F.col(on) == F.col("__on"), "left")
    changed = F.coalesce(F.col("__hit") & (F.col(column) == only_from), F.lit(False))
    return joined.select(*(F.when(changed, F.lit(to)).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in table.columns), changed.alias("changed"))


def add_up(existing: DataFrame, delta: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Additive upsert: old and new measures summed by key."""
    return existing.unionByName(delta).groupBy(*keys).agg(*(F.sum(m).cast("bigint").alias(m) for m in measures))


def within_quota(events: DataFrame, keys: list[Column], order: list[str], most: int) -> DataFrame:
    """Events with ``n``, their place within their key, and whether they are among the first ``most``. Keys should carry a time window."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumn("n", F.row_number().over(w)).withColumn("allowed", F.col("n") <= most)


def changed_steps(snapshots: DataFrame, target: str, order: list[str], digest: str, stretch: int = 30 * 86_400) -> DataFrame:
    """(target, *order, from_hash, to_hash) where a target's digest differs from the one before; the first snapshot is no change.

    ``order`` begins with a number of seconds; no task orders more than a ``stretch`` of a target.
    """
    df = snapshots.withColumn("__bucket", F.floor(F.col(order[0]) / stretch))
    before = two_level_last(df, target, "__bucket", order, digest, "__from", include_own=False)
    return before.where(F.col("__from") != F.col(digest)).select(target, *order, F.col("__from").alias("from_hash"), F.col(digest).alias("to_hash"))


def sessions(events: DataFrame, who: str, order: list[str], starts: Column, values: list[str], stretch: int = 30 * 86_400) -> DataFrame:
    """Events numbered by session (a new one where ``starts``), each with the last known value so far in its session.

    ``order`` begins with a number of seconds; sessions are counted stretch by stretch.
    """
    df = events.withColumn("__bucket", F.floor(F.col(order[0]) / stretch)).withColumn("__start", F.when(starts, 1).otherwise(0))
    numbered = two_level_running(df, who, "__bucket", order, "__start", "__before").withColumn("session", F.col("__before") + F.col("__start"))
    for v in values:  # the last value of the user so far, if it is of this session
        numbered = numbered.withColumn(f"__at_{v}", F.when(F.col(v).isNotNull(), F.struct(F.col("session").alias("s"), F.col(v).alias("v"))))
        numbered = two_level_last(numbered, who, "__bucket", order, f"__at_{v}", f"__last_{v}")
    last = [F.when(F.col(f"__last_{v}.s") == F.col("session"), F.col(f"__last_{v}.v")).alias(f"last_{v}") for v in values]
    return numbered.select(who, *order, "session", *last)
