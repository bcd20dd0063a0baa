"""Per-key aggregation as a tree, for keys that hold most of the rows.

Input is cut into chunks of a fixed number of rows. Each chunk is combined where it is read (Spark's
map-side partial aggregation), and the partial states then meet in rounds: in round r the states of
``fan_in ** r`` neighbouring chunks merge. A task so receives at most ``fan_in`` states of a key per
node, however many rows or chunks the key has, and log(chunks) rounds finish the work. The last round
groups by the key alone, so the result never depends on how chunks fell.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def chunk_plan(df: DataFrame, chunk_rows: int) -> tuple[int, int]:
    """(partitions, chunks of the longest partition), from a pass over the row numbers; a filter before it reads its own columns."""
    mid = F.monotonically_increasing_id()
    r = df.select(mid.alias("m")).agg(F.max(F.shiftright("m", 33)).alias("p"), F.max(F.col("m").bitwiseAND((1 << 33) - 1)).alias("r")).first()
    return (0, 0) if r.p is None else (r.p + 1, r.r // chunk_rows + 1)


def tree_aggregate(df: DataFrame, keys: Mapping[str, Column], measures: Mapping[str, tuple[Column, str]], *, chunk_rows: int = 65_536, fan_in: int = 16) -> DataFrame:
    """One row per distinct key tuple: ``keys`` (name -> expression) and ``measures`` (name -> (expression, 'sum' | 'min' | 'max')).

    A count is ``(lit(1), 'sum')``. Null keys form their own group, as in GROUP BY; null measures are
    skipped, and a key with only null measures gets null. An empty table gives no rows. Ties and
    repeated rows count as they stand. Columns not named are not read, so their names cannot clash.
    """
    parts, blocks = chunk_plan(df, chunk_rows)
    mid = F.monotonically_increasing_id()
    names, values = [f"k{i}" for i in range(len(keys))], [f"m{i}" for i in range(len(measures))]
    merges = [_MERGE[how] for _, how in measures.values()]
    node = F.shiftright(mid, 33) * max(1, blocks) + F.floor(mid.bitwiseAND((1 << 33) - 1) / F.lit(chunk_rows)).cast("bigint")
    state = df.select(*(c.alias(n) for n, c in zip(names, keys.values())), *(c.alias(v) for v, (c, _) in zip(values, measures.values())), node.alias("node"))
    rounds = max(1, math.ceil(math.log(max(2, parts * blocks), fan_in)))
    for _ in range(rounds - 1):
        state = state.withColumn("node", F.expr(f"node div {fan_in}")).groupBy(*names, "node").agg(*(m(v).alias(v) for m, v in zip(merges, values)))
    done = state.groupBy(*names).agg(*(m(v).alias(v) for m, v in zip(merges, values)))
    return done.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), *(F.col(v).alias(k) for v, k in zip(values, measures)))


def heavy_keys(counts: DataFrame, field: str, key: str, n: str, per_cent: int) -> DataFrame:
    """Keys of at least ``per_cent`` % of the counted rows of their ``field``; null keys count for nothing.

    ``counts`` has one row per (field, key). Integer arithmetic only, so the border case is exact.
    """
    known = counts.where(F.col(key).isNotNull())
    totals = known.groupBy(F.col(field).alias("__f")).agg(F.sum(n).alias("__t"))
    return known.join(totals, F.col(field) == F.col("__f")).where(F.col(n) * 100 >= F.col("__t") * per_cent).select(F.col(field).alias("key_field"), F.col(key).alias("key_value"))
