"""Connected components by alternating large-star and small-star rewrites of the edge table.

Edges are rows (hi, lo) with hi > lo. Large-star links every larger neighbour of a node to the smallest
in its neighbourhood; small-star does so for the node and its smaller neighbours. Both keep components
and shrink distances, until every node is linked to its component's minimum. Each rewrite is a
partially aggregated minimum per node and a join back; nodes with very many edges are spread over
tasks in that join. Edges only ever live in tables of the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from evidra.operators.skew import salted_lookup
from evidra.session import new_path, release


def _rewrite(pairs: DataFrame, total: int) -> DataFrame:
    """``pairs``(u, v) -> (u, v, m), m being the smallest of u and its v."""
    stats = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("deg"))
    return salted_lookup(pairs, stats, "u", "deg", total, F.col("v"))


def large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select(F.explode(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))).alias("e")).select("e.u", "e.v")
    return _rewrite(both, 2 * total).where(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def small_star(edges: DataFrame, total: int) -> DataFrame:
    r = _rewrite(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")), total)
    out = r.select(F.explode(F.array(F.struct(F.col("v").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("u").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo")
    return out.where(F.col("hi") > F.col("lo")).distinct()


def _write(edges: DataFrame) -> tuple[DataFrame, str, tuple[int, int]]:
    """The written edges, their path, and what tells whether they changed: number and combined hash."""
    spark, seen = edges.sparkSession, Observation()
    path = new_path(spark, "edges")
    edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).write.parquet(path)
    got = seen.get
    return spark.read.schema("hi bigint, lo bigint").parquet(path), path, (got["n"] or 0, got["x"] or 0)


def components(pairs: DataFrame, a: str, b: str, ids: DataFrame, id_col: str, *, max_rounds: int = 60) -> DataFrame:
    """(node, group_id) for every id linked to another; ``group_id`` is the smallest id of its component.

    ``pairs`` may hold nulls, either order, repeats, pairs of an id with itself, and ids that are not in
    ``ids``: none of those link anything. Empty tables give no rows. Other columns are not read.
    """
    spark = pairs.sparkSession
    clean = pairs.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges, path, mark = _write(clean)
    known = ids.select(F.col(id_col).alias("u")).where(F.col("u").isNotNull())
    ends = edges.select(F.explode(F.array("hi", "lo")).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("deg")).join(known, "u", "left_semi").withColumn("there", F.lit(True))
    for side, other in (("hi", "lo"), ("lo", "hi")):
        edges = salted_lookup(edges, ends.withColumnRenamed("u", side), side, "deg", 2 * mark[0], F.col(other)).where(F.col("there")).select("hi", "lo")
    edges, checked, mark = _write(edges)
    release(spark, path)
    path = checked
    for _ in range(max_rounds):
        if not mark[0]:
            break
        nxt, new, now = _write(small_star(large_star(edges, mark[0]), mark[0]))
        release(spark, path)
        edges, path, same, mark = nxt, new, now == mark, now
        if same:
            break
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("group_id")).union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("group_id")).distinct())
