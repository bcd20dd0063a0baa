"""A work queue as a table: claim, finish, count. One writer per batch, so nothing races."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.functions.dates import backoff_seconds

STATES = ["pending", "claimed", "done", "dead"]


def claim(jobs: DataFrame, now: int, most: int) -> DataFrame:
    """``jobs``(id, status, attempts, scheduled_at, ...) with the first ``most`` runnable ones claimed, by id."""
    due = jobs.where((F.col("status") == "pending") & (F.col("scheduled_at") <= now)).select(F.col("id").alias("__id")).orderBy("__id").limit(most)
    j = jobs.join(due, F.col("id") == F.col("__id"), "left")
    taken = F.col("__id").isNotNull()
    return j.withColumn("status", F.when(taken, "claimed").otherwise(F.col("status"))).withColumn("attempts", F.col("attempts") + taken.cast("int")).select(*jobs.columns)


def finish(jobs: DataFrame, results: DataFrame, now: int, most_attempts: int = 5) -> DataFrame:
    """Claimed jobs with ``results``(id, error): done without an error, else pending again after a growing wait, at last dead."""
    r = results.select(F.col("id").alias("__id"), F.col("error").alias("__error"))
    j = jobs.join(r, F.col("id") == F.col("__id"), "left")
    hit, failed, spent = F.col("__id").isNotNull() & (F.col("status") == "claimed"), F.col("__error").isNotNull(), F.col("attempts") >= most_attempts
    status = F.when(hit & ~failed, "done").when(hit & spent, "dead").when(hit, "pending").otherwise(F.col("status"))
    at = F.when(hit & failed & ~spent, now + backoff_seconds(F.col("attempts"))).otherwise(F.col("scheduled_at"))
    return j.withColumn("scheduled_at", at).withColumn("status", status).select(*jobs.columns)


def depths(jobs: DataFrame) -> DataFrame:
    """Jobs by state, every state with its number."""
    n = jobs.agg(*(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATES))
    return n.select(F.explode(F.array(*(F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in STATES))).alias("x")).select("x.*")


def newest_of(folders: list[DataFrame], order: str, most: int = 20) -> DataFrame:
    """The newest rows of several result tables in one list."""
    out = folders[0]
    for f in folders[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.orderBy(F.desc(order)).limit(most)


def first_requests(requests: DataFrame, item: str, order: str) -> DataFrame:
    """A queue without repeats, in the order in which items were first asked for."""
    return requests.where(F.coalesce(item, F.lit("")) != "").groupBy(item).agg(F.min(order).alias(order))


def recheck(due: DataFrame, answers: DataFrame, resolved: DataFrame) -> DataFrame:
    """``due``(key, grp, ...) with ``outcome``: unchecked where the group's answer was bad or never came, else present or gone.

    ``answers``(grp, good): a row a group; ``resolved``(key): what the good answers found.
    """
    good = answers.where("good").select(F.col("grp").alias("__grp")).distinct()
    found = resolved.select(F.col("key").alias("__key")).distinct()
    met = due.join(good, F.col("grp") == F.col("__grp"), "left").join(found, F.col("key") == F.col("__key"), "left")
    outcome = F.when(F.col("__grp").isNull(), "unchecked").when(F.col("__key").isNotNull(), "present").otherwise("gone")
    return met.select(*due.columns, outcome.alias("outcome"))
