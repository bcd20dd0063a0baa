"""Row checks: each gives an array of reasons, empty when all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.text import foreign_numbers, trim_all
from evidra.operators.skew import two_level_last, two_level_running


def reasons(*checks: tuple[Column, str]) -> Column:
    """Texts of the checks that hold (a check is a fault)."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for c, t in checks)))


def summary_faults(summary: Column, source: Column, most: int = 320) -> Column:
    t = trim_all(F.coalesce(summary, F.lit("")))
    return reasons((t == "", "empty"), (t.rlike("[—―‒]"), "dash"), (F.length(t) >= most, "too long"), (F.size(F.regexp_extract_all(t, F.lit("[.!?]+"), F.lit(0))) > 2, "more than two sentences"), (F.size(foreign_numbers(t, F.coalesce(source, F.lit("")))) > 0, "number without source"))


def line_faults(speaker: Column, text: Column, emotion: Column, pace: Column, speakers: list[str]) -> Column:
    return reasons((~F.coalesce(speaker.isin(speakers), F.lit(False)), "speaker"), (F.coalesce(text, F.lit("")) == "", "text"), (text.rlike("[—–]"), "dash"), (~F.coalesce(emotion, F.lit(0.5)).between(0.0, 1.0), "emotion"), (~F.coalesce(pace, F.lit(1.0)).between(0.25, 2.0), "pace"))


def term_faults(term: Column, excerpts: Column) -> Column:
    """Faults of a proposed term: over four words, or in none of the excerpts (an array)."""
    t = trim_all(F.coalesce(term, F.lit("")))
    return reasons((t == "", "empty"), (t.rlike("[—―‒]"), "dash"), (F.size(F.split(t, r"\s+")) > 4, "more than four words"), (~F.exists(excerpts, lambda e: F.contains(F.lower(e), F.lower(t))), "in no excerpt"))


def unknown_fields(raw: Column, allowed: list[str]) -> Column:
    """Names in a JSON object that the schema lacks."""
    return F.array_except(F.json_object_keys(raw), F.array(*(F.lit(a) for a in allowed)))


def repeated_runs(df: DataFrame, group: str, order: str, value: str, least: int = 3, stretch: int = 1 << 20) -> DataFrame:
    """(group, order) where ``value`` stands for the ``least``-th time in a row. Null values are left out first.

    ``order`` is a unique number; no task orders more than a ``stretch`` of it of a group: places are counted
    from stretch to stretch, and the place at which a run began is carried on.
    """
    runs = df.where(F.col(value).isNotNull()).select(group, order, value).withColumn("__stretch", F.floor(F.col(order) / stretch)).withColumn("__one", F.lit(1))
    runs = two_level_running(runs, group, "__stretch", [order], "__one", "__n")
    runs = two_level_last(runs, group, "__stretch", [order], value, "__before", include_own=False)
    runs = runs.withColumn("__start", F.when(~F.col("__before").eqNullSafe(F.col(value)), F.col("__n")))
    runs = two_level_last(runs, group, "__stretch", [order], "__start", "__began")
    return runs.where(F.col("__n") - F.col("__began") == least - 1).select(group, order)


def gaps(df: DataFrame, group: str, start: str, length: str) -> DataFrame:
    """(group, start, expected) of rows that don't begin where the one before ends."""
    w = Window.partitionBy(group).orderBy(start)
    return df.withColumn("expected", F.lag(F.col(start) + F.col(length)).over(w)).where(F.col("expected") != F.col(start)).select(group, start, "expected")


def citation_faults(lines: DataFrame, id_col: str, text: str, record: str, records: DataFrame) -> DataFrame:
    """(id, fault) of ``lines``, null where all is well, against the ``records``(id, excerpt) they cite."""
    r = records.select(F.col("id").alias("__id"), F.col("excerpt").alias("__excerpt"))
    j = lines.select(F.col(id_col).alias("__line"), F.col(text).alias("__text"), F.col(record).alias("__cited")).join(r, F.col("__cited") == F.col("__id"), "left")
    numbers = F.col("__text").rlike(r"[\d$]")
    foreign = F.size(foreign_numbers(F.col("__text"), F.coalesce("__excerpt", F.lit("")))) > 0
    fault = F.when(F.col("__cited").isNotNull() & F.col("__id").isNull(), "unknown record").when(F.col("__cited").isNull() & numbers, "number without record").when(numbers & foreign, "number not in record")
    return j.select(F.col("__line").alias(id_col), fault.alias("fault"))
