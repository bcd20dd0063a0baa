"""A slot clock that repeats every hour, variants over slots and days, and rotation of tracks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The hour's slots (type, offset, duration in seconds) and the rotation's rest and share of fresh tracks.
TEMPLATE = [
    ("station_id", 0, 30), ("music", 30, 570), ("dj_insert", 600, 60), ("music", 660, 540), ("spot", 1200, 120), ("music", 1320, 480), ("news_desk", 1800, 300),
    ("music", 2100, 420), ("dj_insert", 2520, 60), ("request", 2580, 300), ("music", 2880, 420), ("spot", 3300, 120), ("variety", 3420, 150), ("station_id", 3570, 30),
]
REST_SECONDS, FRESH_SHARE = 7200.0, 0.5


def template_faults(template: list[tuple[str, int, int]]) -> list[str]:
    """Why a template does not tile the hour; empty if it does."""
    out, expected = [], 0
    for i, (_, offset, duration) in enumerate(template):
        if offset != expected:
            out.append(f"slot {i}: offset {offset}, expected {expected}")
        if duration <= 0:
            out.append(f"slot {i}: duration {duration}")
        expected += duration
    return out + ([f"covers {expected} s of 3600"] if expected != 3600 else [])


def template_table(spark: SparkSession, template: list[tuple[str, int, int]] = TEMPLATE) -> DataFrame:
    return spark.createDataFrame([(i, *s) for i, s in enumerate(template)], "slot_index int, slot_type string, offset_s int, duration_s int")


def with_slot(df: DataFrame, epoch: str, template: list[tuple[str, int, int]] = TEMPLATE) -> DataFrame:
    """``df`` with slot_index, slot_type and seconds_into_slot: the range join with 14 rows as one expression."""
    into = F.pmod(F.col(epoch), F.lit(3600))
    index, kind, since = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for i, (slot, offset, duration) in reversed(list(enumerate(template))):
        here = into < offset + duration
        index, kind, since = F.when(here, i).otherwise(index), F.when(here, slot).otherwise(kind), F.when(here, into - offset).otherwise(since)
    return df.withColumn("slot_index", index).withColumn("slot_type", kind).withColumn("seconds_into_slot", since.cast("bigint"))


def variant(variants: list[str], slot_index: Column, epoch: Column) -> Column:
    """A variant by slot and UTC day: neighbours differ, and a slot's variant moves on every day."""
    if not variants:
        return F.lit("")
    return F.element_at(F.array(*(F.lit(v) for v in sorted(variants))), (F.pmod(slot_index + F.floor(epoch / F.lit(86_400)), F.lit(len(variants))) + 1).cast("int"))


def slot_starts(df: DataFrame, start: str, horizon: int = 900, template: list[tuple[str, int, int]] = TEMPLATE) -> DataFrame:
    """Every slot from the top of the one at ``start`` until ``horizon`` seconds on: (…, slot_index, slot_type, slot_start, duration_s)."""
    hours = df.withColumn("__h", F.explode(F.sequence(F.floor(F.col(start) / 3600) * 3600, F.col(start) + max(horizon, 900), F.lit(3600))))
    slots = F.array(*(F.struct(F.lit(i).alias("slot_index"), F.lit(k).alias("slot_type"), F.lit(o).alias("o"), F.lit(d).alias("duration_s")) for i, (k, o, d) in enumerate(template)))
    df = hours.withColumn("__s", F.explode(slots)).withColumn("slot_start", F.col("__h") + F.col("__s.o"))
    df = df.where((F.col("slot_start") + F.col("__s.duration_s") > F.col(start)) & (F.col("slot_start") < F.col(start) + max(horizon, 900)))
    return df.select(*[c for c in df.columns if not c.startswith("__") and c != "slot_start"], F.col("__s.slot_index").alias("slot_index"), F.col("__s.slot_type").alias("slot_type"), "slot_start", F.col("__s.duration_s").alias("duration_s"))


def rotation(slots: DataFrame, channel: str, tracks: list[tuple[str, bool]], rest: float = REST_SECONDS, fresh_share: float = FRESH_SHARE) -> DataFrame:
    """The track of every music slot of a channel, in time order: (channel, slot_start, track_id).

    Least recently played first among tracks that have rested, fresh and other tracks by turns; the first
    track if none has rested. Each choice changes the next, so a channel is one sequential fold; channels run in parallel.
    """
    period = max(1, round(1 / fresh_share)) if fresh_share > 0 else 0

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        last: dict[str, float] = {}
        out, n = [], 0
        for t in sorted(pdf["slot_start"].tolist()):
            rested = [x for x in tracks if x[0] not in last or t - last[x[0]] >= rest]
            if rested:
                fresh = bool(period) and n % period == 0
                n += 1
                pool = [x for x in rested if x[1] == fresh] or rested
                pick = min(pool, key=lambda x: (last.get(x[0], float("-inf")), x[0]))[0]
            else:
                pick = min(x[0] for x in tracks)
            last[pick] = t
            out.append((key[0], t, pick))
        return pd.DataFrame(out, columns=[channel, "slot_start", "track_id"])

    return slots.groupBy(channel).applyInPandas(fold, f"{channel} {dict(slots.dtypes)[channel]}, slot_start bigint, track_id string")


def classify_batches(texts: DataFrame, id_col: str, text_col: str, model, schema: str = "label string, confidence double") -> DataFrame:  # noqa: ANN001
    """(id, label, confidence) by an injected ``model(list of texts) -> list of (label, confidence)``; a failing batch gives nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                got = model(b["t"].tolist())
            except Exception:  # noqa: BLE001 - a model's failure is an empty answer
                got = [(None, None)] * len(b)
            yield pd.DataFrame({"i": b["i"], "label": [g[0] for g in got], "confidence": pd.Series([g[1] for g in got], dtype="float64")})

    return texts.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(run, f"i {dict(texts.dtypes)[id_col]}, {schema}").withColumnRenamed("i", id_col)
