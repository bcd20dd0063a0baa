"""Window metrics with a sample floor, and small numeric rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidra.functions.dates import utc_day

#: Tempo range, full activity, and least sample of a window's mood.
TEMPO_LOW, TEMPO_HIGH, TEMPO_BAND = 70, 140, 10
FULL_VELOCITY, LEAST_SAMPLE = 30.0, 5


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def sufficient(value: Column, n: Column, least: int = LEAST_SAMPLE) -> Column:
    return value.isNotNull() & (n >= least)


#: The metrics of an outcome record.
METRICS = ["sentiment_during", "sentiment_after", "message_velocity", "viewer_delta"]


def insufficient(least: int = LEAST_SAMPLE) -> Column:
    """Whether any of an outcome's four metrics (structs of value and n) misses the sample floor."""
    enough = F.lit(True)
    for m in METRICS:
        enough = enough & sufficient(F.col(m)["value"], F.col(m)["n"], least)
    return ~enough


def keep_signal() -> Column:
    """Delivered encores among an outcome's roar events."""
    return F.size(F.filter("roar_events", lambda r: r["delivered_encore"]))


def band(c: Column) -> Column:
    """0, 1 or 2: the third of [0, 1]."""
    return F.when(c < 1 / 3, 0).when(c < 2 / 3, 1).otherwise(2)


def mood(sentiment: Column, n: Column, velocity: Column, least: int = LEAST_SAMPLE, full: float = FULL_VELOCITY) -> Column:
    """Energy, valence, tempo range and bands of a window; below the sample floor the standing mood, marked insufficient. Rounds half to even."""
    valence, energy = clamp(sentiment), clamp(F.coalesce(velocity, F.lit(0.0)) / full)
    centre = TEMPO_LOW + energy * (TEMPO_HIGH - TEMPO_LOW)
    read = F.struct(F.bround(energy, 3).alias("energy"), F.bround(valence, 3).alias("valence"), F.bround(centre - TEMPO_BAND, 0).cast("int").alias("tempo_lo"), F.bround(centre + TEMPO_BAND, 0).cast("int").alias("tempo_hi"), band(energy).alias("energy_band"), band(valence).alias("valence_band"), F.lit(False).alias("insufficient"))
    standing = F.struct(F.lit(0.4).alias("energy"), F.lit(0.55).alias("valence"), F.lit(82).alias("tempo_lo"), F.lit(98).alias("tempo_hi"), F.lit(1).alias("energy_band"), F.lit(1).alias("valence_band"), F.lit(True).alias("insufficient"))
    return F.when(sufficient(sentiment, n, least), read).otherwise(standing)


def loose_date(n: Column) -> Column:
    """A number that is a year, epoch seconds or milliseconds, as text; others as they are, null as null."""
    day = lambda s: utc_day(s).cast("string")
    return F.when(n.between(1900, 2100), n.cast("bigint").cast("string")).when((n >= 1e9) & (n < 1e11), day(n)).when((n >= 1e11) & (n < 1e14), day(n / 1000)).otherwise(n.cast("bigint").cast("string"))


def number_or(text: Column, default: float) -> Column:
    """A setting's number, or its default where it is missing or none."""
    v = text.try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v).otherwise(F.lit(default))


def model_label(raw: Column, known: list[str]) -> Column:
    """(carrier, confidence, rationale) of a model's answer: the text from the first { to the last }; unknown carriers and odd numbers are dropped."""
    from evidra.functions.text import json_span

    j = json_span(raw, "{", "}")
    v = F.from_json(j, "carrier string, confidence double, rationale string")
    return F.struct(F.when(v["carrier"].isin(known), v["carrier"]).alias("carrier"), F.coalesce(clamp(v["confidence"]), F.lit(0.0)).alias("confidence"), F.coalesce(F.substring(v["rationale"], 1, 200), F.lit("")).alias("rationale"))


def item_gone(status: Column, body: Column) -> Column:
    """404, or 200 with ``deleted`` true: anything else counts as present."""
    return (status == 404) | ((status == 200) & (F.coalesce(F.get_json_object(body, "$.deleted"), F.lit("")) == "true"))
