"""Months, epochs and retry times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_day(epoch: Column) -> Column:
    """The UTC date of epoch seconds, whatever the session's zone."""
    return F.date_from_unix_date(F.floor(epoch / F.lit(86_400)).cast("int"))


def wall_epoch(c: Column) -> Column:
    """Seconds of a timestamp without zone read as UTC, whatever the session's zone."""
    return F.unix_date(c.cast("date")).cast("bigint") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def month_of(epoch: Column) -> Column:
    return F.date_format(utc_day(epoch), "yyyy-MM")


def add_months_ym(ym: Column, n: int) -> Column:
    return F.date_format(F.add_months(F.to_date(F.concat(ym, F.lit("-01"))), n), "yyyy-MM")


def month_start(ym: Column) -> Column:
    return F.concat(ym, F.lit("-01T00:00:00"))


def event_time(record_date: Column, capture_date: Column) -> Column:
    return F.coalesce(record_date, capture_date)


def filing_date(text: Column) -> Column:
    """``02-JUN-21``, ``02-JUN-2021``, ISO and US dates as epoch seconds of that UTC day; a day that doesn't exist gives null."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    mon = F.try_element_at(F.create_map(*(F.lit(x) for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split()) for x in (m, f"{i + 1:02d}"))), F.lower(F.regexp_extract(t, r"^\d{1,2}-([A-Za-z]{3})-\d{2,4}$", 1)))
    year = F.regexp_extract(t, r"^\d{1,2}-[A-Za-z]{3}-(\d{2}|\d{4})$", 1)
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    iso = F.when(year != "", F.concat_ws("-", year, mon, F.lpad(F.regexp_extract(t, r"^(\d{1,2})-", 1), 2, "0")))
    us = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.concat_ws("-", F.regexp_extract(t, r"(\d{4})$", 1), F.lpad(F.regexp_extract(t, r"^(\d{1,2})/", 1), 2, "0"), F.lpad(F.regexp_extract(t, r"/(\d{1,2})/", 1), 2, "0")))
    plain = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
    day = F.coalesce(iso, us, plain)
    return F.unix_date(F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day).try_cast("date")).cast("bigint") * 86_400


def compact_epoch(text: Column) -> Column:
    """``20240501T120000Z`` (the Z may lack) as epoch seconds, else null."""
    rx = r"^(\d{8})T(\d{6})Z?$"
    return F.unix_seconds(F.try_to_timestamp(F.when(text.rlike(rx), F.concat(F.regexp_extract(text, rx, 1), F.regexp_extract(text, rx, 2), F.lit("+0000"))), F.lit("yyyyMMddHHmmssZ")))


def capture_epoch(stamp: Column) -> Column:
    """An 8 to 14 digit capture stamp as epoch seconds, 0 if it is none."""
    full = F.when(stamp.rlike(r"^\d{8}(\d{2}){0,3}$"), F.rpad(stamp, 14, "0"))
    return F.coalesce(F.unix_seconds(F.try_to_timestamp(F.concat(full, F.lit("+0000")), F.lit("yyyyMMddHHmmssZ"))), F.lit(0))


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(60) * F.pow(F.lit(2), F.greatest(F.lit(0), attempts - 1)), F.lit(3600)).cast("bigint")
