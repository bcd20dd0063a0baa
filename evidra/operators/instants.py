"""Time texts of many forms, zones and precisions as UTC instants, by way of a dictionary.

Rows carry a text and the feed that wrote it. Distinct (text, zone, date order) go into a dictionary,
each is parsed once, the dictionary is kept as a table and only grows by texts it has not seen, and the
instants are joined back to the rows. Parsing is all JVM expressions.

Rules: a text with a zone or an offset denotes that instant; one with a time of day but no zone is read
on the feed's wall clock; a date alone is 00:00:00 UTC. Wall clock readings that occurred twice or never
in their zone, dates and times that don't exist, and texts without a date give null. Digits-only dates
whose order is open are read in the feed's order; where only one order gives a date, that is it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.operators.skew import salted_lookup
from evidra.session import exists, materialize, new_path

#: Zone abbreviations and their offsets in seconds.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 3600, "BST": 3600, "CET": 3600, "CEST": 7200, "EET": 7200, "EEST": 10800, "MSK": 10800,
    "EST": -18000, "EDT": -14400, "CST": -21600, "CDT": -18000, "MST": -25200, "MDT": -21600, "PST": -28800, "PDT": -25200, "NST": -12600, "NDT": -9000,
    "AKST": -32400, "AKDT": -28800, "HST": -36000, "JST": 32400, "KST": 32400, "AEST": 36000, "AEDT": 39600, "NPT": 20700, "IST": 19800,
}
#: Month names by their first three letters.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
#: Two-digit years and their open orders are resolved within these years, and epochs outside them are none; a four-digit year stands as written.
FIRST_YEAR, LAST_YEAR = 2016, 2026

_MON = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_DAY = r"(?:(?:mon|tue(?:s)?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+)?"
_ZONE = r"(?:\s*(z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[a-z]{2,4}|[a-z]+(?:/[a-z_+-]+[0-9]*)+)(?:\s*\[([a-z/_+0-9-]+)\])?)?"
_TAIL = r"(?:(?:t|,?\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?:\s*([ap])\.?m\.?(?![a-z]))?" + _ZONE + r")?$"
# Each form: pattern and where year, month, day, hour, minute, second, half-day, zone and bracketed zone stand.
_FORMS = [
    ("ymd", r"^(?i)" + _DAY + r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TAIL),
    ("open", r"^(?i)" + _DAY + r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})" + _TAIL),
    ("dmon", r"^(?i)" + _DAY + r"(\d{1,2})(?:st|nd|rd|th)?[- ]" + _MON + r"\.?,?[- ](\d{4}|\d{2})" + _TAIL),
    ("mond", r"^(?i)" + _DAY + _MON + r"\.?\s(\d{1,2})(?:st|nd|rd|th)?,?\s(\d{4})" + _TAIL),
    ("compact", r"^(?i)(\d{4})(\d{2})(\d{2})(?:t?(\d{2})(\d{2})(?:(\d{2})(?:[.,]\d+)?)?()" + _ZONE + r")?$"),
]
_EPOCH = r"^(\d{10})(?:\d{3}|\d{6}|\d{9})?(?:\.\d*)?$"

DICTIONARY = T.StructType([T.StructField("raw", T.StringType()), T.StructField("zone", T.StringType()), T.StructField("date_order", T.StringType()), T.StructField("utc_second", T.LongType())])


def _int(c: Column) -> Column:
    return F.when(c != "", c).cast("int")


def _civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01, or null for a date that doesn't exist."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    good = y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= last)
    return F.unix_date(F.make_date(F.when(good, y), m, d))


def _full_year(text: Column) -> Column:
    n = _int(text)
    return F.when(F.length(text) == 2, n + 2000).otherwise(n)


def _offset_at(utc: Column, zone: Column) -> Column:
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(utc), zone)) - utc


def _wall_to_utc(local: Column, zone: Column) -> Column:
    """The one instant at which ``zone`` showed ``local``; null where there were two or none."""
    a, b = local - _offset_at(local - 93_600, zone), local - _offset_at(local + 93_600, zone)
    a_ok, b_ok = a + _offset_at(a, zone) == local, b + _offset_at(b, zone) == local
    return F.when(a == b, F.when(a_ok, a)).when(a_ok & ~b_ok, a).when(b_ok & ~a_ok, b)


def _known_zone(zone: Column, zones: list[str]) -> Column:
    """The canonical name of an area zone (any letter case), else null: an unknown name must not raise."""
    return F.element_at(F.create_map(*(F.lit(x) for z in zones for x in (z.lower(), z))), F.lower(zone))


def parse_texts(texts: DataFrame, years: tuple[int, int] = (FIRST_YEAR, LAST_YEAR)) -> DataFrame:
    """``texts``(raw, zone, date_order) with ``utc_second``; one narrow pass without Python.

    ``years``: within them two-digit years and their open orders are resolved, and digits alone are an epoch; a four-digit year stands as written.
    """
    first_year, last_year = years
    spark = texts.sparkSession
    zones = sorted(z for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds() if "/" in z and not z.startswith(("Etc/", "SystemV/")))
    t = F.regexp_replace(F.col("raw"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    df = texts.withColumn("__t", t)
    form, parts = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for name, rx in reversed(_FORMS):
        hit = F.col("__t").rlike(rx)
        form = F.when(hit, F.lit(name)).otherwise(form)
        parts = F.when(hit, F.split(F.regexp_replace(F.col("__t"), rx, "$1|$2|$3|$4|$5|$6|$7|$8|$9"), r"\|", -1)).otherwise(parts)
    df = df.withColumn("__form", form).withColumn("__p", parts)
    p = [F.col("__p")[i] for i in range(9)]
    month = F.element_at(F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv)), F.lower(F.substring(F.when(F.col("__form") == "dmon", p[1]).otherwise(p[0]), 1, 3)))
    short = F.length(p[2]) == 2
    mdy, dmy = _civil(_full_year(p[2]), _int(p[0]), _int(p[1])), _civil(_full_year(p[2]), _int(p[1]), _int(p[0]))
    ymd = F.when(short & (F.length(p[0]) == 2), _civil(_full_year(p[0]), _int(p[1]), _int(p[2])))
    inside = lambda days: F.when(~short | days.between(F.unix_date(F.make_date(F.lit(first_year), F.lit(1), F.lit(1))), F.unix_date(F.make_date(F.lit(last_year), F.lit(12), F.lit(31)))), days)
    readings = F.array_distinct(F.array_compact(F.array(*(inside(x) for x in (mdy, dmy, ymd)))))
    named = F.when(F.col("date_order") == "mdy", inside(mdy)).when(F.col("date_order") == "dmy", inside(dmy)).when(F.col("date_order") == "ymd", inside(ymd))
    opened = F.coalesce(named, F.when(F.size(readings) == 1, readings[0]))
    days = (
        F.when(F.col("__form").isin("ymd", "compact"), _civil(_int(p[0]), _int(p[1]), _int(p[2])))
        .when(F.col("__form") == "open", opened)
        .when(F.col("__form") == "dmon", _civil(_full_year(p[2]), month, _int(p[0])))
        .when(F.col("__form") == "mond", _civil(_full_year(p[2]), month, _int(p[1])))
    )
    df = df.withColumn("__days", days)
    h, mi, s, half = _int(p[3]), _int(p[4]), F.coalesce(_int(p[5]), F.lit(0)), F.lower(p[6])
    h = F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(half == "p", 12).otherwise(0))
    clock = F.when(h.between(0, 23) & mi.between(0, 59) & s.between(0, 59), h * 3600 + mi * 60 + s).cast("bigint")
    df = df.withColumn("__dated", p[3] == "").withColumn("__local", F.col("__days").cast("bigint") * 86_400 + clock).withColumn("__z", F.upper(p[7]))
    z = F.col("__z")
    digits = F.regexp_replace(F.substring(z, 2, 5), ":", "")
    oh, om = F.substring(digits, 1, 2), F.substring(digits, 3, 2)
    numeric = F.when(_int(oh).between(0, 15) & F.coalesce(_int(om), F.lit(0)).between(0, 59), (_int(oh) * 3600 + F.coalesce(_int(om), F.lit(0)) * 60) * F.when(z.startswith("-"), -1).otherwise(1))
    named_off = F.element_at(F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv)), z)
    offset = F.when(z.rlike(r"^[+-]\d"), numeric).otherwise(named_off).cast("bigint")
    wall = F.when(z == "", F.coalesce(F.when(p[8] != "", _known_zone(p[8], zones)), _known_zone(F.col("zone"), zones), F.when(F.upper("zone").isin("UTC", "GMT", "Z"), F.lit("UTC")))).when(z.contains("/"), _known_zone(z, zones))
    df = df.withColumn("__off", offset).withColumn("__wall", wall)
    timed = F.when(F.col("__off").isNotNull(), F.col("__local") - F.col("__off")).when(F.col("__wall") == "UTC", F.col("__local")).otherwise(_wall_to_utc(F.col("__local"), F.col("__wall")))
    epoch = F.regexp_extract("__t", _EPOCH, 1)
    low, high = int((first_year - 1970) * 365.2425) * 86_400 - 172_800, int((last_year + 1 - 1970) * 365.2425) * 86_400 + 172_800
    number = F.when(epoch != "", epoch).cast("bigint")
    second = F.when(epoch != "", F.when(number.between(low, high), number)).when(F.col("__dated"), F.col("__days").cast("bigint") * 86_400).otherwise(timed)
    two_digits = F.col("__form").isin("open", "dmon", "mond") & short
    return df.select("raw", "zone", "date_order", F.when(~F.coalesce(two_digits, F.lit(False)) | second.between(low, high), second).alias("utc_second"))


def _key() -> Column:
    return F.xxhash64("raw", "zone", "date_order")


class InstantDictionary:
    """The table of parsed texts at ``path``; ``update`` adds what is new, ``apply`` joins it to rows."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "instants")

    def _parts(self) -> list[str]:
        """The whole parts of the table, a folder for each call that learned something."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [f.getPath().toString() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(f for f in found if exists(self.spark, f"{f}/_SUCCESS"))

    def read(self) -> DataFrame:
        """All parts by name: Spark takes two scans of one folder for the same even if files came in between."""
        parts = self._parts()
        return self.spark.read.schema(DICTIONARY).parquet(*parts) if parts else self.spark.createDataFrame([], DICTIONARY)

    @staticmethod
    def count(rows: DataFrame) -> DataFrame:
        """Distinct (raw, zone, date_order) of ``rows`` with the number of rows of each, written once: what the other methods need of the rows."""
        known = rows.where(F.col("raw").isNotNull()).groupBy("raw", "zone", "date_order").agg(F.count(F.lit(1)).alias("n"))
        return materialize(known.withColumn("key", _key()), "time-texts")[0]

    def update(self, rows: DataFrame) -> int:
        """Parse the texts of ``rows`` that the table lacks and append them; the table's size then."""
        return self.learn(self.count(rows))

    def learn(self, counts: DataFrame) -> int:
        old = self.read()
        seen = old.select(_key().alias("k"), F.col("raw").alias("r"), F.col("zone").alias("z"), F.col("date_order").alias("o"))
        same = (F.col("key") == F.col("k")) & (F.col("raw") == F.col("r")) & F.col("zone").eqNullSafe(F.col("z")) & F.col("date_order").eqNullSafe(F.col("o"))
        new = counts if old.isEmpty() else counts.join(seen, same, "left_anti")
        parse_texts(new.select("raw", "zone", "date_order")).write.parquet(f"{self.path}/texts-{uuid.uuid4().hex[:12]}")
        return self.read().count()

    def apply(self, rows: DataFrame, ids: list[str], counts: DataFrame | None = None) -> DataFrame:
        """``ids`` of every row and its ``utc_second``. Texts that many rows share are spread over tasks."""
        counts = self.count(rows) if counts is None else counts
        total = counts.agg(F.sum("n")).first()[0] or 0
        # A row per 64-bit key: texts that share a key by accident stay apart inside ``hits``.
        weights = counts.groupBy("key").agg(F.sum("n").alias("n"))
        hits = self.read().groupBy(_key().alias("key")).agg(F.collect_list(F.struct("raw", "zone", "date_order", "utc_second")).alias("hits"))
        keyed = rows.select(*(F.col(c).alias(f"id{i}") for i, c in enumerate(ids)), "raw", "zone", "date_order", F.when(F.col("raw").isNotNull(), _key()).alias("key"))
        joined = salted_lookup(keyed, hits.join(weights, "key"), "key", "n", total, F.struct(*(f"id{i}" for i in range(len(ids)))))
        same = lambda h: (h["raw"] == F.col("raw")) & h["zone"].eqNullSafe(F.col("zone")) & h["date_order"].eqNullSafe(F.col("date_order"))
        return joined.select(*(F.col(f"id{i}").alias(c) for i, c in enumerate(ids)), F.try_element_at(F.filter("hits", same), F.lit(1))["utc_second"].alias("utc_second"))


def normalise(rows: DataFrame, ids: list[str], dictionary: InstantDictionary | None = None) -> DataFrame:
    """``rows``(*ids, raw, zone, date_order) -> (*ids, utc_second), null where the text denotes no one instant.

    Null and blank texts give null; very long texts match no form and give null; repeated rows each come
    out; an empty table gives no rows; other columns are not read. ``dictionary`` carries parsed texts
    from one call to the next.
    """
    d = dictionary or InstantDictionary(rows.sparkSession)
    slim = rows.select(*ids, "raw", "zone", "date_order")
    counts = d.count(slim)
    d.learn(counts)
    return d.apply(slim, ids, counts)
