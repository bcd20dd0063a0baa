"""Corroboration within a time window, and links between records that share a value.

Links of a shared value are kept as membership: a row per record and kind with the shared value and the
number of partners. The pairs themselves would grow with the square of a value's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators.skew import two_level_running

#: Fixed value: 90 days.
WINDOW = 90 * 86_400


def corroborated(rows: DataFrame, window: int = WINDOW, among: Column | None = None) -> DataFrame:
    """Ids of ``rows``(id, source_id, carrier, alleged_issue, promo_name, ts) in a group of equal (kind, carrier, value) where two
    different sources lie within ``window``; the whole group counts. A null source is a source; empty values are no values.
    ``among``: which rows take part at all.

    Some neighbours in time order differ in source then, so neighbours are all that is compared. Groups are
    cut into stretches of a window's length; a stretch also holds the rows of the stretch before.
    """
    kinds = F.array(F.struct(F.lit("issue").alias("kind"), F.col("alleged_issue").alias("value")), F.struct(F.lit("promo").alias("kind"), F.col("promo_name").alias("value")))
    if among is not None:
        rows = rows.where(among)
    g = rows.where(F.col("carrier").isNotNull()).select("id", F.coalesce("source_id", F.lit("")).alias("src"), "carrier", "ts", F.explode(kinds).alias("k")).select("id", "src", "carrier", "ts", "k.kind", "k.value").where(F.coalesce("value", F.lit("")) != "")
    # A row also stands in the next stretch, as it may be the neighbour before that stretch's first row.
    home = F.floor(F.col("ts") / window)
    placed = g.withColumn("part", F.explode(F.array_distinct(F.array(home, home + 1))))
    w = Window.partitionBy("kind", "carrier", "value", "part").orderBy("ts", "id")
    near = placed.withColumn("p_src", F.lag("src").over(w)).withColumn("p_ts", F.lag("ts").over(w))
    good = near.where((F.col("p_src") != F.col("src")) & (F.col("ts") - F.col("p_ts") <= window)).select("kind", "carrier", "value").distinct()
    return g.join(good, ["kind", "carrier", "value"], "left_semi").select("id").distinct()


def link_membership(rows: DataFrame, in_terms: DataFrame | None = None, window: int = WINDOW) -> DataFrame:
    """(id, link_type, link_key, partners) of the rows that may be sources: those with at least one partner.

    ``rows``(id, carrier, promo_name, alleged_issue, ts, source): whoever ``source`` is true for gets links, to
    any other row. same_carrier_promo, same_claim_type and same_promo_terms_language (promotions of
    ``in_terms``(promo), small letters) count all others with the value; same_carrier_issue_window those
    within ``window`` seconds, by running counts over time that are cut into stretches. Empty values are no values.
    """
    sep, some = F.lit("; "), lambda c: F.coalesce(c, F.lit("")) != ""
    kind = lambda t, k: F.struct(F.lit(t).alias("t"), k.alias("k"))
    promo = F.concat(F.lit('promo="'), "promo_name", F.lit('" appears in a carrier terms diff'))
    whole = [
        F.when(some("carrier") & some("promo_name"), kind("same_carrier_promo", F.concat(F.lit("carrier="), "carrier", sep, F.lit("promo="), "promo_name"))),
        F.when(some("alleged_issue"), kind("same_claim_type", F.concat(F.lit("issue="), "alleged_issue"))),
    ]
    if in_terms is not None:
        rows = rows.join(in_terms.select(F.col("promo").alias("__promo")).distinct(), F.lower("promo_name") == F.col("__promo"), "left")
        whole.append(F.when(F.col("__promo").isNotNull(), kind("same_promo_terms_language", promo)))
    m = rows.select("id", "source", F.explode(F.array_compact(F.array(*whole))).alias("x")).select("id", "source", F.col("x.t").alias("link_type"), F.col("x.k").alias("link_key"))
    sizes = m.groupBy("link_type", "link_key").agg((F.count(F.lit(1)) - 1).alias("partners")).where("partners > 0")
    timed = rows.where(some("carrier") & some("alleged_issue") & F.col("ts").isNotNull()).select("id", "source", F.concat(F.lit("carrier="), "carrier", sep, F.lit("issue="), "alleged_issue", F.lit("; within 90 days")).alias("link_key"), "ts")
    near = partners_within(timed, "link_key", "ts", window, asked="source").where("partners > 0").select("id", F.lit("same_carrier_issue_window").alias("link_type"), "link_key", "partners")
    return m.where("source").join(sizes, ["link_type", "link_key"]).select("id", "link_type", "link_key", "partners").union(near)


def partners_within(rows: DataFrame, key: str, ts: str, window: int, asked: str | None = None) -> DataFrame:
    """``rows``(id, key, ts) with the number of other rows of the key within ``window`` of ts, both ends included; only of those where ``asked`` is true.

    Rows and the two ends of every row's window are put in one order; the running count of rows at the ends
    gives the number between. No pair is formed, and no task orders more than one stretch of a key.
    """
    mark = lambda what, at, ord_, one: F.struct(F.lit(what).alias("what"), at.alias("at"), F.lit(ord_).alias("ord"), F.lit(one).alias("one"))
    marks = F.array(mark("row", F.col(ts), 1, 1), mark("low", F.col(ts) - window, 0, 0), mark("high", F.col(ts) + window, 2, 0))
    if asked:
        marks = F.when(F.col(asked), marks).otherwise(F.slice(marks, 1, 1))
    ends = rows.select("id", key, F.explode(marks).alias("m")).select("id", key, "m.*").withColumn("part", F.floor(F.col("at") / (window // 8 + 1)))
    counted = two_level_running(ends, key, "part", ["at", "ord", "id"], "one", "before")
    per = counted.where("what <> 'row'").groupBy("id", key).agg((F.sum(F.when(F.col("what") == "high", F.col("before")).otherwise(-F.col("before"))) - 1).alias("partners"))
    return per
