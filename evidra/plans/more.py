"""Further queries: as-of and fallback joins, signals, pages, numbered lists, records of collected items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra import taxonomy as tx
from evidra.functions import dates, links, money, signals, text
from evidra.operators import amounts, asof, quality, queues, tables
from evidra.plans.core import _EV, _any_sql, _events
from evidra.session import table as read
from evidra.sources import collectors, sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""with l as (select * from {_EV} where event_type = 'purchase'), r as (select user_id, epoch, max(event_id) seen from {_EV} where event_type = 'view' group by 1, 2)
select l.event_id, r.seen from l asof left join r on l.user_id = r.user_id and l.epoch >= r.epoch""")
def last_view_before_purchase(spark: SparkSession, d: str) -> DataFrame:
    """Every purchase with its user's latest view at or before it."""
    e = _events(spark, d)
    views = e.where("event_type = 'view'").select("user_id", "epoch", F.col("event_id").alias("seen"))
    return asof.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "epoch"), views, "user_id", "epoch", "epoch", ["seen"]).select("event_id", "seen")


@query(f"""with w as (select epoch // 3600 * 3600 window_start, count(*) n, cast(sum(cast(round(value * 100) as bigint)) as double) / 10000.0 / count(*) s, count(*) / 60.0::double v from {_EV} group by 1),
m as (select *, least(1.0, greatest(0.0, s)) valence, least(1.0, greatest(0.0, v / 30.0)) energy from w)
select window_start, n, case when n >= 5 then round_even(energy, 3) else 0.4 end energy, case when n >= 5 then round_even(valence, 3) else 0.55 end valence, case when n >= 5 then cast(round_even(70 + energy * 70 - 10, 0) as int) else 82 end tempo_lo, case when n >= 5 then cast(round_even(70 + energy * 70 + 10, 0) as int) else 98 end tempo_hi, n < 5 insufficient from m""")
def mood_windows(spark: SparkSession, d: str) -> DataFrame:
    """Signals of hourly windows with a floor for small samples."""
    e = _events(spark, d).groupBy((F.floor(F.col("epoch") / 3600) * 3600).alias("window_start")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("s"))
    m = signals.mood(F.col("s").cast("double") / 10000.0 / F.col("n"), F.col("n"), F.col("n") / 60.0)
    return e.withColumn("m", m).select("window_start", "n", "m.energy", "m.valence", "m.tempo_lo", "m.tempo_hi", "m.insufficient")


@query(f"""with r as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, event_type order by event_id) i from {_EV})
select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id, event_type, i order by event_id) n from r) where n = 3""")
def third_in_a_row(spark: SparkSession, d: str) -> DataFrame:
    """Events that are the third of their type in a row for their user."""
    return quality.repeated_runs(_events(spark, d).select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("select event_id, row_number() over (order by event_id) new_id from events")
def assigned_ids(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive ids in the order of the events."""
    return sinks.with_ids(read(spark, d, "events").select("event_id"), "event_id", name="new_id")


@query("select event_id, list_filter(json_keys(props), lambda k: k not in ('a', 'b')) odd from events")
def unknown_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the events' JSON that a schema of a and b lacks."""
    return read(spark, d, "events").select("event_id", quality.unknown_fields(F.col("props"), ["a", "b"]).alias("odd"))


@query("select state, contact_method, cast(sum(complaint_count) as bigint) complaints from fcc_monthly_aggregates where month_ym >= '2020-01' and month_ym < '2021-01' and state is not null group by all")
def complaints_in_window(spark: SparkSession, d: str) -> DataFrame:
    """A half-open window of months: the filter reaches the scan."""
    return read(spark, d, "fcc_monthly_aggregates").where("month_ym >= '2020-01' and month_ym < '2021-01' and state is not null").groupBy("state", "contact_method").agg(F.sum("complaint_count").alias("complaints"))


@query("select id, loc_state, carrier from records where (loc_state is null or loc_state = 'CA') and carrier = 'norvane' and strftime(to_timestamp(record_date) at time zone 'UTC', '%Y-%m-%d') like '2022%'")
def drill_down(spark: SparkSession, d: str) -> DataFrame:
    """Records of a state and records without one, of a carrier and a year."""
    day = dates.utc_day(F.col("record_date")).cast("string")
    return read(spark, d, "records").where((F.col("loc_state").isNull() | (F.col("loc_state") == "CA")) & (F.col("carrier") == "norvane") & day.startswith("2022")).select("id", "loc_state", "carrier")


@query("select count(*) n, min(capture_date) first_at, max(capture_date) last_at from records where source_id ilike 'news%'")
def changes_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "records").where(F.col("source_id").ilike("news%")).agg(F.count(F.lit(1)).alias("n"), F.min("capture_date").alias("first_at"), F.max("capture_date").alias("last_at"))


@query("select id, carrier from records where id > 1000 order by id limit 300")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of 300 records after a cursor."""
    return read(spark, d, "records").where("id > 1000").select("id", "carrier").orderBy("id").limit(300)


@query("""with n as (select loc_state, alleged_issue, count(*) n from records where loc_state is not null and alleged_issue is not null group by 1, 2),
k as (select *, row_number() over (partition by loc_state order by n desc, alleged_issue) k from n)
select loc_state, string_agg(k || '. ' || alleged_issue, ' ' order by k) listing from k where k <= 3 group by 1""")
def numbered_issues(spark: SparkSession, d: str) -> DataFrame:
    """The three commonest issues of a state as a numbered text."""
    n = read(spark, d, "records").where("loc_state is not null and alleged_issue is not null").groupBy("loc_state", "alleged_issue").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("loc_state").orderBy(F.desc("n"), "alleged_issue")
    k = n.withColumn("k", F.row_number().over(w)).where("k <= 3")
    parts = F.array_sort(F.collect_list(F.struct("k", "alleged_issue")))
    return k.groupBy("loc_state").agg(F.array_join(F.transform(parts, lambda x: F.concat(x["k"].cast("string"), F.lit(". "), x["alleged_issue"])), " ").alias("listing"))


@query(f"select carrier, 'at least $' || format('{{:,}}', cast(coalesce(sum(claim_consumer_cents) filter (where claim_consumer_cents <= {money.CAP_CENTS}), 0) as bigint) // 100) || ' over ' || count(*) filter (where claim_consumer_cents <= {money.CAP_CENTS}) || ' cases' sentence from arb_claims group by carrier")
def amount_sentences(spark: SparkSession, d: str) -> DataFrame:
    """What is said of a carrier's capped claims."""
    t = amounts.tally(read(spark, d, "arb_claims").select("carrier", "claim_consumer_cents", "award_consumer_cents"), ["carrier"], "claim_consumer_cents", "award_consumer_cents")
    return t.select("carrier", F.concat(F.lit("at least $"), money.dollars_floor(F.col("capped_cents")), F.lit(" over "), F.col("capped_rows").cast("string"), F.lit(" cases")).alias("sentence"))


_FIRST = lambda c: f"case {' '.join(f'when {_any_sql(c, t)} then {chr(39)}{n}{chr(39)}' for n, t in tx.CARRIERS)} end"
_NAMED = lambda c: "(" + " or ".join(_any_sql(c, t) for _, t in [*tx.CARRIERS, *tx.ISSUES]) + ")"


@query("select max(seendate) as next_cursor from gdelt_articles")
def incremental_cursor(spark: SparkSession, d: str) -> DataFrame:
    return collectors.next_cursor(read(spark, d, "gdelt_articles"), "seendate", None).select(F.col("cursor").alias("next_cursor"))


@query("""select n_name nation, p_brand brand, count(*) n, sum(cast(round(l_extendedprice * 100) as bigint))::bigint cents from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2""")
def joined_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Facts joined with their log and certificate tables: small sides are broadcast by size, the others meet by key."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    p = read(spark, d, "part").select("p_partkey", "p_brand")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("n_name").alias("nation"), F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))


@query("select month_ym, strftime(cast(month_ym || '-01' as date) + interval 1 month, '%Y-%m') next_month, count(*) n from fcc_monthly_aggregates where month_ym is not null group by 1")
def month_walk(spark: SparkSession, d: str) -> DataFrame:
    """Months with the one after each."""
    return read(spark, d, "fcc_monthly_aggregates").where("month_ym is not null").groupBy("month_ym").agg(F.count(F.lit(1)).alias("n")).select("month_ym", dates.add_months_ym(F.col("month_ym"), 1).alias("next_month"), "n")


@query("with k as (select carrier, count(*) n from records where carrier is not null group by 1), d as (select carrier, count(*) n from arb_claims where carrier is not null group by 1) select carrier, cast(sum(n) as bigint) n from (from k union all from d) group by carrier")
def additive_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Counts of one table added to those of another by key."""
    one = lambda t: read(spark, d, t).where("carrier is not null").groupBy("carrier").agg(F.count(F.lit(1)).alias("n"))
    return tables.add_up(one("records"), one("arb_claims"), ["carrier"], ["n"])


_JOBS = "(select o_orderkey id, case o_orderstatus when 'F' then 'done' when 'O' then 'pending' else 'claimed' end status, cast(o_orderkey % 7 as int) attempts, epoch_us(o_orderdate) // 1000000 scheduled_at from orders)"
_NOW = 820_454_400


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("claimed")
    return o.select(F.col("o_orderkey").alias("id"), status.alias("status"), (F.col("o_orderkey") % 7).cast("int").alias("attempts"), dates.wall_epoch(F.col("o_orderdate")).alias("scheduled_at"))


@query(f"with j as (select * from {_JOBS}), c as (select id from j where status = 'pending' and scheduled_at <= {_NOW} order by id limit 50) select id, case when id in (from c) then 'claimed' else status end status, attempts + (id in (from c))::int attempts, scheduled_at from j")
def job_claim(spark: SparkSession, d: str) -> DataFrame:
    """The queue after 50 due jobs were claimed."""
    return queues.claim(_jobs(spark, d), _NOW, 50)


@query(f"""select id, case when status <> 'claimed' then status when id % 2 = 0 then 'done' when attempts >= 5 then 'dead' else 'pending' end status, attempts,
 case when status = 'claimed' and id % 2 = 1 and attempts < 5 then {_NOW} + least(60 * pow(2, greatest(0, attempts - 1)), 3600)::bigint else scheduled_at end scheduled_at from {_JOBS}""")
def job_finish(spark: SparkSession, d: str) -> DataFrame:
    """The queue after every claimed job ended, those with odd ids in an error."""
    j = _jobs(spark, d)
    return queues.finish(j, j.where("status = 'claimed'").select("id", F.when(F.col("id") % 2 == 1, "error").alias("error")), _NOW)


@query(f"select s status, count(j.id) n from (values ('pending'), ('claimed'), ('done'), ('dead')) v(s) left join {_JOBS} j on s = status group by s")
def job_depths(spark: SparkSession, d: str) -> DataFrame:
    return queues.depths(_jobs(spark, d))


@query("select delivery_id, 'https://news.ycombinator.com/item?id=' || object_id link from hn_items")
def item_links(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "hn_items").select("delivery_id", links.item_link(F.col("object_id")).alias("link"))


@query("select label, count(*) n from (select 'post' label, uri k from bsky_items where uri is not null union select 'item', object_id from hn_items where object_id is not null) group by 1")
def distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    """Distinct keys of two tables in one set."""
    b = read(spark, d, "bsky_items").where("uri is not null").select(F.lit("post").alias("label"), F.col("uri").alias("k"))
    h = read(spark, d, "hn_items").where("object_id is not null").select(F.lit("item").alias("label"), F.col("object_id").alias("k"))
    return b.union(h).distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n"))
