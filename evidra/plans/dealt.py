"""Queries of the general problems: heavy keys (p1), time texts (p2), repeated deliveries (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import dates
from evidra.operators import delivery, instants
from evidra.operators.treeagg import heavy_keys, tree_aggregate
from evidra.session import materialize, new_path, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that hold at least 5 % of the rows whose key is not null."""
    rec, fcc = table(spark, sf_dir, "records"), table(spark, sf_dir, "fcc_monthly_aggregates")
    counts = [tree_aggregate(df, {"key": F.col(k)}, {"n": (F.lit(1), "sum")}).select(F.lit(k if k == "carrier" else "state").alias("field"), "key", "n") for df, k in ((rec, "carrier"), (fcc, "state"))]
    per_key, _ = materialize(counts[0].union(counts[1]), "key-counts")
    return heavy_keys(per_key, "field", "key", "n", 5)


def p1_carrier_monthly_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CarrierMonthlyMention: rows per source, carrier and month of record_date, else capture_date."""
    rec = table(spark, sf_dir, "records").where(F.col("carrier").isNotNull())
    month = dates.month_of(F.coalesce("record_date", "capture_date"))
    return tree_aggregate(rec, {"source_id": F.col("source_id"), "carrier": F.col("carrier"), "month_ym": month}, {"mentions": (F.lit(1), "sum")})


def p1_state_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """StateSignal: complaints summed and records counted by state; a state missing on one side has 0 there."""
    fcc = tree_aggregate(table(spark, sf_dir, "fcc_monthly_aggregates").where(F.col("state").isNotNull()), {"state": F.col("state")}, {"fcc_count": (F.col("complaint_count"), "sum")})
    rec = tree_aggregate(table(spark, sf_dir, "records").where(F.col("loc_state").isNotNull()), {"state": F.col("loc_state")}, {"record_count": (F.lit(1), "sum")})
    return fcc.join(rec, "state", "full").select("state", F.coalesce("fcc_count", F.lit(0)).alias("fcc_count"), F.coalesce("record_count", F.lit(0)).alias("record_count"))


_TIMED = (("gdelt_articles", "article_id", "seendate"), ("bsky_items", "delivery_id", "created_at"), ("hn_items", "delivery_id", "created_at"), ("docket_items", "docket_id", "date_filed"))


def timed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_table, item_id, raw, zone, date_order) of the four item tables; items without a feed have neither zone nor order."""
    feeds = table(spark, sf_dir, "feeds").select(F.col("feed_id").alias("f"), F.col("zone_name").alias("zone"), "date_order").dropDuplicates(["f"])
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("item_table"), F.col(i).alias("item_id"), F.col("feed_id"), F.col(c).alias("raw")) for t, i, c in _TIMED]
    rows = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    # Feeds are 18 rows, fixed: Spark broadcasts them by their measured size.
    return rows.join(feeds, F.col("feed_id") == F.col("f"), "left").select("item_table", "item_id", "raw", "zone", "date_order")


def p2_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the four tables with its UTC second or null."""
    return instants.normalise(timed_texts(spark, sf_dir), ["item_table", "item_id"])


def p2_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose instant is another when the four tables come one after the other, each adding to one kept dictionary only the texts
    it does not know yet; and texts that stand in the dictionary twice. None of either."""
    rows, d = timed_texts(spark, sf_dir), instants.InstantDictionary(spark)
    step = None
    for name in ("gdelt_articles", "bsky_items", "hn_items", "docket_items"):
        part = instants.normalise(rows.where(F.col("item_table") == name), ["item_table", "item_id"], d)
        step = part if step is None else step.union(part)
    once = p2_instants(spark, sf_dir).select(F.col("item_table").alias("t"), F.col("item_id").alias("i"), F.col("utc_second").alias("u"))
    both = step.join(once, (F.col("item_table") == F.col("t")) & (F.col("item_id") == F.col("i")), "full")
    wrong = both.where(~F.coalesce(F.col("utc_second").eqNullSafe(F.col("u")) & F.col("t").isNotNull() & F.col("item_table").isNotNull(), F.lit(False)))
    twice = d.read().groupBy("raw", "zone", "date_order").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    n = lambda name, df: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
    return n("other_instant", wrong).union(n("text_twice", twice))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose time text denotes exactly one instant."""
    return p2_instants(spark, sf_dir).where(F.col("utc_second").isNotNull())


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = 86_400
    rec = delivery.delivery_rows(table(spark, sf_dir, "records"), "records", "id", "dedupe_key", "created_at", 180 * day)
    bsky = delivery.delivery_rows(table(spark, sf_dir, "bsky_items"), "bsky_items", "delivery_id", "uri", "received_at", 7 * day)
    hn = delivery.delivery_rows(table(spark, sf_dir, "hn_items"), "hn_items", "delivery_id", "object_id", "received_at", 7 * day)
    return rec.union(bsky).union(hn)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to be dropped, as a row with a smaller id has the same identifier."""
    return delivery.repeats(_deliveries(spark, sf_dir)).select(F.col("tbl").alias("item_table"), F.col("id").alias("item_id"))


def p3_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one row kept for each identifier."""
    return delivery.keepers(_deliveries(spark, sf_dir)).select(F.col("tbl").alias("item_table"), F.col("id").alias("item_id"))


def p3_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows a store keeps of posts and items that arrive in four batches, by the ranges of their batch_id."""
    day, names = 86_400, {"bsky_items": "uri", "hn_items": "object_id"}
    store = delivery.DeliveryStore(spark, new_path(spark, "delivery-store"), words=1 << 14)
    rows = None
    for name, key in names.items():
        t = table(spark, sf_dir, name)
        d = delivery.delivery_rows(t, name, "delivery_id", key, "received_at", 7 * day)
        d = d.join(t.select(F.col("delivery_id").alias("id"), "batch_id"), "id").select("tbl", "id", "ident", "tb", "batch_id")
        rows = d if rows is None else rows.union(d)
    last = rows.agg(F.max("batch_id")).first()[0] or 0
    kept = [store.ingest(rows.where(F.floor(F.coalesce("batch_id", F.lit(0)) * 4 / (last + 1)) == i).drop("batch_id"), f"b{i}").withColumn("batch", F.lit(i)) for i in range(4)]
    out = kept[0]
    for k in kept[1:]:
        out = out.union(k)
    return out.select(F.col("tbl").alias("item_table"), F.col("id").alias("item_id"), "batch")


QUERIES = {q.__name__: q for q in (p1_found, p1_carrier_monthly_mentions, p1_state_signal, p2_found, p2_instants, p2_check, p3_found, p3_kept, p3_batches)}

_NORMAL = r"""case when strpos(t, ':') > 0 then lower(substr(t, 1, strpos(t, ':'))) || substr(t, strpos(t, ':') + 1) else t end"""
_DELIVERED = rf"""
with raw as (
  select 'records' item_table, id item_id, regexp_replace(dedupe_key, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') t from records
  union all select 'bsky_items', delivery_id, regexp_replace(uri, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') from bsky_items
  union all select 'hn_items', delivery_id, regexp_replace(object_id, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') from hn_items
), r as (
  select item_table, item_id, row_number() over (partition by item_table, {_NORMAL} order by item_id) rn from raw where t is not null
)"""

SQL = {
    "p2_check": "select c as check, 0 violations from (values ('other_instant'), ('text_twice')) t(c)",
    "p1_found": """
with c as (
  select 'carrier' key_field, carrier key_value, count(*) n from records where carrier is not null group by carrier
  union all select 'state', state, count(*) from fcc_monthly_aggregates where state is not null group by state
)
select key_field, key_value from (select *, sum(n) over (partition by key_field) t from c) where n * 100 >= t * 5""",
    "p1_carrier_monthly_mentions": """
select source_id, carrier, strftime(to_timestamp(coalesce(record_date, capture_date)) at time zone 'UTC', '%Y-%m') month_ym, count(*) mentions
from records where carrier is not null group by 1, 2, 3""",
    "p1_state_signal": """
select coalesce(f.state, r.state) state, cast(coalesce(fcc_count, 0) as bigint) fcc_count, coalesce(record_count, 0) record_count
from (select state, sum(complaint_count) fcc_count from fcc_monthly_aggregates where state is not null group by state) f
full join (select loc_state state, count(*) record_count from records where loc_state is not null group by 1) r on f.state = r.state""",
    "p3_found": _DELIVERED + " select item_table, item_id from r where rn > 1",
    "p3_kept": _DELIVERED + " select item_table, item_id from r where rn = 1",
    "p3_batches": rf"""
with raw as (
  select 'bsky_items' item_table, delivery_id item_id, batch_id, regexp_replace(uri, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') t from bsky_items
  union all select 'hn_items', delivery_id, batch_id, regexp_replace(object_id, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') from hn_items
), b as (select *, cast(floor(coalesce(batch_id, 0) * 4 / ((select max(batch_id) from raw) + 1)) as int) batch from raw)
select item_table, item_id, batch from (select *, row_number() over (partition by item_table, {_NORMAL} order by batch, item_id) rn from b where t is not null) where rn = 1""",
}
