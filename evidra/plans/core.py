"""Queries of the evidence engine's own operators over the whole tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra import taxonomy as tx
from evidra.functions import dates, money, text
from evidra.operators import amounts, diffs, linking, schedule, search, tables
from evidra.operators.skew import two_level_last, two_level_running
from evidra.session import table as read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- aggregates ------------------------------------------------------------------------------------------------
@query("select source_id, carrier, strftime(to_timestamp(coalesce(record_date, capture_date)) at time zone 'UTC', '%Y-%m') month_ym, count(*) mentions from records where carrier is not null group by all")
def mentions_monthly(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "records").where(F.col("carrier").isNotNull())
    return r.groupBy("source_id", "carrier", dates.month_of(dates.event_time(F.col("record_date"), F.col("capture_date"))).alias("month_ym")).agg(F.count(F.lit(1)).alias("mentions"))


@query("select state, cast(sum(complaint_count) as bigint) complaints from fcc_monthly_aggregates where state is not null group by state")
def complaints_by_state(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "fcc_monthly_aggregates").where("state is not null").groupBy("state").agg(F.sum("complaint_count").alias("complaints"))


@query("select zip, cast(sum(complaint_count) as bigint) complaints from fcc_monthly_aggregates where zip is not null group by zip order by complaints desc, zip limit 1000")
def complaints_by_zip_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 1,000 zips with the most complaints; ties by zip."""
    return read(spark, d, "fcc_monthly_aggregates").where("zip is not null").groupBy("zip").agg(F.sum("complaint_count").alias("complaints")).orderBy(F.desc("complaints"), "zip").limit(1000)


@query("select min(month_ym) first_month, max(month_ym) last_month, count(*) n from fcc_monthly_aggregates")
def complaint_coverage(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "fcc_monthly_aggregates").agg(F.min("month_ym").alias("first_month"), F.max("month_ym").alias("last_month"), F.count(F.lit(1)).alias("n"))


@query("select state, month_ym, cast(sum(complaint_count) as bigint) complaints from fcc_monthly_aggregates where state is not null group by all")
def state_trend(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "fcc_monthly_aggregates").where("state is not null").groupBy("state", "month_ym").agg(F.sum("complaint_count").alias("complaints"))


@query("""select month_ym, state, zip, cast(sum(complaint_count) as bigint) complaints, cast(grouping(state) as int) by_zip from fcc_monthly_aggregates
group by grouping sets ((month_ym, state), (month_ym, zip)) having case when grouping(state) = 1 then zip else state end is not null""")
def complaints_by_place_sets(spark: SparkSession, d: str) -> DataFrame:
    """Month by state and month by zip in one pass."""
    f = read(spark, d, "fcc_monthly_aggregates").select("month_ym", "state", "zip", "complaint_count")
    g = f.groupingSets([[F.col("month_ym"), F.col("state")], [F.col("month_ym"), F.col("zip")]], "month_ym", "state", "zip").agg(F.sum("complaint_count").alias("complaints"), F.grouping("state").cast("int").alias("by_zip"))
    return g.where(F.when(F.col("by_zip") == 1, F.col("zip")).otherwise(F.col("state")).isNotNull())


@query("select vetting_status, count(*) n, cast(grouping(vetting_status) as int) is_total, sum(case when vetting_status in ('corroborated', 'verified_primary') then 1 else 0 end)::bigint verified from records group by grouping sets ((vetting_status), ())")
def vetting_totals(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "records").select("vetting_status")
    verified = F.sum(F.when(F.col("vetting_status").isin("corroborated", "verified_primary"), 1).otherwise(0)).alias("verified")
    return r.groupingSets([[F.col("vetting_status")], []], "vetting_status").agg(F.count(F.lit(1)).alias("n"), F.grouping("vetting_status").cast("int").alias("is_total"), verified)


@query("""with s as (select coalesce(f.state, r.state) state, cast(coalesce(fc, 0) as bigint) fcc_count, coalesce(rc, 0) record_count
 from (select state, sum(complaint_count) fc from fcc_monthly_aggregates where state is not null group by 1) f
 full join (select loc_state state, count(*) rc from records where loc_state is not null group by 1) r on f.state = r.state)
select state, fcc_count, record_count, floor(cast(fcc_count + 50 * record_count as double) / greatest(1, (select max(fcc_count + 50 * record_count) from s)) * 1000 + 0.5) / 1000 intensity,
 format('{:,}', fcc_count) || ' complaints, ' || record_count || ' report(s)' basis from s order by fcc_count + 50 * record_count desc, state limit 10""")
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    """The ten states with the highest score of complaints and 50 times the records."""
    f = read(spark, d, "fcc_monthly_aggregates").where("state is not null").groupBy("state").agg(F.sum("complaint_count").alias("f"))
    r = read(spark, d, "records").where("loc_state is not null").groupBy(F.col("loc_state").alias("state")).agg(F.count(F.lit(1)).alias("r"))
    s = f.join(r, "state", "full").select("state", F.coalesce("f", F.lit(0)).alias("fcc_count"), F.coalesce("r", F.lit(0)).alias("record_count"))
    score = F.col("fcc_count") + 50 * F.col("record_count")
    best = s.withColumn("score", score).orderBy(F.desc("score"), "state").limit(10)
    top = F.greatest(F.lit(1), F.max("score").over(Window.partitionBy(F.lit(1))))  # over ten rows
    return best.select("state", "fcc_count", "record_count", (F.floor(F.col("score") / top * 1000 + 0.5) / 1000).alias("intensity"), F.concat(F.format_number("fcc_count", 0), F.lit(" complaints, "), F.col("record_count").cast("string"), F.lit(" report(s)")).alias("basis"))


@query("""select loc_state, alleged_issue, n from (select loc_state, alleged_issue, count(*) n, row_number() over (partition by loc_state order by count(*) desc, alleged_issue) k
 from records where loc_state is not null and alleged_issue is not null group by 1, 2) where k <= 10""")
def state_top_issues(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "records").where("loc_state is not null and alleged_issue is not null").groupBy("loc_state", "alleged_issue").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("loc_state").orderBy(F.desc("n"), "alleged_issue")  # a row per issue
    return n.withColumn("k", F.row_number().over(w)).where("k <= 10").drop("k")


@query("""select loc_state, id, record_date from (select loc_state, id, record_date, row_number() over (partition by loc_state order by record_date desc nulls last, id) k from records where loc_state is not null) where k <= 100""")
def state_recent_records(spark: SparkSession, d: str) -> DataFrame:
    """The 100 latest records of each state; Spark's group limit cuts each partition before the shuffle."""
    w = Window.partitionBy("loc_state").orderBy(F.col("record_date").desc_nulls_last(), "id")
    return read(spark, d, "records").where("loc_state is not null").select("loc_state", "id", "record_date").withColumn("k", F.row_number().over(w)).where("k <= 100").drop("k")


@query("""select carrier, count(*) filter (where c = 'arbitration') arbitration, count(*) filter (where c = 'court') court, count(*) filter (where c = 'regulator_press') regulator_press, count(*) total from
 (select carrier, case when contains(lower(coalesce(source_id, '')), 'arb') then 'arbitration' when contains(lower(coalesce(source_id, '')), 'court') then 'court' else 'regulator_press' end c from records where carrier is not null) group by carrier""")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "records").where("carrier is not null").select("carrier", text.source_category(F.col("source_id")).alias("c"))
    return r.groupBy("carrier").agg(*(F.count(F.when(F.col("c") == k, 1)).alias(k) for k in ("arbitration", "court", "regulator_press")), F.count(F.lit(1)).alias("total"))


@query("""select t.pos, t.carrier, coalesce(n, 0) n from (values (0, 'norvane'), (1, 'tellumo'), (2, 'kestrelcom'), (3, 'quillmobile'), (4, null)) t(pos, carrier)
 left join (select case when carrier in ('norvane', 'tellumo', 'kestrelcom', 'quillmobile') then carrier end carrier, count(*) n from records group by 1) c on t.carrier is not distinct from c.carrier""")
def carrier_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Records by carrier in taxonomy order, carriers without records as 0, the rest as null."""
    names = [c for c, _ in tx.CARRIERS]
    dim = spark.createDataFrame([(i, c) for i, c in enumerate([*names, None])], "pos int, name string")
    n = read(spark, d, "records").groupBy(F.when(F.col("carrier").isin(names), F.col("carrier")).alias("carrier")).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(n, F.col("name").eqNullSafe(F.col("carrier")), "left").select("pos", F.col("name").alias("carrier"), F.coalesce("n", F.lit(0)).alias("n"))


@query("select carrier, strftime(to_timestamp(record_date) at time zone 'UTC', '%Y') as filed_year, count(*) n from records where carrier is not null and record_date is not null group by 1, 2")
def yearly_counts(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "records").where("carrier is not null and record_date is not null")
    return r.groupBy("carrier", F.date_format(dates.utc_day(F.col("record_date")), "yyyy").alias("filed_year")).agg(F.count(F.lit(1)).alias("n"))


@query("select carrier, id, record_date from (select carrier, id, record_date, row_number() over (partition by carrier order by record_date is null, record_date desc, id) k from records where carrier is not null) where k <= 3")
def representatives(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("carrier").orderBy(F.col("record_date").desc_nulls_last(), "id")
    return read(spark, d, "records").where("carrier is not null").select("carrier", "id", "record_date").withColumn("k", F.row_number().over(w)).where("k <= 3").drop("k")


@query("select loc_state, carrier, n from (select loc_state, carrier, count(*) n, row_number() over (partition by loc_state order by count(*) desc, min(id)) k from records where loc_state is not null and carrier is not null group by 1, 2) where k = 1")
def dominant_carrier(spark: SparkSession, d: str) -> DataFrame:
    """The carrier with most records of each state; the first seen wins ties."""
    g = read(spark, d, "records").where("loc_state is not null and carrier is not null").groupBy("loc_state", "carrier").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return tables.first_per_key(g.withColumn("less", -F.col("n")), ["loc_state"], ["less", "first"]).select("loc_state", "carrier", "n")


@query("""with c as (select state, cast(sum(complaint_count) as bigint) n from fcc_monthly_aggregates where state is not null group by 1), m as (select greatest(1, max(n)) m from c)
select state, n, case when n <= 0 then -1 when n <= floor(m * 0.2 + 0.5) then 0 when n <= floor(m * 0.4 + 0.5) then 1 when n <= floor(m * 0.6 + 0.5) then 2 when n <= floor(m * 0.8 + 0.5) then 3 else 4 end bin from c, m""")
def choropleth_bins(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "fcc_monthly_aggregates").where("state is not null").groupBy("state").agg(F.sum("complaint_count").alias("n"))
    m = F.greatest(F.lit(1), F.max("n").over(Window.partitionBy(F.lit(1))))  # over a row per state
    c = c.withColumn("m", m)
    b = F.when(F.col("n") <= 0, -1)
    for i in range(4):
        b = b.when(F.col("n") <= F.floor(F.col("m") * F.lit(0.2 * (i + 1) if i != 2 else 0.6) + 0.5), i)
    return c.select("state", "n", b.otherwise(4).alias("bin"))


# ---- amounts ---------------------------------------------------------------------------------------------------
_B = "case when claim_consumer_cents <= 0 then 0 else least(22, length(bin(claim_consumer_cents))) end"
_STATE_SQL = f"""count(*) cases, cast(coalesce(sum(claim_consumer_cents), 0) as bigint) raw_claim_cents, count(claim_consumer_cents) raw_claim_rows, cast(coalesce(sum(award_consumer_cents), 0) as bigint) raw_award_cents, count(award_consumer_cents) raw_award_rows,
 cast(coalesce(sum(claim_consumer_cents) filter (where claim_consumer_cents <= {money.CAP_CENTS}), 0) as bigint) capped_cents, count(*) filter (where claim_consumer_cents <= {money.CAP_CENTS}) capped_rows, count(*) filter (where claim_consumer_cents > {money.CAP_CENTS}) above_cap,
 {", ".join(f"count(*) filter (where claim_consumer_cents <= {money.CAP_CENTS} and {_B} = {i}) {h}" for i, h in enumerate(amounts.HISTOGRAM))}"""


@query(f"select carrier, cast(grouping(carrier) as int) is_total, {_STATE_SQL} from arb_claims group by grouping sets ((carrier), ())")
def robust_amount_states(spark: SparkSession, d: str) -> DataFrame:
    """Additive states per carrier and over all."""
    c = read(spark, d, "arb_claims").select("carrier", "claim_consumer_cents", "award_consumer_cents")
    return amounts.with_total(amounts.tally(c, ["carrier"], "claim_consumer_cents", "award_consumer_cents"), "carrier")


@query(f"""with s as (select carrier, {_STATE_SQL} from arb_claims group by carrier),
h as (select carrier, k, f from s unpivot (f for hb in ({", ".join(amounts.HISTOGRAM)})) cross join lateral (select cast(substr(hb, 3) as int) k)),
c as (select *, sum(f) over (partition by carrier order by k) - f below, sum(f) over (partition by carrier) n from h),
m as (select carrier, min_by(case when k = 0 then 0 else 1 << (k - 1) end + (n / 2.0 - below) / f * (case when k = 0 then 1 else 1 << (k - 1) end), k) med from c where f > 0 and below + f >= n / 2.0 group by carrier)
select s.carrier, capped_cents, capped_rows, above_cap, cast(floor(med + 0.5) as bigint) median_cents from s left join m on s.carrier is not distinct from m.carrier""")
def robust_amount_stats(spark: SparkSession, d: str) -> DataFrame:
    """Capped totals and the histogram's median per carrier."""
    c = read(spark, d, "arb_claims").select("carrier", "claim_consumer_cents", "award_consumer_cents")
    return amounts.tally(c, ["carrier"], "claim_consumer_cents", "award_consumer_cents").select("carrier", "capped_cents", "capped_rows", "above_cap", amounts.median_cents().alias("median_cents"))


@query(f"select carrier, {_STATE_SQL} from arb_claims group by carrier")
def amount_state_merge(spark: SparkSession, d: str) -> DataFrame:
    """States of single sweep days, merged: the same as one sweep over all."""
    c = read(spark, d, "arb_claims").select("carrier", "sweep_day", "claim_consumer_cents", "award_consumer_cents")
    return amounts.merge(amounts.tally(c, ["sweep_day", "carrier"], "claim_consumer_cents", "award_consumer_cents"), ["carrier"])


_BODY = "case when strpos(excerpt, ' | ') > 0 then substr(excerpt, strpos(excerpt, ' | ') + 3) else excerpt end"


def _field_sql(key: str) -> str:
    cell = f"list_filter(string_split({_BODY}, '; '), lambda s: contains(s, '=') and lower(regexp_replace(split_part(s, '=', 1), '^\\s+|\\s+$', '', 'g')) = '{key}')[1]"
    return f"substr({cell}, strpos({cell}, '=') + 1)"


_CELL_SQL = r"^\$?\s*(\d{1,3}(?:,\d{3})*|\d+)(?:\.(\d{1,2}))?$"


def _cents_sql(cell: str) -> str:
    t = f"regexp_replace({cell}, '^\\s+|\\s+$', '', 'g')"
    return f"case when regexp_matches({t}, '{_CELL_SQL}') and length(replace(regexp_extract({t}, '{_CELL_SQL}', 1), ',', '')) <= 14 then cast(replace(regexp_extract({t}, '{_CELL_SQL}', 1), ',', '') || rpad(regexp_extract({t}, '{_CELL_SQL}', 2), 2, '0') as bigint) end"


@query(f"select id, {_cents_sql('claim')} claim_cents, {_cents_sql('award')} award_cents from (select id, {_field_sql('claim amt consumer')} claim, {_field_sql('award amt consumer')} award from records where excerpt is not null)")
def excerpt_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Claim and award of every record's excerpt, null where the excerpt has none or it is no plain amount."""
    r = read(spark, d, "records").where("excerpt is not null")
    return r.select("id", money.parse_dollars(text.excerpt_field(F.col("excerpt"), money.CLAIM_KEYS)).alias("claim_cents"), money.parse_dollars(text.excerpt_field(F.col("excerpt"), money.AWARD_KEYS)).alias("award_cents"))


# ---- links and corroboration -----------------------------------------------------------------------------------
def _linkable(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "records").select("id", "source_id", "carrier", "promo_name", "alleged_issue", F.coalesce("record_date", "capture_date").alias("ts"), "vetting_status", "review_status")


_TS = "select id, coalesce(source_id, '') src, source_id, carrier, promo_name, alleged_issue, coalesce(record_date, capture_date) ts, vetting_status, review_status from records"


_CORROBORATED = f"""with r as ({_TS} where vetting_status = 'single_source'), g as (select id, src, carrier, ts, 'issue' kind, alleged_issue v from r where carrier is not null and coalesce(alleged_issue, '') <> ''
 union all select id, src, carrier, ts, 'promo', promo_name from r where carrier is not null and coalesce(promo_name, '') <> ''),
n as (select *, lag(src) over w p, lag(ts) over w t from g window w as (partition by kind, carrier, v order by ts, id)),
q as (select distinct kind, carrier, v from n where p <> src and ts - t <= 7776000)
select distinct id from g semi join q using (kind, carrier, v)"""


@query(_CORROBORATED)
def corroborated_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of one source only, of groups that two different sources attest within 90 days."""
    return linking.corroborated(_linkable(spark, d), among=F.col("vetting_status") == "single_source")


@query(f"select id, case when changed then 'corroborated' else vetting_status end vetting_status, changed from (select id, vetting_status, coalesce(vetting_status = 'single_source' and id in ({_CORROBORATED}), false) changed from records)")
def vetting_after_upgrade(spark: SparkSession, d: str) -> DataFrame:
    """Every record's vetting after corroborated ones went up, from single_source only."""
    r = read(spark, d, "records").select("id", "vetting_status")
    return tables.guarded_set(r, corroborated_records(spark, d), "id", "vetting_status", "single_source", "corroborated")


_IN_TERMS = "with p as (select distinct lower(promo_name) promo from records where coalesce(promo_name, '') <> '') select promo from p where exists (select 1 from documents where source = 'terms_page' and contains(lower(text), promo))"


@query(f"""with r as (select *, coalesce(carrier is not null and review_status in ('cleared', 'queued'), false) ok from ({_TS})),
a as (select id, ok, 'same_carrier_promo' link_type, 'carrier=' || carrier || '; promo=' || promo_name link_key from r where coalesce(carrier, '') <> '' and coalesce(promo_name, '') <> ''
 union all select id, ok, 'same_claim_type', 'issue=' || alleged_issue from r where coalesce(alleged_issue, '') <> ''
 union all select id, ok, 'same_promo_terms_language', 'promo="' || promo_name || '" appears in a carrier terms diff' from r where lower(promo_name) in ({_IN_TERMS})),
b as (select id, ok, link_type, link_key, count(*) over (partition by link_type, link_key) - 1 partners from a),
w as (select id, ok, 'carrier=' || carrier || '; issue=' || alleged_issue || '; within 90 days' link_key, ts from r where coalesce(carrier, '') <> '' and coalesce(alleged_issue, '') <> '' and ts is not null),
c as (select id, ok, 'same_carrier_issue_window' link_type, link_key, count(*) over (partition by link_key order by ts range between 7776000 preceding and 7776000 following) - 1 partners from w)
select id, link_type, link_key, partners from b where ok and partners > 0 union all select id, link_type, link_key, partners from c where ok and partners > 0""")
def link_membership(spark: SparkSession, d: str) -> DataFrame:
    """Cleared and queued records of a carrier with the values they share with others, and with how many."""
    source = F.coalesce(F.col("carrier").isNotNull() & F.col("review_status").isin("cleared", "queued"), F.lit(False))
    return linking.link_membership(_linkable(spark, d).withColumn("source", source), promo_in_terms(spark, d))


@query("""with ok as (select id from records where review_status = 'cleared')
select distinct least(record_id_a, record_id_b) a, greatest(record_id_a, record_id_b) b, link_type from links where record_id_a <> record_id_b and record_id_a in (from ok) and record_id_b in (from ok)""")
def link_graph(spark: SparkSession, d: str) -> DataFrame:
    """Distinct links both of whose ends are shown: two semi joins."""
    ok = read(spark, d, "records").where("review_status = 'cleared'").select("id")
    links = read(spark, d, "links").where("record_id_a <> record_id_b").select(F.least("record_id_a", "record_id_b").alias("a"), F.greatest("record_id_a", "record_id_b").alias("b"), "link_type").distinct()
    return links.join(ok, F.col("a") == F.col("id"), "left_semi").join(ok, F.col("b") == F.col("id"), "left_semi")


@query(_IN_TERMS)
def promo_in_terms(spark: SparkSession, d: str) -> DataFrame:
    """Promotions that some terms page names."""
    names = read(spark, d, "records").where("promo_name <> ''").select(F.lower("promo_name").alias("promo")).distinct()
    pages = read(spark, d, "documents").where("source = 'terms_page'").select("doc_id", F.lower("text").alias("t"))
    return search.phrases_in(names, "promo", pages, "doc_id", "t")


# ---- table changes ---------------------------------------------------------------------------------------------


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = read(spark, d, "records").select("id", "batch_id", "dedupe_key")
    half = r.agg(F.floor(F.max("batch_id") / 2)).first()[0] or 0
    return r.where(F.col("batch_id") <= half), r.where(F.col("batch_id") > half)


@query("""with h as (select floor(max(batch_id) / 2) h from records), e as (select dedupe_key k from records, h where batch_id <= h and dedupe_key is not null)
select id, batch_id, dedupe_key from (select id, batch_id, dedupe_key, row_number() over (partition by dedupe_key order by id) n from records, h where batch_id > h and dedupe_key is not null) where n = 1 and dedupe_key not in (from e)
union all select id, batch_id, dedupe_key from records, h where batch_id > h and dedupe_key is null""")
def idempotent_insert(spark: SparkSession, d: str) -> DataFrame:
    """What the later batches add to the table of the earlier ones under a unique key; null keys are never equal."""
    old, new = _halves(spark, d)
    return tables.insert_new(old, new, ["dedupe_key"], ["id"])


@query("with gone as (select uri from bsky_items where uri is not null) select id, dedupe_key from records where source_id = 'bluesky' and dedupe_key is not null and dedupe_key not in (from gone)")
def gone_keys(spark: SparkSession, d: str) -> DataFrame:
    """Post records whose key the recheck didn't resolve: an anti join."""
    checked = read(spark, d, "records").where("source_id = 'bluesky' and dedupe_key is not null").select("id", "dedupe_key")
    return checked.join(read(spark, d, "bsky_items").select(F.col("uri").alias("dedupe_key")).distinct(), "dedupe_key", "left_anti").select("id", "dedupe_key")


@query("with gone as (select distinct dedupe_key k from records where source_id = 'bluesky' and dedupe_key is not null and dedupe_key not in (select uri from bsky_items where uri is not null)) select source_id, count(*) n from records where dedupe_key is null or dedupe_key not in (from gone) group by 1")
def hard_delete(spark: SparkSession, d: str) -> DataFrame:
    """Records by source after the gone keys are deleted."""
    return tables.delete_keys(read(spark, d, "records").select("id", "source_id", "dedupe_key"), gone_keys(spark, d), "dedupe_key").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query("with m as (select delivery_id, uri, received_at, row_number() over (partition by uri order by received_at desc, delivery_id desc) k from bsky_items where uri is not null) select r.id, coalesce(m.received_at, r.last_checked_at) last_checked_at from records r left join m on r.dedupe_key = m.uri and k = 1")
def mark_checked(spark: SparkSession, d: str) -> DataFrame:
    """last_checked_at of every record after a sweep: the latest delivery's time where there is one."""
    seen = read(spark, d, "bsky_items").where("uri is not null").groupBy(F.col("uri").alias("dedupe_key")).agg(F.max("received_at").alias("last_checked_at"))
    r = read(spark, d, "records").select("id", "dedupe_key", "last_checked_at")
    return tables.set_column(r, seen, "dedupe_key", "last_checked_at").select("id", "last_checked_at")


@query("select id, coalesce(last_checked_at, 0) checked from records where source_id in ('bluesky', 'hackernews') order by coalesce(last_checked_at, 0), id limit 50")
def recheck_due(spark: SparkSession, d: str) -> DataFrame:
    """The 50 records to recheck next, never checked ones first."""
    return read(spark, d, "records").where(F.col("source_id").isin("bluesky", "hackernews")).select("id", F.coalesce("last_checked_at", F.lit(0)).alias("checked")).orderBy("checked", "id").limit(50)


@query("select month_ym, state, zip, contact_method, complaint_count, id from (select *, row_number() over (partition by month_ym, state, zip, contact_method order by pulled_at desc, id desc) k from fcc_monthly_aggregates) where k = 1")
def latest_pulls(spark: SparkSession, d: str) -> DataFrame:
    """The latest pull of every month, place and method, nulls being equal: what a unique key that treats nulls as different would double."""
    f = read(spark, d, "fcc_monthly_aggregates").withColumn("back", -F.col("pulled_at")).withColumn("turn", -F.col("id"))
    keys = ["month_ym", "state", "zip", "contact_method"]
    return tables.first_per_key(f, keys, ["back", "turn"]).select(*keys, "complaint_count", "id")


# ---- windows and queues on events ------------------------------------------------------------------------------
def _events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", "user_id", "event_type", "value", dates.wall_epoch(F.col("ts")).alias("epoch"))


_EV = "(select event_id, user_id, event_type, value, epoch_us(ts) // 1000000 epoch from events)"


@query(f"select event_id, n, n <= 2 allowed from (select event_id, row_number() over (partition by user_id, epoch // 86400 order by epoch, event_id) n from {_EV})")
def daily_budget(spark: SparkSession, d: str) -> DataFrame:
    """Events by their place in their user's UTC day; two a day are allowed."""
    return tables.within_quota(_events(spark, d), [F.col("user_id"), F.floor(F.col("epoch") / 86_400)], ["epoch", "event_id"], 2).select("event_id", "n", "allowed")


@query(f"select event_id, n, n <= 20 allowed from (select event_id, row_number() over (partition by event_type, epoch // 300 order by epoch, event_id) n from {_EV})")
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """At most 20 events of a type in each five minutes."""
    return tables.within_quota(_events(spark, d), [F.col("event_type"), F.floor(F.col("epoch") / 300)], ["epoch", "event_id"], 20).select("event_id", "n", "allowed")


@query(f"select epoch // 3600 * 3600 hour_start, event_type, count(*) n from {_EV} group by 1, 2")
def hour_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy((F.floor(F.col("epoch") / 3600) * 3600).alias("hour_start"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"select user_id, epoch, event_id, p from_hash, h to_hash from (select user_id, epoch, event_id, sha256(event_type) h, lag(sha256(event_type)) over (partition by user_id order by epoch, event_id) p from {_EV}) where p <> h")
def snapshot_changes(spark: SparkSession, d: str) -> DataFrame:
    """Steps at which a target's digest changed."""
    return tables.changed_steps(_events(spark, d).withColumn("h", F.sha2("event_type", 256)), "user_id", ["epoch", "event_id"], "h")


@query()
def snapshot_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Line differences between a page's documents in the order of capture, where the text changed."""
    pairs = _snapshot_pairs(spark, d)
    return pairs.select("origin_url", "doc_id", diffs.line_diff_column(F.col("old"), F.col("body"), F.lit("before"), F.lit("after")).alias("diff"))


def _snapshot_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(origin_url, doc_id, old, body): windows see ids and digests only; texts are fetched for the steps that changed."""
    docs = read(spark, d, "documents").where("origin_url is not null and text is not null")
    body = docs.select("doc_id", F.regexp_replace("text", r"(?<=[.!?])\s+", "\n").alias("body"))
    steps = docs.select("origin_url", "captured_at", "doc_id", F.sha2(F.regexp_replace("text", r"(?<=[.!?])\s+", "\n"), 256).alias("h"))
    steps = steps.withColumn("month", F.year("captured_at") * 12 + F.month("captured_at")).withColumn("self", F.struct("doc_id", "h"))
    changed = two_level_last(steps, "origin_url", "month", ["captured_at", "doc_id"], "self", "before", include_own=False).where(F.col("before.h") != F.col("h")).select("origin_url", "doc_id", F.col("before.doc_id").alias("old_id"))
    old = body.select(F.col("doc_id").alias("old_id"), F.col("body").alias("old"))
    return changed.join(body, "doc_id").join(old, "old_id").select("origin_url", "doc_id", "old", "body")


@query("""with s as (select doc_id, regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g') body, origin_url, captured_at from documents where origin_url is not null and text is not null),
l as (select *, lag(body) over (partition by origin_url order by captured_at, doc_id) old from s)
select count(*) changed, 0 wrong from l where old <> body""")
def snapshot_diffs_check(spark: SparkSession, d: str) -> DataFrame:
    """Changed steps, and those whose difference does not give back both texts."""
    pairs = _snapshot_pairs(spark, d)

    @F.pandas_udf("boolean")
    def wrong(old: pd.Series, new: pd.Series) -> pd.Series:
        made = [diffs.line_diff(o, n) for o, n in zip(old, new)]
        return pd.Series([diffs.COARSE not in x and diffs.apply_diff(x) != (o.split("\n") if o else [], n.split("\n") if n else []) for x, o, n in zip(made, old, new)])

    return pairs.agg(F.count(F.lit(1)).alias("changed"), F.count(F.when(wrong("old", "body"), 1)).cast("int").alias("wrong"))


@query(f"select user_id, event_id, k from (select user_id, event_id, row_number() over (partition by user_id order by epoch desc, event_id desc) k from {_EV}) where k <= 3")
def top3_recent_per_user(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("epoch"), F.desc("event_id"))
    return _events(spark, d).select("user_id", "event_id", "epoch").withColumn("k", F.row_number().over(w)).where("k <= 3").drop("epoch")


@query(f"""with n as (select *, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by epoch, event_id) s from {_EV})
select user_id, epoch, event_id, s::bigint as session, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id, s order by epoch, event_id rows between unbounded preceding and current row) last_price from n""")
def session_events(spark: SparkSession, d: str) -> DataFrame:
    """Events numbered by session, a signup opening one, with the session's last price so far."""
    e = _events(spark, d).withColumn("price", F.when(F.col("event_type") == "purchase", F.col("value")))
    return tables.sessions(e, "user_id", ["epoch", "event_id"], F.col("event_type") == "signup", ["price"])


_SLOTS = ", ".join(f"({i}, '{k}', {o}, {w})" for i, (k, o, w) in enumerate(schedule.TEMPLATE))


@query(f"select event_id, i slot_index, k slot_type, epoch % 3600 - o seconds_into_slot, (['a', 'b', 'c'])[(i + epoch // 86400) % 3 + 1] variant from {_EV} join (values {_SLOTS}) t(i, k, o, w) on epoch % 3600 >= o and epoch % 3600 < o + w")
def slot_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The clock slot and the variant at every event."""
    e = schedule.with_slot(_events(spark, d), "epoch")
    return e.select("event_id", "slot_index", "slot_type", "seconds_into_slot", schedule.variant(["b", "a", "c"], F.col("slot_index"), F.col("epoch")).alias("variant"))


@query(f"""select event_id, i slot_index, k slot_type, h + o slot_start, w duration_s from {_EV}, unnest(range(epoch // 3600 * 3600, epoch + 901, 3600)) u(h), (values {_SLOTS}) t(i, k, o, w) where event_type = 'signup' and h + o + w > epoch and h + o < epoch + 900""")
def slots_ahead(spark: SparkSession, d: str) -> DataFrame:
    """The slots of the quarter hour from every signup on."""
    return schedule.slot_starts(_events(spark, d).where("event_type = 'signup'").select("event_id", "epoch"), "epoch").drop("epoch")


@query()
def rotation_plan(spark: SparkSession, d: str) -> DataFrame:
    """Tracks of the music slots that events of a type fall into, a type being a channel."""
    e = schedule.with_slot(_events(spark, d), "epoch").where("slot_type = 'music'").select("event_type", (F.col("epoch") - F.col("seconds_into_slot")).alias("slot_start")).distinct()
    return schedule.rotation(e, "event_type", [(f"t{i:02d}", i % 3 == 0) for i in range(40)])


@query("select 'slots' as check, count(distinct (event_type, epoch // 3600 * 3600 + o)) n from " + _EV + f" join (values {_SLOTS}) t(i, k, o, w) on epoch % 3600 >= o and epoch % 3600 < o + w where k = 'music' union all select 'rested_too_little', 0")
def rotation_check(spark: SparkSession, d: str) -> DataFrame:
    """Music slots that got a track, and tracks that came again before they had rested (there are enough tracks for none)."""
    plan = rotation_plan(spark, d)
    gap = F.col("slot_start") - F.lag("slot_start").over(Window.partitionBy("event_type", "track_id").orderBy("slot_start"))
    early = plan.withColumn("gap", gap).where(F.col("gap") < schedule.REST_SECONDS)
    n = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
    return n("slots", plan).union(n("rested_too_little", early))


@query(f"select user_id, event_id, least(60 * pow(2, greatest(0, n - 1)), 3600)::bigint wait_s from (select user_id, event_id, row_number() over (partition by user_id order by epoch, event_id) n from {_EV} where event_type = 'error')")
def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    """Seconds to wait after each of a user's errors in turn."""
    e = _events(spark, d).where("event_type = 'error'").withColumn("week", F.floor(F.col("epoch") / 604_800)).withColumn("one", F.lit(1))
    e = two_level_running(e, "user_id", "week", ["epoch", "event_id"], "one", "before")
    return e.select("user_id", "event_id", dates.backoff_seconds(F.col("before") + 1).alias("wait_s"))


# ---- texts -----------------------------------------------------------------------------------------------------
def _term_sql(col: str, term: str) -> str:
    return f"regexp_matches(lower({col}), '(?:^|[^a-z0-9]){term}(?:[^a-z0-9]|$)')"


def _any_sql(col: str, terms: list[str]) -> str:
    return "(" + " or ".join(_term_sql(col, t) for t in terms) + ")"


def _all_sql(col: str, lists: list[tuple[str, list[str]]]) -> str:
    return "list_filter([" + ", ".join(f"case when {_any_sql(col, t)} then '{n}' end" for n, t in lists) + "], lambda x: x is not null)"


@query(f"select id, case {' '.join(f'when {_any_sql("excerpt", t)} then {chr(39)}{n}{chr(39)}' for n, t in tx.CARRIERS)} end carrier_found, {_all_sql('excerpt', tx.ISSUES)}[1] issue from records where excerpt is not null")
def carrier_tag(spark: SparkSession, d: str) -> DataFrame:
    """First carrier and first issue that an excerpt names."""
    r = read(spark, d, "records").where("excerpt is not null")
    return r.select("id", text.first_match(F.col("excerpt"), tx.CARRIERS).alias("carrier_found"), text.first_match(F.col("excerpt"), tx.ISSUES).alias("issue"))


@query(f"""with m as (select id, list_distinct({_all_sql('excerpt', tx.CARRIERS)} || {_all_sql('excerpt', tx.PROMOTIONS)}) c, {_all_sql('excerpt', tx.ISSUES)}[1] issue from records where excerpt is not null)
select id, case when len(c) = 1 then c[1] end carrier, issue, case when len(c) = 1 then 0.95 end::double confidence, len(c) > 1 ambiguous from m""")
def rule_classification(spark: SparkSession, d: str) -> DataFrame:
    """Records whose excerpt implies exactly one carrier, by name or by a promotion's owner; others stay open."""
    r = read(spark, d, "records").where("excerpt is not null")
    found = F.array_union(text.all_matches(F.col("excerpt"), tx.CARRIERS), text.all_matches(F.col("excerpt"), tx.PROMOTIONS))
    r = r.select("id", found.alias("c"), text.first_match(F.col("excerpt"), tx.ISSUES).alias("issue"))
    one = F.size("c") == 1
    return r.select("id", F.when(one, F.get("c", F.lit(0))).alias("carrier"), "issue", F.when(one, F.lit(0.95)).alias("confidence"), (F.size("c") > 1).alias("ambiguous"))


_Q = ", ".join(f"({i}, '{q}')" for i, q in tx.QUESTIONS)
_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_TOKENS = f"list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda t: length(t) >= 2 and not list_contains([{_STOP}], t))"


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(tx.QUESTIONS, "qid int, question string")


@query(f"""select qid, case when regexp_matches(lower(question), '\\b(how many|number of|how much|count)\\b') then 'count' when regexp_matches(lower(question), '\\b(improved?|improving|better|worse|worsened|trend|over time|changed over|gotten worse|getting better)\\b') then 'trend' else 'topic' end intent,
 case {' '.join(f'when {_any_sql("question", t)} then {chr(39)}{n}{chr(39)}' for n, t in tx.CARRIERS)} end carrier, array_to_string(list_sort(list_distinct({_TOKENS})), ' OR ') match_query from (values {_Q}) v(qid, question)""")
def question_routing(spark: SparkSession, d: str) -> DataFrame:
    """Intent, carrier and search words of questions."""
    q = _questions(spark)
    return q.select("qid", text.question_intent(F.col("question")).alias("intent"), text.first_match(F.col("question"), tx.CARRIERS).alias("carrier"), F.array_join(F.array_sort(text.question_tokens(F.col("question"))), " OR ").alias("match_query"))


_INDEX = rf"""q as (select distinct qid, unnest({_TOKENS}) term from (values {_Q}) v(qid, question)),
t as (select id, regexp_extract_all(translate(lower(coalesce(excerpt, '')), '{text.ACCENTED}', '{text.PLAIN}'), '[\p{{L}}\p{{N}}]+') w from records),
s as (select count(*)::double n, avg(len(w)) a from t), p as (select id, term, count(*) tf from (select id, unnest(w) term from t) where term in (select term from q) group by all),
f as (select term, count(*) df from p group by 1)"""


@query(f"""with {_INDEX},
r as (select qid, p.id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / a))), 6) score from q join p using (term) join f using (term) join t on t.id = p.id cross join s group by qid, p.id)
select qid, id, score, place from (select *, row_number() over (partition by qid order by score desc, id) place from r) where place <= 5""")
def topic_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five best records for each question by BM25 over all excerpts."""
    return search.top_documents(read(spark, d, "records").select("id", "excerpt"), "id", "excerpt", _questions(spark))


@query(f"""with {_INDEX}, ok as (select id from records where review_status = 'cleared' and vetting_status in ('corroborated', 'verified_primary')),
r as (select qid, p.id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / a))), 6) score from q join p using (term) join f using (term) join t on t.id = p.id cross join s where p.id in (from ok) group by qid, p.id)
select qid, id, score, place from (select *, row_number() over (partition by qid order by score desc, id) place from r) where place <= 5""")
def topic_shown_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five best for each question among the records that may be shown; statistics stay those of all."""
    r = read(spark, d, "records")
    shown = r.where((F.col("review_status") == "cleared") & F.col("vetting_status").isin("corroborated", "verified_primary")).select("id")
    return search.top_documents(r.select("id", "excerpt"), "id", "excerpt", _questions(spark), eligible=shown)


@query(f"""with {_INDEX}, m as (select qid, count(distinct id) matching from q join p using (term) group by 1) select qid, coalesce(matching, 0) matching, case when matching > 0 then 'answered' else 'no results' end outcome from (values {_Q}) v(qid, question) left join m using (qid)""")
def cite_or_refuse(spark: SparkSession, d: str) -> DataFrame:
    """Questions with the number of records that hold one of their words; without any there is nothing to cite, so no answer."""
    q = _questions(spark).select("qid", F.explode(text.question_tokens(F.col("question"))).alias("term"))
    post = search.postings(search.build_index(read(spark, d, "records").select("id", "excerpt"), "id", "excerpt"), q)
    m = q.join(post, "term").select("qid", "id").distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return _questions(spark).join(m, "qid", "left").select("qid", n.alias("matching"), F.when(n > 0, "answered").otherwise("no results").alias("outcome"))


_DECODE = "replace(replace(replace(replace(replace(replace(regexp_replace({c}, '<!\\[CDATA\\[(.*?)\\]\\]>', '\\1', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&')"
_SQUEEZE = "regexp_replace(regexp_replace({c}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"select delivery_id, {_SQUEEZE.format(c=f'regexp_replace({_DECODE.format(c='text')}, {chr(39)}<[^>]+>{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')} plain from hn_items where text is not null")
def plain_texts(spark: SparkSession, d: str) -> DataFrame:
    """Item texts without entities and tags."""
    return read(spark, d, "hn_items").where("text is not null").select("delivery_id", text.strip_tags(F.col("text")).alias("plain"))


@query()
def page_text(spark: SparkSession, d: str) -> DataFrame:
    """Lines of pages made of the documents, for comparison: no scripts, tags, blank or repeated lines."""
    html = F.concat(F.lit("<html><style>p{}</style><p>"), F.regexp_replace("text", r"\r?\n", "</p><p>"), F.lit("</p><script>x()</script><!-- c --></html>"))
    return read(spark, d, "documents").where("text is not null").select("doc_id", text.page_lines(html).alias("lines"))


@query(r"""with t as (select doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '<[^>]+>', chr(10), 'g'), '\r?\n', chr(10), 'g'), chr(10)), lambda x: regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda x: length(x) > 0) l from documents where text is not null)
select doc_id, length(array_to_string(list_filter(l, lambda x, i: i = 1 or x <> l[i - 1]), ' ')) n from t where not regexp_matches(array_to_string(l, ' '), '[&?]')""")
def page_text_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of the pages' texts, of documents without entities and addresses with parameters."""
    p = page_text(spark, d)
    plain = ~F.regexp_replace(text.squeeze(F.regexp_replace("text", "<[^>]+>", " ")), r"\s", " ").rlike("[&?]")
    ok = read(spark, d, "documents").where(F.col("text").isNotNull() & plain).select("doc_id")
    return p.join(ok, "doc_id", "left_semi").select("doc_id", F.length("lines").cast("bigint").alias("n"))


@query(r"select doc_id, len(p) pieces, array_to_string(p, '') = text lossless, p[1] opening from (select doc_id, text, regexp_extract_all(text, '(?s).*?[.!?]+(?:\s+|\z)|.+\z') p from documents where text is not null and text <> '')")
def lossless_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Texts in pieces to be spoken, which joined are the text again."""
    docs = read(spark, d, "documents").where("text <> ''").select("doc_id", "text", text.sentences_lossless(F.col("text")).alias("p"))
    return docs.select("doc_id", F.size("p").cast("bigint").alias("pieces"), (F.array_join("p", "") == F.col("text")).alias("lossless"), F.get("p", F.lit(0)).alias("opening"))


@query(r"select id, array_to_string(list_filter(regexp_extract_all(excerpt, '\d[\d,\.]*\d|\d'), lambda n: not contains(coalesce(dedupe_key, '') || ' ' || coalesce(source_url, ''), n)), ' ') unsupported from records where excerpt is not null")
def unsupported_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of an excerpt that neither its key nor its address holds."""
    r = read(spark, d, "records").where("excerpt is not null")
    source = F.concat(F.coalesce("dedupe_key", F.lit("")), F.lit(" "), F.coalesce("source_url", F.lit("")))
    return r.select("id", F.array_join(text.foreign_numbers(F.col("excerpt"), source), " ").alias("unsupported"))


@query(r"""select doc_id, text is not null and regexp_matches(text, '\S') not_empty, not regexp_matches(coalesce(text, ''), '[—―‒]') dash_free, length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) < 320 short, len(regexp_extract_all(coalesce(text, ''), '[.!?]+')) <= 2 few_sentences from documents""")
def summary_checks(spark: SparkSession, d: str) -> DataFrame:
    """Mechanical checks of a summary, one column each."""
    t = F.coalesce("text", F.lit(""))
    return read(spark, d, "documents").select("doc_id", (F.col("text").isNotNull() & t.rlike(r"\S")).alias("not_empty"), (~t.rlike("[—―‒]")).alias("dash_free"), (F.length(text.trim_all(t)) < 320).alias("short"), (F.size(F.regexp_extract_all(t, F.lit("[.!?]+"), F.lit(0))) <= 2).alias("few_sentences"))


@query("select doc_id, substr(translate(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '—―‒', '   '), 1, 20000) draft from documents where text is not null")
def draft_clean(spark: SparkSession, d: str) -> DataFrame:
    """Drafts without dashes, cut at 20,000 characters."""
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.substring(F.translate(text.trim_all(F.col("text")), "—―‒", "   "), 1, 20_000).alias("draft"))


@query(r"select delivery_id, case when regexp_matches(uri, '^at://([^/]+)/app\.bsky\.feed\.post/([^/]+)$') then regexp_replace(uri, '^at://([^/]+)/app\.bsky\.feed\.post/([^/]+)$', 'https://bsky.app/profile/\1/post/\2') end permalink from bsky_items")
def post_permalinks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "bsky_items").select("delivery_id", text.post_permalink(F.col("uri")).alias("permalink"))


@query("""select loc_state, to_json({'state': loc_state, 'records': count(*), 'carriers': count(distinct carrier)}) doc from records where loc_state is not null group by loc_state""")
def state_documents(spark: SparkSession, d: str) -> DataFrame:
    """A published JSON document per state."""
    g = read(spark, d, "records").where("loc_state is not null").groupBy("loc_state").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("carrier").alias("carriers"))
    return g.select("loc_state", F.to_json(F.struct(F.col("loc_state").alias("state"), "records", "carriers")).alias("doc"))


@query("""select id, to_json({'id': id, 'carrier': carrier, 'location': {'city': loc_city, 'state': loc_state, 'zip': loc_zip}, 'url': case when source_id = 'bluesky' and source_url like 'at://%' and regexp_matches(source_url, '^at://([^/]+)/app\\.bsky\\.feed\\.post/([^/]+)$') then regexp_replace(source_url, '^at://([^/]+)/app\\.bsky\\.feed\\.post/([^/]+)$', 'https://bsky.app/profile/\\1/post/\\2') else source_url end}) citation from records""")
def citation_blocks(spark: SparkSession, d: str) -> DataFrame:
    """What is cited of a record: never the excerpt."""
    url = F.when((F.col("source_id") == "bluesky") & F.col("source_url").startswith("at://"), F.coalesce(text.post_permalink(F.col("source_url")), "source_url")).otherwise(F.col("source_url"))
    block = F.struct("id", "carrier", F.struct(F.col("loc_city").alias("city"), F.col("loc_state").alias("state"), F.col("loc_zip").alias("zip")).alias("location"), url.alias("url"))
    return read(spark, d, "records").select("id", F.to_json(block, {"ignoreNullFields": "false"}).alias("citation"))
