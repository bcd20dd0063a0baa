"""Queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import components, mixing, packing, quantiles, sentences, tokens, truncation
from evidra.session import materialize, table

CAP_CENTS = 2_500_000
#: Sources that p7_conflict_check keeps apart.
APART = (("show_script", "court_filing"), ("ask_answer", "terms_page"))
PERCENTS = [10, 25, 50, 75, 90, 99]
FINE = [0.1, 12.5, 50.0, 99.9, 99.99]


# ---- p4: percentiles -------------------------------------------------------------------------------------------
def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arb_claims amounts once per carrier and once for all, as they stand and up to the cap."""
    a = table(spark, sf_dir, "arb_claims").select("sweep_day", "carrier", F.col("claim_consumer_cents").alias("cents")).where(F.col("cents").isNotNull())
    one = lambda scope, carrier, measure: F.struct(F.lit(scope).alias("scope"), carrier.alias("carrier"), F.lit(measure).alias("measure"))
    none = F.lit(None).cast("string")
    every = F.array(one("carrier", F.col("carrier"), "raw"), one("all", none, "raw"))
    capped = F.array(one("carrier", F.col("carrier"), "capped"), one("all", none, "capped"))
    return a.select("sweep_day", "cents", F.explode(F.when(F.col("cents") <= CAP_CENTS, F.concat(every, capped)).otherwise(every)).alias("k")).select("sweep_day", "cents", "k.scope", "k.carrier", "k.measure")


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles (error bound 0) of claim_consumer_cents by carrier and over all; measure `capped` takes the amounts up to the cap.

    Carriers without amounts of a measure have no rows here; p4_all_percentiles gives them.
    """
    p = quantiles.exact_percentiles(_amounts(spark, sf_dir), ["scope", "carrier", "measure"], "cents", PERCENTS)
    return p.withColumn("error_bound", F.lit(0).cast("bigint"))


def p4_claim_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ClaimCarrierRow: capped total, rows and median of the amounts up to the cap, by carrier and over all.

    Carriers without such amounts have no row here; p4_all_claim_stats gives them.
    """
    capped = _amounts(spark, sf_dir).where(F.col("measure") == "capped")
    median = quantiles.exact_percentiles(capped, ["scope", "carrier"], "cents", [50]).select(F.col("scope").alias("s"), F.col("carrier").alias("c"), F.col("value").alias("claim_median_cents_approx"))
    sums = capped.groupBy("scope", "carrier").agg(F.count(F.lit(1)).alias("claim_capped_rows"), F.sum("cents").alias("claim_capped_total_cents"))
    return sums.join(median, (F.col("scope") == F.col("s")) & F.col("carrier").eqNullSafe(F.col("c"))).drop("s", "c")


def _carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, carrier) of every carrier of arb_claims, with amounts or without, and of the total."""
    one = lambda scope, carrier: F.struct(F.lit(scope).alias("scope"), carrier.alias("carrier"))
    both = F.array(one("carrier", F.col("carrier")), one("all", F.lit(None).cast("string")))
    return table(spark, sf_dir, "arb_claims").select(F.explode(both).alias("k")).select("k.scope", "k.carrier").distinct()


def p4_all_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_percentiles with every carrier of arb_claims: where a measure has no amounts, its percentiles are null and n is 0."""
    found = p4_percentiles(spark, sf_dir).select(F.col("scope").alias("s"), F.col("carrier").alias("c"), F.col("measure").alias("m"), F.col("percentile").alias("p"), "value", "n")
    wanted = F.array(*(F.struct(F.lit(m).alias("measure"), F.lit(p).alias("percentile")) for m in ("raw", "capped") for p in PERCENTS))
    keys = _carriers(spark, sf_dir).select("scope", "carrier", F.explode(wanted).alias("w")).select("scope", "carrier", "w.measure", "w.percentile")
    same = (F.col("scope") == F.col("s")) & F.col("carrier").eqNullSafe(F.col("c")) & (F.col("measure") == F.col("m")) & (F.col("percentile") == F.col("p"))
    return keys.join(found, same, "left").select("scope", "carrier", "measure", "percentile", "value", F.coalesce("n", F.lit(0)).alias("n"), F.lit(0).cast("bigint").alias("error_bound"))


def p4_all_claim_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_claim_stats with every carrier of arb_claims: without amounts up to the cap, rows and total are 0 and the median is null."""
    found = p4_claim_stats(spark, sf_dir).withColumnsRenamed({"scope": "s", "carrier": "c"})
    both = _carriers(spark, sf_dir).join(found, (F.col("scope") == F.col("s")) & F.col("carrier").eqNullSafe(F.col("c")), "left")
    rows, total = (F.coalesce(c, F.lit(0)).alias(c) for c in ("claim_capped_rows", "claim_capped_total_cents"))
    return both.select("scope", "carrier", rows, total, "claim_median_cents_approx")


def p4_day_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every sweep day adds to the statistics of any span."""
    return quantiles.day_states(_amounts(spark, sf_dir), "sweep_day", ["scope", "carrier", "measure"], "cents")


def p4_year_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of calendar years, combined from the states of their sweep days; the exact value lies within [value_low, value_high]."""
    s = p4_day_states(spark, sf_dir).withColumn("year", F.year("sweep_day"))
    keys = ["year", "scope", "carrier", "measure"]
    return quantiles.state_percentiles(quantiles.combine(s, keys), keys, PERCENTS)


def p4_fine_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractional percentiles of the claims of every carrier."""
    a = table(spark, sf_dir, "arb_claims").select("carrier", "claim_consumer_cents")
    return quantiles.exact_percentiles(a, ["carrier"], "claim_consumer_cents", FINE)


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "arb_claims").select("sweep_day", "carrier", (F.col("award_consumer_cents") - F.col("claim_consumer_cents")).alias("cents"))


def p4_signed_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of award less claim, mostly negative, of carriers and years, from the states of sweep days."""
    s = quantiles.day_states(_signed(spark, sf_dir), "sweep_day", ["carrier"], "cents").withColumn("year", F.year("sweep_day"))
    return quantiles.state_percentiles(quantiles.combine(s, ["year", "carrier"]), ["year", "carrier"], PERCENTS)


def p4_signed_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed percentiles whose exact value lies outside the bounds of the combined states: none."""
    exact = quantiles.exact_percentiles(_signed(spark, sf_dir).withColumn("year", F.year("sweep_day")), ["year", "carrier"], "cents", PERCENTS)
    e = exact.select(F.col("year").alias("y"), F.col("carrier").alias("c"), F.col("percentile").alias("p"), "value", F.col("n").alias("en"))
    s = p4_signed_percentiles(spark, sf_dir)
    both = s.join(e, F.col("year").eqNullSafe(F.col("y")) & F.col("carrier").eqNullSafe(F.col("c")) & (F.col("percentile") == F.col("p")), "full")
    good = F.col("value").between(F.col("value_low"), F.col("value_high")) & (F.col("n") == F.col("en"))
    return both.agg(F.count(F.when(~F.coalesce(good, F.lit(False)), 1)).alias("violations"))


# ---- p5: texts cut off -----------------------------------------------------------------------------------------
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose excerpt, or the title in it, was cut."""
    return truncation.truncated(table(spark, sf_dir, "records"), "id", "excerpt", "source_id").select("id")


def p5_source_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates: rows, rows found cut and their share."""
    rec = table(spark, sf_dir, "records").select("id", "source_id", "excerpt")
    scored = truncation.truncated(rec, "id", "excerpt", "source_id", every=True, with_source=True)
    cut = scored.groupBy(F.col("src")).agg(F.sum((F.col("score") > 0).cast("bigint")).alias("n_cut"))
    n = rec.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_rows"))
    both = n.join(cut, F.coalesce("source_id", F.lit("")) == F.col("src"), "left").select("source_id", "n_rows", F.coalesce("n_cut", F.lit(0)).alias("n_cut"))
    return both.withColumn("share", F.round(F.col("n_cut") / F.col("n_rows"), 6))


def p5_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be wrong with p5_found: ids twice, ids of no record or of one without an excerpt, shares that don't add up to it."""
    found, rec = materialize(p5_found(spark, sf_dir), "cut-ids")[0], table(spark, sf_dir, "records").select("id", "excerpt")
    shares = p5_source_shares(spark, sf_dir).agg(F.sum("n_cut").alias("cut"), F.sum("n_rows").alias("all")).crossJoin(found.agg(F.count(F.lit(1)).alias("n")))  # one row each
    total = rec.agg(F.count(F.lit(1)).alias("records"))
    twice = found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    stray = found.join(rec.where(F.col("excerpt").rlike(r"\S")), "id", "left_anti")
    n = lambda name, df: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
    odd = shares.crossJoin(total).where("cut <> n or all <> records")
    return n("twice", twice).union(n("no_such_value", stray)).union(n("shares", odd))


# ---- p6: groups of linked records ------------------------------------------------------------------------------
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records linked, directly or through others, to another record, with the smallest id of their group."""
    c = components.components(table(spark, sf_dir, "links"), "record_id_a", "record_id_b", table(spark, sf_dir, "records"), "id")
    return c.select(F.col("node").alias("record_id"), "group_id")


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its group; a record without links is its own group."""
    ids = table(spark, sf_dir, "records").select(F.col("id").alias("record_id"))
    return ids.join(p6_found(spark, sf_dir), "record_id", "left").select("record_id", F.coalesce("group_id", "record_id").alias("group_id"))


# ---- p7: containers --------------------------------------------------------------------------------------------
def _copies(text: str) -> Column:
    """Documents with the same words in the same letter case, apart from white space, are one duplicate cluster."""
    return F.xxhash64(F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " ")))


def _doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", _copies("text").alias("cluster"), "text")
    return materialize(tokens.token_counts(docs, "text", ["doc_id", "source", "cluster"]), "doc-tokens")[0]


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of every non-blank document, for every container size."""
    return packing.pack_documents(_doc_tokens(spark, sf_dir), "doc_id", "tokens", "source", "cluster", table(spark, sf_dir, "pack_sizes"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and unused space by container size."""
    return packing.fill_report(p7_containers(spark, sf_dir))


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be wrong with p7_containers, recomputed from its rows."""
    sizes, packs = _doc_tokens(spark, sf_dir), table(spark, sf_dir, "pack_sizes")
    packed, _ = materialize(packing.pack_documents(sizes, "doc_id", "tokens", "source", "cluster", packs), "packed")
    return packing.violations(packed, sizes, "doc_id", "tokens", "source", "cluster", packs)


def p7_conflict_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where two pairs of sources are kept apart."""
    sizes, packs = _doc_tokens(spark, sf_dir), table(spark, sf_dir, "pack_sizes")
    packed, _ = materialize(packing.pack_documents(sizes, "doc_id", "tokens", "source", "cluster", packs, conflicts=APART), "packed")
    return packing.violations(packed, sizes, "doc_id", "tokens", "source", "cluster", packs, APART)


# ---- p8: mixing sources ----------------------------------------------------------------------------------------
def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_doc_tokens(spark, sf_dir), "doc_id", "tokens", "source", table(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents chosen, each as often as it is used, in the order of their slots."""
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares by source, and the most that a document is used."""
    return _mix(spark, sf_dir)[1]


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be wrong with p8_mix: (slot, document) or copy used twice, more uses than allowed, tokens that are not the document's,
    and shares further from the target (among sources with documents) than a document's length and a hundredth."""
    sizes, targets = _doc_tokens(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    chosen, report = mixing.mix(sizes, "doc_id", "tokens", "source", targets)
    chosen, report = materialize(chosen, "mixed")[0], materialize(report, "mix-report")[0]
    twice = chosen.groupBy("doc_id", "copy").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    s = sizes.select("doc_id", F.col("tokens").alias("t"), F.col("source").alias("src"))
    stray = chosen.join(s, "doc_id", "left").where("t is null or t <> tokens or src <> source")
    there = report.where("tokens > 0").agg(F.sum("target_share").alias("w"))
    wrong = report.where("tokens > 0").crossJoin(there).where("abs(actual_share - target_share / w) > 0.01")  # a row per target
    n = lambda name, df: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
    return n("copy_twice", twice).union(n("too_often", report.where("most_copies > max_repeats"))).union(n("not_the_document", stray)).union(n("share", wrong))


# ---- p9: sentences ---------------------------------------------------------------------------------------------
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document with its place."""
    return sentences.sentences(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be wrong with p9_found: overlaps, white space at an end, characters that are no white space and in no sentence, documents without a sentence."""
    found, _ = materialize(p9_found(spark, sf_dir), "sentences")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    texts = docs.where("text is not null").join(found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_start", "sent_end"))).alias("s")), "doc_id", "left")
    return sentences.violations(texts, "text", "s")


QUERIES = {q.__name__: q for q in (p4_percentiles, p4_claim_stats, p4_all_percentiles, p4_all_claim_stats, p4_day_states, p4_year_percentiles, p4_fine_percentiles, p4_signed_percentiles, p4_signed_check, p5_found, p5_source_shares, p5_check, p6_found, p6_groups, p7_containers, p7_fill, p7_check, p7_conflict_check, p8_mix, p8_shares, p8_check, p9_found, p9_check)}

_AMOUNTS = f"""
with a as (select sweep_day, carrier, claim_consumer_cents cents from arb_claims where claim_consumer_cents is not null),
k as (
  select sweep_day, cents, 'carrier' scope, carrier, 'raw' measure from a
  union all select sweep_day, cents, 'all', null, 'raw' from a
  union all select sweep_day, cents, 'carrier', carrier, 'capped' from a where cents <= {CAP_CENTS}
  union all select sweep_day, cents, 'all', null, 'capped' from a where cents <= {CAP_CENTS}
)"""
_PCTS = ", ".join(f"({p})" for p in PERCENTS)
_B0 = f"case when abs(cents) < {1 << quantiles.BITS} then abs(cents) else (length(bin(abs(cents))) - {quantiles.BITS}) * {1 << quantiles.BITS} + (abs(cents) >> (length(bin(abs(cents))) - 1 - {quantiles.BITS})) - {1 << quantiles.BITS} end"
_BUCKET = f"sign(cents) * ({_B0})"
_RANKED = """
, r as (select {keys}, {v} v, row_number() over (partition by {keys} order by {v}) rn, count(*) over (partition by {keys}) n from k)
select {keys}, percentile, {out} from r join (values {pcts}) t(percentile) on rn = greatest(1, (n * percentile + 99) // 100)"""

_BY_YEAR = f""", b as (select year(sweep_day) y, {{keys}}, cast({_BUCKET} as bigint) bucket from {{rows}}),
r as (select y, {{keys}}, bucket b, row_number() over (partition by y, {{keys}} order by bucket) rn, count(*) over (partition by y, {{keys}}) n from b),
e as (select *, abs(b) // {1 << quantiles.BITS} - 1 e from r join (values {_PCTS}) t(percentile) on rn = greatest(1, (n * percentile + 99) // 100)),
w as (select *, case when abs(b) < {1 << quantiles.BITS} then abs(b) else (abs(b) - e * {1 << quantiles.BITS}) << e end low, case when abs(b) < {1 << quantiles.BITS} then abs(b) else ((abs(b) - e * {1 << quantiles.BITS} + 1) << e) - 1 end high from e)
select cast(y as int) as year, {{keys}}, percentile, n, case when b < 0 then -high else low end value_low, case when b < 0 then -low else high end value_high from w"""
_SOUND = "select c as check, 0 violations from (values ('over_capacity'), ('not_whole'), ('divided'), ('same_cluster'), ('conflict')) t(c)"

SQL = {
    "p4_percentiles": _AMOUNTS + _RANKED.format(keys="scope, carrier, measure", v="cents", pcts=_PCTS, out="v as value, n, cast(0 as bigint) error_bound"),
    "p4_claim_stats": _AMOUNTS
    + """
, r as (select scope, carrier, cents, row_number() over (partition by scope, carrier order by cents) rn, count(*) over (partition by scope, carrier) n from k where measure = 'capped')
select scope, carrier, count(*) claim_capped_rows, cast(sum(cents) as bigint) claim_capped_total_cents, max(case when rn = greatest(1, (n * 50 + 99) // 100) then cents end) claim_median_cents_approx
from r group by scope, carrier""",
    "p4_day_states": _AMOUNTS + f" select scope, carrier, measure, sweep_day, cast({_BUCKET} as bigint) bucket, count(*) n, cast(sum(cents) as bigint) total from k group by all",
    "p4_year_percentiles": _AMOUNTS + _BY_YEAR.format(keys="scope, carrier, measure", rows="k"),
    "p4_signed_percentiles": "with k as (select sweep_day, carrier, award_consumer_cents - claim_consumer_cents cents from arb_claims where award_consumer_cents is not null and claim_consumer_cents is not null)" + _BY_YEAR.format(keys="carrier", rows="k"),
    "p4_signed_check": "select 0 violations",
    "p4_fine_percentiles": f"""with r as (select carrier, claim_consumer_cents v, row_number() over (partition by carrier order by claim_consumer_cents) rn, count(*) over (partition by carrier) n from arb_claims where claim_consumer_cents is not null)
select carrier, cast(percentile as double) percentile, v as value, n from r join (values {", ".join(f"({p})" for p in FINE)}) t(percentile) on rn = greatest(1, cast(ceil(n * cast(percentile as decimal(12,4)) / 100) as bigint))""",
    "p5_check": "select c as check, 0 violations from (values ('twice'), ('no_such_value'), ('shares')) t(c)",
    "p7_check": _SOUND, "p7_conflict_check": _SOUND,
    "p8_check": "select c as check, 0 violations from (values ('copy_twice'), ('too_often'), ('not_the_document'), ('share')) t(c)",
    "p9_check": "select c as check, 0 violations from (values ('overlap'), ('blank_edge'), ('left_out'), ('no_sentence')) t(c)",
    "p6_found": """
with recursive e as (
  select distinct greatest(record_id_a, record_id_b) a, least(record_id_a, record_id_b) b from links
  where record_id_a <> record_id_b and record_id_a in (select id from records) and record_id_b in (select id from records)
), d as (select a u, b v from e union all select b, a from e),
walk(node, label) using key (node) as (
  select u, min(least(u, v)) from d group by u
  union
  select d.v, min(w.label) from walk w join d on d.u = w.node join recurring.walk cur on cur.node = d.v where w.label < cur.label group by d.v
)
select node record_id, label group_id from walk""",
}
SQL["p6_groups"] = SQL["p6_found"].replace("select node record_id, label group_id from walk", "select id record_id, coalesce(label, id) group_id from records left join walk on node = id")
_CARRIERS = "(select distinct 'carrier' scope, carrier from arb_claims union all select distinct 'all', null from arb_claims) c"
SQL["p4_all_percentiles"] = f"""
select c.scope, c.carrier, m.measure, p.percentile, s.value, coalesce(s.n, 0) n, cast(0 as bigint) error_bound
from {_CARRIERS} cross join (values ('raw'), ('capped')) m(measure) cross join (values {_PCTS}) p(percentile)
left join ({SQL["p4_percentiles"]}) s on s.scope = c.scope and s.carrier is not distinct from c.carrier and s.measure = m.measure and s.percentile = p.percentile"""
SQL["p4_all_claim_stats"] = f"""
select c.scope, c.carrier, coalesce(claim_capped_rows, 0) claim_capped_rows, coalesce(claim_capped_total_cents, 0) claim_capped_total_cents, claim_median_cents_approx
from {_CARRIERS} left join ({SQL["p4_claim_stats"]}) s on s.scope = c.scope and s.carrier is not distinct from c.carrier"""
