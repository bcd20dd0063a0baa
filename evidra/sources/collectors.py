"""From parsed items to records: (dedupe_key, source_id, source_url, record_date, excerpt, carrier, vetting_status).

Each is a filter and a projection; ``operators.tables.insert_new`` appends the result to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra import taxonomy as tx
from evidra.functions import dates, text

#: Words that make a text of a public source relevant without a carrier's name.
RELEVANT = ["wireless", "telecom", "mobile", "carrier", "broadband", "cellular", "cell phone", "5g", "internet service"]
#: What marks a filer as an organization.
ORG_SUFFIX = ["llc", "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "lp", "llp", "pllc", "plc", "gmbh", "pc"]
ORG_WORD = [
    "association", "assn", "coalition", "committee", "commission", "council", "institute", "foundation", "university", "college", "department", "agency", "bureau",
    "alliance", "federation", "union", "systems", "communications", "networks", "network", "partners", "group", "center", "centre", "firm", "counsel", "attorneys",
    "telecom", "wireless", "broadband", "utilities",
]
ORG_PHRASE = ["on behalf of", "law firm", "law office", "law offices", "law group", "legal aid", "school district", "office of", "city of", "county of", "state of", "public utility", "public utilities", "public knowledge", "consumer law", "attorney general"]


def named(c: Column) -> Column:
    """Whether a text names a carrier or an issue of the taxonomy."""
    return text.first_match(c, tx.CARRIERS).isNotNull() | text.first_match(c, tx.ISSUES).isNotNull()


def relevant(c: Column) -> Column:
    return named(c) | text.any_term(c, RELEVANT)


def http_date(c: Column) -> Column:
    """``Mon, 1 Jan 2024 00:00:00 GMT`` or an ISO time as epoch seconds, else null."""
    iso = F.when(text.trim_all(c).rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)?)?$"), text.trim_all(c))
    zoned = F.when(iso.rlike(r"[T ]\d\d:.*(Z|[+-]\d\d:\d\d)$"), iso).when(iso.rlike(r"[T ]\d\d:"), F.concat(iso, F.lit("Z"))).otherwise(F.concat(iso, F.lit("T00:00:00Z")))
    t = F.regexp_replace(text.trim_all(c), r"^[A-Za-z]{3,9},\s*", "")
    rfc = F.when(t.rlike(r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d (GMT|UTC|Z|[+-]\d{4})$"), F.regexp_replace(t, r" (?:GMT|UTC|Z)$", " +0000"))
    return F.coalesce(F.unix_seconds(F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z"))), F.unix_seconds(zoned.try_cast("timestamp")))


def _records(df: DataFrame, source: str, key: Column, url: Column, date: Column, excerpt: Column, carrier: Column, vetting: str) -> DataFrame:
    return df.select(key.alias("dedupe_key"), F.lit(source).alias("source_id"), url.alias("source_url"), date.cast("bigint").alias("record_date"), F.substring(excerpt, 1, 500).alias("excerpt"), carrier.alias("carrier"), F.lit(vetting).alias("vetting_status"))


def press_feed(items: DataFrame, source: str, prefix: str, wide: bool = True) -> DataFrame:
    """Items of ``feeds.feed_items`` of a public authority; ``wide`` also takes texts that only concern the trade."""
    body = F.concat_ws(" ", "title", "description")
    ok = items.where((F.col("link") != "") & (relevant(body) if wide else named(body)))
    return _records(ok, source, F.concat(F.lit(f"{prefix}:"), "link"), F.col("link"), http_date(F.col("pub_date")), text.feed_excerpt(F.col("title"), F.col("description")), text.first_match(body, tx.CARRIERS), "verified_primary")


def press_listing(items: DataFrame, source: str, prefix: str, earliest: tuple[int, int]) -> DataFrame:
    """Items of ``feeds.listing_items`` from a month on; keys of the same space as the feed's, so both meet in one record."""
    ok = items.where((F.col("year") * 100 + F.col("month") >= earliest[0] * 100 + earliest[1]) & relevant(F.col("title")))
    day = F.unix_date(F.make_date("year", "month", F.lit(1))).cast("bigint") * 86_400
    return _records(ok, source, F.concat(F.lit(f"{prefix}:"), "url"), F.col("url"), day, F.col("title"), text.first_match(F.col("title"), tx.CARRIERS), "verified_primary")


def news_feed(items: DataFrame, source: str = "news_google") -> DataFrame:
    where = text.headline_source(F.col("title"), F.col("link"))
    return _records(items.where("link <> ''"), source, F.concat(F.lit("news:google:"), "link"), F.col("link"), http_date(F.col("pub_date")), F.concat("title", F.lit(" | "), where), text.first_match(F.col("title"), tx.CARRIERS), "single_source")


def news_articles(articles: DataFrame, source: str = "news_gdelt") -> DataFrame:
    return _records(articles, source, F.concat(F.lit("news:gdelt:"), "url"), F.col("url"), dates.compact_epoch(F.col("seendate")), F.concat(F.coalesce("title", F.lit("")), F.lit(" | "), F.coalesce("domain", F.lit(""))), text.first_match(F.col("title"), tx.CARRIERS), "single_source")


def social_posts(posts: DataFrame, source: str = "bluesky") -> DataFrame:
    return _records(posts.where(named(F.col("text"))), source, F.col("uri"), F.col("uri"), http_date(F.col("created_at")), F.substring("text", 1, 300), text.first_match(F.col("text"), tx.CARRIERS), "single_source")


def forum_items(hits: DataFrame, source: str = "hackernews", base: str = "https://news.ycombinator.com/item?id=") -> DataFrame:
    ok = hits.where((F.col("text") != "") & named(F.col("text")))
    return _records(ok, source, F.concat(F.lit("hn:"), "object_id"), F.concat(F.lit(base), "object_id"), F.col("created_at"), F.substring("text", 1, 300), text.first_match(F.col("text"), tx.CARRIERS), "single_source")


def docket_records(dockets: DataFrame, source: str = "courtlistener") -> DataFrame:
    text_of = lambda c: F.coalesce(c, F.lit(""))
    excerpt = F.concat(text_of("case_name"), F.lit(" | "), text_of("court"), F.lit(" | docket "), text_of("docket_number"), F.lit(" | filed "), text_of("date_filed"))
    return _records(dockets, source, F.concat(F.lit("cl:"), "url"), F.col("url"), dates.filing_date(F.col("date_filed")), excerpt, text.first_match(F.col("case_name"), tx.CARRIERS), "single_source")


def filing_records(filings: DataFrame, phrase: str, phrase_no: int, carrier: str | None, source: str = "sec_edgar") -> DataFrame:
    excerpt = F.concat("title", F.lit(f" | matched: {phrase}"))
    return _records(filings, source, F.concat(F.lit("edgar:"), "accession", F.lit(f":{phrase_no}")), F.col("url"), dates.filing_date(F.col("file_date")), excerpt, F.lit(carrier).cast("string"), "verified_primary")


def is_organization(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    tokens = F.split(F.regexp_replace(low, r"[.,&/()]", " "), r"\s+")
    phrase = F.lit(False)
    for p in ORG_PHRASE:
        phrase = phrase | F.contains(low, F.lit(p))
    return phrase | F.arrays_overlap(tokens, F.array(*(F.lit(w) for w in ORG_SUFFIX + ORG_WORD)))


def comment_records(filings: DataFrame, cursor: str = "", source: str = "fcc_ecfs") -> DataFrame:
    """Comment filings after the cursor; names and texts of individuals are withheld."""
    ok = filings.where((F.col("date_received") == "") | (F.col("date_received") > cursor))
    terms = F.array_join(text.all_matches(F.col("snippet"), tx.ISSUES), ",")
    base = F.concat(F.lit("ECFS "), F.col("id"), F.lit(" | proceeding "), F.when(F.col("proceedings") != "", F.col("proceedings")).otherwise("n/a"), F.lit(" | "), F.col("date_received"), F.when(terms != "", F.concat(F.lit(" | terms: "), terms)).otherwise(""))
    excerpt = F.when(is_organization(F.col("filer_name")) & (F.col("filer_name") != ""), F.concat("filer_name", F.lit(" | "), base, F.lit(" | "), "snippet")).otherwise(F.concat(base, F.lit(" | individual filer, name withheld")))
    return _records(ok, source, F.concat(F.lit("ecfs:"), "id"), F.lit(None).cast("string"), dates.filing_date(F.substring("date_received", 1, 10)), excerpt, text.first_match(F.col("snippet"), tx.CARRIERS), "single_source")


def complaint_rows(rows: DataFrame, source: str = "fcc_complaints") -> DataFrame:
    """Complaint rows (id, ticket_created, issue_type, issue, city, state, zip): phone issues only; the key is the id, else ``:id`` if there is such a column, else what there is."""
    ident = F.coalesce("id", "`:id`") if ":id" in rows.columns else F.col("id")
    key = F.coalesce(F.concat(F.lit("socrata:"), F.nullif(ident, F.lit(""))), F.concat_ws(":", F.lit("socrata"), *(F.coalesce(c, F.lit("")) for c in ("ticket_created", "city", "state", "zip"))))
    excerpt = F.concat_ws(" | ", F.lit("FCC consumer complaint"), "issue", "city", "state")
    return _records(rows.where("issue_type = 'Phone'"), source, key, F.lit(None).cast("string"), dates.filing_date(F.substring("ticket_created", 1, 10)), excerpt, F.lit(None).cast("string"), "single_source")


def next_cursor(rows: DataFrame, column: str, previous: str | None) -> DataFrame:
    """The greatest text of a page, or the previous cursor."""
    return rows.agg(F.greatest(F.max(column), F.lit(previous).cast("string")).alias("cursor"))


def story_submissions(forms: DataFrame, carriers: list[str]) -> DataFrame:
    """Valid submissions (what_happened, agree, carrier, city, state, zip, contact): consent and 20 characters needed; odd values become null."""
    cut = lambda c, n: text.trim_all(F.substring(F.coalesce(c, F.lit("")), 1, n))
    some = lambda c: F.when(c != "", c)
    state = F.upper(cut("state", 2))
    ok = forms.where((F.col("agree") == "on") & (F.length(cut("what_happened", 8000)) >= 20))
    return ok.select(cut("what_happened", 8000).alias("what_happened"), F.when(F.col("carrier").isin(carriers), F.col("carrier")).alias("carrier"), some(cut("city", 100)).alias("city"), F.when(state.rlike("^[A-Z]{2}$"), state).alias("state"), F.when(cut("zip", 5).rlike(r"^\d{5}$"), cut("zip", 5)).alias("zip"), some(cut("contact", 200)).alias("contact"))


def search_phrases(carriers: list[str], phrases: list[str], first: int = 2) -> list[str]:
    """Queries of every carrier with the first phrases."""
    return [f'"{c}" "{p}"' for c in carriers for p in phrases[:first]]


def rotate(items: list, turn: int, n: int = 1) -> list:
    """``n`` items from place ``turn`` on, round and round."""
    return [items[(turn + k) % len(items)] for k in range(min(n, len(items)))] if items else []


def retry_wait_ms(header: Column, now: Column) -> Column:
    """Milliseconds to wait by a Retry-After header (seconds or a date) at ``now`` (epoch milliseconds); null if it says nothing."""
    t = text.trim_all(header)
    return F.when(t.rlike(r"^\d{1,15}$"), F.when(t.rlike(r"^\d{1,15}$"), t).cast("bigint") * 1000).otherwise(F.greatest(F.lit(0), http_date(header) * 1000 - now))
