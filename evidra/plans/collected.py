"""Queries over collected documents: pages and answers are rebuilt from the tables as text, parsed by the sources, and turned into records.

The SQL beside each reads the tables' own columns, so a parser that loses or changes anything shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra import taxonomy as tx
from evidra.functions import dates, signals, text
from evidra.operators import quality, queues, tables
from evidra.plans.core import SQL as CORE_SQL
from evidra.plans.core import _DECODE, _EV, _SQUEEZE, _any_sql, _events, _field_sql, rule_classification
from evidra.session import table as read
from evidra.sources import collectors, feeds, files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_FIRST = lambda c: f"case {' '.join(f'when {_any_sql(c, t)} then {chr(39)}{n}{chr(39)}' for n, t in tx.CARRIERS)} end"
_NAMED = lambda c: "coalesce(" + " or ".join(_any_sql(c, t) for _, t in [*tx.CARRIERS, *tx.ISSUES]) + ", false)"
_RELEVANT = lambda c: f"({_NAMED(c)} or coalesce({_any_sql(c, collectors.RELEVANT)}, false))"
_PLAIN = lambda c: _SQUEEZE.format(c=f"regexp_replace({c}, '<[^>]+>', ' ', 'g')")
_RECORD = "dedupe_key, source_id, source_url, record_date, excerpt, carrier, vetting_status"


def _escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


# ---- parsers ---------------------------------------------------------------------------------------------------
def _feed_pages(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.lit("<rss><channel><item><title>"), _escape(F.col("title")), F.lit("</title><link>"), _escape(F.col("url")), F.lit("</link><description><![CDATA[<p>"), _escape(F.col("title")), F.lit(" &amp; more</p>]]></description><pubDate>"), _escape(F.coalesce("seendate", F.lit(""))), F.lit("</pubDate></item></channel></rss>")]
    return read(spark, d, "gdelt_articles").select("article_id", F.concat(*parts).alias("page"))


@query(f"select article_id, 0 pos, {_PLAIN('title')} title, {_SQUEEZE.format(c='url')} link, {_PLAIN(f'title || {chr(39)} & more{chr(39)}')} description, nullif({_PLAIN('seendate')}, '') pub_date from gdelt_articles where title is not null and url is not null")
def feed_entries(spark: SparkSession, d: str) -> DataFrame:
    """Items of feeds, a feed per article."""
    return feeds.feed_items(_feed_pages(spark, d), "page", ["article_id"])


@query("select delivery_id, uri, coalesce(text, '') as text, coalesce(created_at, '') created_at from bsky_items where coalesce(uri, '') <> ''")
def post_answers(spark: SparkSession, d: str) -> DataFrame:
    """Posts of search answers."""
    post = F.struct("uri", F.struct("text", F.col("created_at").alias("createdAt")).alias("record"))
    return feeds.posts(read(spark, d, "bsky_items").select("delivery_id", F.to_json(F.struct(F.array(post).alias("posts"))).alias("page")), "page", ["delivery_id"])


_HIT_TEXT = _SQUEEZE.format(c=f"regexp_replace({_DECODE.format(c='replace(replace(text, chr(38) || chr(35) || chr(120) || chr(50) || chr(70) || chr(59), chr(47)), chr(38) || chr(35) || chr(120) || chr(50) || chr(55) || chr(59), chr(39))')}, '<[^>]+>', ' ', 'g')")


@query(f"select delivery_id, object_id, coalesce({_HIT_TEXT}, '') as text, case when regexp_matches(created_at, '^\\d+$') then try_cast(created_at as bigint) end created_at, cast(null as varchar) url from hn_items where coalesce(object_id, '') <> ''")
def hit_answers(spark: SparkSession, d: str) -> DataFrame:
    """Items of search answers; the text is the comment's, without entities and tags."""
    hit = F.struct(F.col("object_id").alias("objectID"), F.col("text").alias("comment_text"), F.col("created_at").alias("created_at_i"))
    return feeds.hits(read(spark, d, "hn_items").select("delivery_id", F.to_json(F.struct(F.array(hit).alias("hits"))).alias("page")), "page", ["delivery_id"])


_ACCESSION = "replace(docket_number, ':', '-')"


def _filing_pages(spark: SparkSession, d: str) -> DataFrame:
    source = F.struct(F.array(F.lpad(F.col("docket_id").cast("string"), 10, "0")).alias("ciks"), F.array("case_name").alias("display_names"), F.col("date_filed").alias("file_date"), F.col("court").alias("form"))
    hit = F.struct(F.concat(F.replace("docket_number", F.lit(":"), F.lit("-")), F.lit(":doc.htm")).alias("_id"), source.alias("_source"))
    return read(spark, d, "docket_items").select("docket_id", F.to_json(F.struct(F.struct(F.array(hit).alias("hits")).alias("hits"))).alias("page"))


@query(f"""select docket_id, {_ACCESSION} accession, 'https://www.sec.gov/Archives/edgar/data/' || docket_id || '/' || replace({_ACCESSION}, '-', '') || '/doc.htm' url,
 array_to_string(list_filter([case_name, court, date_filed], lambda x: coalesce(x, '') <> ''), ' | ') title, coalesce(date_filed, '') file_date, lpad(docket_id::varchar, 10, '0') cik from docket_items where coalesce(docket_number, '') <> ''""")
def filing_answers(spark: SparkSession, d: str) -> DataFrame:
    """Filings of search answers."""
    return feeds.filings(_filing_pages(spark, d), "page", ["docket_id"])


def _comment_pages(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("captured_at", "yyyy-MM-dd")
    f = F.struct(F.col("doc_id").cast("string").alias("id_submission"), day.alias("date_received"), F.array(F.struct(F.col("carrier").alias("name"))).alias("filers"), F.array(F.struct(F.col("source").alias("name"))).alias("proceedings"), F.col("text").alias("text_data"))
    return read(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.array(f).alias("filings"))).alias("page"))


_COMMENTS = f"""select doc_id, doc_id::varchar id, coalesce(strftime(captured_at, '%Y-%m-%d'), '') date_received, coalesce(carrier, '') filer_name, coalesce(source, '') proceedings, substr({_PLAIN("coalesce(text, '')")}, 1, 280) snippet from documents"""


@query(_COMMENTS)
def comment_answers(spark: SparkSession, d: str) -> DataFrame:
    """Comment filings of search answers: the filer, the proceedings and the text's first 280 characters, as the source gives them out."""
    return feeds.comment_filings(_comment_pages(spark, d), "page", ["doc_id"])


@query("select article_id, coalesce(title, '') title, url, coalesce(site_domain, '') as domain, coalesce(seendate, '') seendate from gdelt_articles where coalesce(url, '') <> ''")
def article_answers(spark: SparkSession, d: str) -> DataFrame:
    a = F.struct("url", "title", F.col("site_domain").alias("domain"), "seendate")
    return feeds.articles(read(spark, d, "gdelt_articles").select("article_id", F.to_json(F.struct(F.array(a).alias("articles"))).alias("page")), "page", ["article_id"])


def _docket_pages(spark: SparkSession, d: str) -> DataFrame:
    r = F.struct(F.col("url").alias("docket_absolute_url"), F.col("case_name").alias("caseName"), "court", F.col("date_filed").alias("dateFiled"), F.col("docket_number").alias("docketNumber"))
    return read(spark, d, "docket_items").select("docket_id", F.to_json(F.struct(F.array(r).alias("results"))).alias("page"))


@query("select docket_id, coalesce(case_name, '') case_name, coalesce(court, '') court, coalesce(date_filed, '') date_filed, coalesce(docket_number, '') docket_number, case when starts_with(url, 'http') then url else 'https://www.courtlistener.com' || url end url from docket_items where coalesce(url, '') <> ''")
def docket_answers(spark: SparkSession, d: str) -> DataFrame:
    return feeds.dockets(_docket_pages(spark, d), "page", ["docket_id"])


@query("select id, strftime(to_timestamp(capture_date) at time zone 'UTC', '%Y%m%d') as timestamp, source_url original, coalesce(dedupe_key, '') digest, '200' status from records where coalesce(source_url, '') <> '' and capture_date is not null")
def capture_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a capture index, the first row of each answer being its header."""
    head = F.array(*(F.lit(x) for x in ("timestamp", "original", "digest", "statuscode")))
    row = F.array(F.date_format(dates.utc_day(F.col("capture_date")), "yyyyMMdd"), F.col("source_url"), F.col("dedupe_key"), F.lit("200"))
    return feeds.captures(read(spark, d, "records").select("id", F.to_json(F.array(head, row)).alias("page")), "page", ["id"])


_LISTED = f"select article_id, 'https://www.ftc.gov/news-events/news/press-releases/' || (2013 + article_id % 13) || '/' || lpad((1 + article_id % 12)::varchar, 2, '0') || '/item-' || article_id url, (2013 + article_id % 13)::int as year, (1 + article_id % 12)::int as month, {_PLAIN('title')} title from gdelt_articles"


def _listing_pages(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "gdelt_articles")
    path = F.concat(F.lit("/news-events/news/press-releases/"), (F.col("article_id") % 13 + 2013).cast("string"), F.lit("/"), F.lpad((F.col("article_id") % 12 + 1).cast("string"), 2, "0"), F.lit("/item-"), F.col("article_id").cast("string"))
    anchor = lambda body: F.concat(F.lit('<a class="x" href="'), path, F.lit('">'), body, F.lit("</a>"))
    return a.select("article_id", F.concat(F.lit('<div><a href="/other">no</a>'), anchor(F.col("title")), anchor(F.lit("again")), F.lit("</div>")).alias("page"))


@query(f"select * from ({_LISTED}) where title <> ''")
def listing_entries(spark: SparkSession, d: str) -> DataFrame:
    """Press releases of listing pages; the first anchor of an address counts."""
    return feeds.listing_items(_listing_pages(spark, d), "page", ["article_id"]).drop("pos")


@query("select docket_id, case when docket_id % 3 = 0 then 'https://data.example/files/q-2024-' || docket_id || '.xlsx' else 'https://data.example/about/latest.csv' end link from docket_items")
def data_file_links(spark: SparkSession, d: str) -> DataFrame:
    """The data file a page links to: the last with a year, else the last."""
    page = F.when(F.col("docket_id") % 3 == 0, F.concat(F.lit('<a href="/files/q-2019.xlsx">a</a><a href="/files/zz.csv">b</a><a href="/files/q-2024-'), F.col("docket_id").cast("string"), F.lit('.xlsx">c</a>'))).otherwise(F.lit('<a href="about.html">a</a><a href="latest.csv">b</a>'))
    return read(spark, d, "docket_items").select("docket_id", feeds.data_file_link(page, F.lit("https://data.example/about/index.html")).alias("link"))


@query("""with j as (select delivery_id id, case when batch_id % 2 = 0 then 'parse_file' else 'fetch' end kind, feed_id, case when delivery_id % 4 = 0 then '{broken' else '{"provider":"' || coalesce(feed_id, 'none') || '","n":' || delivery_id || '}' end payload from hn_items),
n as (select * from j where kind = 'parse_file' order by id desc limit 20)
select provider, payload from (select json_extract_string(payload, '$.provider') provider, payload, row_number() over (partition by json_extract_string(payload, '$.provider') order by id desc) k from n where payload <> '{broken') where k = 1""")
def provider_payloads(spark: SparkSession, d: str) -> DataFrame:
    """The newest payload of each provider among the 20 newest jobs; broken ones are skipped."""
    h = read(spark, d, "hn_items")
    payload = F.when(F.col("delivery_id") % 4 == 0, "{broken").otherwise(F.concat(F.lit('{"provider":"'), F.coalesce("feed_id", F.lit("none")), F.lit('","n":'), F.col("delivery_id").cast("string"), F.lit("}")))
    return files.latest_payloads(h.select(F.col("delivery_id").alias("id"), F.when(F.col("batch_id") % 2 == 0, "parse_file").otherwise("fetch").alias("type"), payload.alias("payload")))


# ---- records ---------------------------------------------------------------------------------------------------
_HTTP = r"""case when regexp_matches({t}, '^\d{{4}}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)?)?$') then epoch_us(try_cast(case when regexp_matches({t}, '[T ]\d\d:.*(Z|[+-]\d\d:\d\d)$') then {t} when regexp_matches({t}, '[T ]\d\d:') then {t} || 'Z' else {t} || ' 00:00:00Z' end as timestamptz)) // 1000000
 when regexp_matches(regexp_replace({t}, '^[A-Za-z]{{3,9}},\s*', ''), '^\d{{1,2}} [A-Z][a-z]{{2}} \d{{4}} \d\d:\d\d:\d\d (GMT|UTC|Z|[+-]\d{{4}})$') then epoch_us(try_strptime(regexp_replace(regexp_replace({t}, '^[A-Za-z]{{3,9}},\s*', ''), ' (GMT|UTC|Z)$', ' +0000'), '%d %b %Y %H:%M:%S %z')) // 1000000 end"""
_T = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


@query(f"select uri dedupe_key, 'bluesky' source_id, uri source_url, {_HTTP.format(t=_T.format(c='created_at'))} record_date, substr(text, 1, 300) excerpt, {_FIRST('text')} carrier, 'single_source' vetting_status from bsky_items where coalesce(uri, '') <> '' and {_NAMED('text')}")
def post_records(spark: SparkSession, d: str) -> DataFrame:
    """Posts that name a carrier or an issue, as whole records."""
    return collectors.social_posts(post_answers(spark, d))


@query(f"""with h as (select object_id, coalesce({_HIT_TEXT}, '') t, case when regexp_matches(created_at, '^\\d+$') then try_cast(created_at as bigint) end c from hn_items where coalesce(object_id, '') <> '')
select 'hn:' || object_id dedupe_key, 'hackernews' source_id, 'https://news.ycombinator.com/item?id=' || object_id source_url, c record_date, substr(t, 1, 300) excerpt, {_FIRST('t')} carrier, 'single_source' vetting_status from h where t <> '' and {_NAMED('t')}""")
def forum_records(spark: SparkSession, d: str) -> DataFrame:
    return collectors.forum_items(hit_answers(spark, d))


def _day_sql(t: str) -> str:
    iso = f"case when regexp_matches({t}, '^\\d{{1,2}}-[A-Za-z]{{3}}-(\\d{{2}}|\\d{{4}})$') then try_strptime(regexp_replace({t}, '-(\\d\\d)$', '-20\\1'), '%d-%b-%Y') when regexp_matches({t}, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') then try_strptime({t}, '%m/%d/%Y') when regexp_matches({t}, '^\\d{{4}}-\\d\\d-\\d\\d$') then try_strptime({t}, '%Y-%m-%d') end"
    return f"epoch_us({iso}) // 1000000"


@query(f"""select 'cl:' || u dedupe_key, 'courtlistener' source_id, u source_url, {_day_sql(_T.format(c='date_filed'))} record_date,
 substr(coalesce(case_name, '') || ' | ' || coalesce(court, '') || ' | docket ' || coalesce(docket_number, '') || ' | filed ' || coalesce(date_filed, ''), 1, 500) excerpt, {_FIRST("coalesce(case_name, '')")} carrier, 'single_source' vetting_status
from (select *, case when starts_with(url, 'http') then url else 'https://www.courtlistener.com' || url end u from docket_items where coalesce(url, '') <> '')""")
def docket_records(spark: SparkSession, d: str) -> DataFrame:
    return collectors.docket_records(docket_answers(spark, d))


@query(f"""select 'news:gdelt:' || url dedupe_key, 'news_gdelt' source_id, url source_url, case when regexp_matches(seendate, '^\\d{{8}}T\\d{{6}}Z?$') then epoch_us(try_strptime(substr(seendate, 1, 15), '%Y%m%dT%H%M%S')) // 1000000 end record_date,
 substr(coalesce(title, '') || ' | ' || coalesce(site_domain, ''), 1, 500) excerpt, {_FIRST("coalesce(title, '')")} carrier, 'single_source' vetting_status from gdelt_articles where coalesce(url, '') <> ''""")
def article_records(spark: SparkSession, d: str) -> DataFrame:
    """News articles as whole records; an empty title or domain leaves its place empty."""
    return collectors.news_articles(article_answers(spark, d))


@query(f"""with i as ({SQL['feed_entries']}) select 'press:' || link dedupe_key, 'agency' source_id, link source_url, {_HTTP.format(t='pub_date')} record_date, substr(case when length(description) > 400 then title || ' - ' || rtrim(substr(description, 1, 400)) || '...' when description <> '' then title || ' - ' || description else title end, 1, 500) excerpt,
 {_FIRST("(title || ' ' || description)")} carrier, 'verified_primary' vetting_status from i where link <> '' and {_RELEVANT("(title || ' ' || description)")}""")
def press_records(spark: SparkSession, d: str) -> DataFrame:
    """Feed items that concern the trade, as records."""
    return collectors.press_feed(feed_entries(spark, d), "agency", "press")


@query(f"""with i as (select * from ({_LISTED}) where title <> '') select 'press:' || url dedupe_key, 'agency' source_id, url source_url, epoch_us(make_timestamp(year, month, 1, 0, 0, 0)) // 1000000 record_date, substr(title, 1, 500) excerpt, {_FIRST('title')} carrier, 'verified_primary' vetting_status
from i where year * 100 + month >= 201506 and {_RELEVANT('title')}""")
def listing_records(spark: SparkSession, d: str) -> DataFrame:
    return collectors.press_listing(listing_entries(spark, d), "agency", "press", (2015, 6))


_PAPER = "case when strpos(title, ' - ') > 0 and length(title) - strpos(reverse(title), ' - ') - 2 > 0 and strpos(reverse(title), ' - ') + 2 < 60 then regexp_replace(reverse(substr(reverse(title), 1, strpos(reverse(title), ' - ') - 1)), '^\\s+|\\s+$', '', 'g') else regexp_extract(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1) end"
#: Half of the headlines name their paper, as feeds write it.
_TITLED = "case when article_id % 2 = 0 then title || ' - ' || coalesce(site_domain, 'The Paper') else title end"


@query(f"select article_id, {_PAPER} as paper from (select article_id, {_TITLED} title, url link from gdelt_articles) where title is not null")
def headline_papers(spark: SparkSession, d: str) -> DataFrame:
    """The paper of every headline: what it says after its last dash, else the link's host."""
    a = read(spark, d, "gdelt_articles").where("title is not null")
    title = F.when(F.col("article_id") % 2 == 0, F.concat("title", F.lit(" - "), F.coalesce("site_domain", F.lit("The Paper")))).otherwise(F.col("title"))
    return a.select("article_id", text.headline_source(title, F.col("url")).alias("paper"))


_PROVIDER_BODY = "'case id=' || coalesce(case_id, '') || '; non-consumer=' || coalesce(who, '') || '; filing date=' || coalesce(filed, '')"


@query(f"""with a as (select claim_id, case when claim_id % 9 = 0 then null else case_id end case_id, {' '.join(['case carrier', *(f"when '{n}' then '{t[0]}, Inc.'" for n, t in tx.RESPONDENTS), 'else carrier end'])} who, carrier, filed_ym || '-15' filed from arb_claims)
select case when coalesce(case_id, '') <> '' then 'arb:p:' || case_id else 'arb:p:file.csv:' || substr(sha256({_PROVIDER_BODY}), 1, 16) end dedupe_key, {_day_sql('filed')} record_date, substr(who || ' | ' || {_PROVIDER_BODY}, 1, 500) excerpt, carrier from a where carrier in ({', '.join(f"'{n}'" for n, _ in tx.RESPONDENTS)})""")
def provider_records(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a provider's file that name a known respondent, by the columns its header calls so; a row without a case is keyed by its content."""
    who = F.col("carrier")
    for n, t in tx.RESPONDENTS:
        who = F.when(F.col("carrier") == n, f"{t[0]}, Inc.").otherwise(who)
    a = read(spark, d, "arb_claims").select(F.when(F.col("claim_id") % 9 != 0, F.col("case_id")).alias("Case ID"), who.alias("Non-Consumer"), F.concat("filed_ym", F.lit("-15")).alias("Filing Date"))
    return files.arbitration_rows(a, "p", "file.csv", tx.RESPONDENTS)


@query(f"""select 'edgar:' || accession || ':1' dedupe_key, 'sec_edgar' source_id, url source_url, {_day_sql(_T.format(c='file_date'))} record_date, substr(title || ' | matched: churn', 1, 500) excerpt, 'norvane' carrier, 'verified_primary' vetting_status from ({SQL['filing_answers']})""")
def filing_records(spark: SparkSession, d: str) -> DataFrame:
    return collectors.filing_records(filing_answers(spark, d), "churn", 1, "norvane")


_WORDS = ", ".join(f"'{w}'" for w in collectors.ORG_SUFFIX + collectors.ORG_WORD)
_IS_ORG = "(" + " or ".join(f"contains(lower(filer_name), '{p}')" for p in collectors.ORG_PHRASE) + f" or list_has_any(regexp_split_to_array(regexp_replace(lower(filer_name), '[.,&/()]', ' ', 'g'), '\\s+'), [{_WORDS}]))"
_ISSUES = "array_to_string(list_filter([" + ", ".join(f"case when {_any_sql('snippet', t)} then '{n}' end" for n, t in tx.ISSUES) + "], lambda x: x is not null), ',')"


@query(f"""with f as (select id, date_received, case when doc_id % 2 = 0 and filer_name <> '' then filer_name || ' Wireless LLC' else filer_name end filer_name, proceedings, snippet from ({_COMMENTS})),
b as (select *, 'ECFS ' || id || ' | proceeding ' || case when proceedings <> '' then proceedings else 'n/a' end || ' | ' || date_received || case when {_ISSUES} <> '' then ' | terms: ' || {_ISSUES} else '' end base from f)
select 'ecfs:' || id dedupe_key, 'fcc_ecfs' source_id, cast(null as varchar) source_url, {_day_sql('date_received')} record_date, substr(case when {_IS_ORG} and filer_name <> '' then filer_name || ' | ' || base || ' | ' || snippet else base || ' | individual filer, name withheld' end, 1, 500) excerpt, {_FIRST('snippet')} carrier, 'single_source' vetting_status
from b where date_received = '' or date_received > '2021-01-01'""")
def comment_filing_records(spark: SparkSession, d: str) -> DataFrame:
    """Comment filings after a cursor as records; individuals' names and texts are withheld."""
    f = comment_answers(spark, d)
    f = f.withColumn("filer_name", F.when((F.col("doc_id") % 2 == 0) & (F.col("filer_name") != ""), F.concat("filer_name", F.lit(" Wireless LLC"))).otherwise(F.col("filer_name")))
    return collectors.comment_records(f, "2021-01-01")


@query(f"""with c as (select case when id % 5 = 0 then '' when id % 7 = 0 then null else id::varchar end id, strftime(to_timestamp(capture_date) at time zone 'UTC', '%Y-%m-%d') made_at, id % 3 k, alleged_issue, loc_city, loc_state, loc_zip from records)
select case when coalesce(id, '') <> '' then 'socrata:' || id else 'socrata:' || coalesce(made_at, '') || ':' || coalesce(loc_city, '') || ':' || coalesce(loc_state, '') || ':' || coalesce(loc_zip, '') end dedupe_key, 'fcc_complaints' source_id, cast(null as varchar) source_url, {_day_sql('made_at')} record_date,
 concat_ws(' | ', 'FCC consumer complaint', alleged_issue, loc_city, loc_state) excerpt, cast(null as varchar) carrier, 'single_source' vetting_status from c where k <> 0""")
def complaint_records(spark: SparkSession, d: str) -> DataFrame:
    """Phone complaints as records; a null or empty id is replaced by what there is."""
    r = read(spark, d, "records")
    ident = F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id").cast("string"))
    rows = r.select(ident.alias("id"), dates.utc_day(F.col("capture_date")).cast("string").alias("ticket_created"), F.when(F.col("id") % 3 != 0, "Phone").otherwise("TV").alias("issue_type"), F.col("alleged_issue").alias("issue"), F.col("loc_city").alias("city"), F.col("loc_state").alias("state"), F.col("loc_zip").alias("zip"))
    return collectors.complaint_rows(rows)


@query(f"with f as (select id, {_T.format(c=_field_sql('filing date'))} t from records where excerpt is not null) select id, {_day_sql('t')} filed from f")
def filing_dates(spark: SparkSession, d: str) -> DataFrame:
    """Filing dates of excerpts in any form, as epoch seconds; null where there is none or the day does not exist."""
    r = read(spark, d, "records").where("excerpt is not null").select("id", text.excerpt_field(F.col("excerpt"), ["filing date"]).alias("t"))
    return r.select("id", dates.filing_date(F.col("t")).alias("filed"))


@query("""with n as (select id, case id % 4 when 0 then capture_date when 1 then capture_date * 1000 when 2 then 1900 + id % 200 else id % 1000 end n from records)
select id, case when n between 1900 and 2100 then n::varchar when n >= 1000000000 and n < 100000000000 then strftime(to_timestamp(n) at time zone 'UTC', '%Y-%m-%d') when n >= 100000000000 and n < 100000000000000 then strftime(to_timestamp(n // 1000) at time zone 'UTC', '%Y-%m-%d') else n::varchar end shown from n""")
def shown_dates(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that are seconds, milliseconds, years or neither, as texts."""
    k = F.col("id") % 4
    n = F.when(k == 0, F.col("capture_date")).when(k == 1, F.col("capture_date") * 1000).when(k == 2, F.col("id") % 200 + 1900).otherwise(F.col("id") % 1000)
    return read(spark, d, "records").select("id", signals.loose_date(n).alias("shown"))


# ---- joins, updates and checks ---------------------------------------------------------------------------------
_SOURCES = [("bluesky", "Posts"), ("hackernews", "Forum"), ("aaa_arb", "Arbitration A"), ("ecfs", None)]


@query(f"select r.id, coalesce(s.display, r.source_id, 'source') sname from records r left join (values {', '.join(f'({chr(39)}{a}{chr(39)}, ' + (f'{chr(39)}{b}{chr(39)}' if b else 'null') + ')' for a, b in _SOURCES)}) s(id, display) on s.id = r.source_id")
def source_names(spark: SparkSession, d: str) -> DataFrame:
    """What each record's source is called: its display name, else its id, else a standing word."""
    s = spark.createDataFrame(_SOURCES, "sid string, display string")
    r = read(spark, d, "records").select("id", "source_id")
    return r.join(s, F.col("source_id") == F.col("sid"), "left").select("id", F.coalesce("display", "source_id", F.lit("source")).alias("sname"))


@query("""with c as (select id, dedupe_key, id // 25 g from records where source_id = 'bluesky' and dedupe_key is not null)
select id, case when g % 7 = 3 then 'unchecked' when dedupe_key in (select uri from bsky_items where uri is not null) then 'present' else 'gone' end outcome from c""")
def recheck_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Posts after a recheck by groups of 25: present, gone, or unchecked where the group's answer was no good. Only what is gone is purged."""
    c = read(spark, d, "records").where("source_id = 'bluesky' and dedupe_key is not null").select("id", F.col("dedupe_key").alias("key"), F.floor(F.col("id") / 25).alias("grp"))
    answers = c.select("grp").distinct().withColumn("good", F.col("grp") % 7 != 3)
    return queues.recheck(c, answers, read(spark, d, "bsky_items").select(F.col("uri").alias("key"))).select("id", "outcome")


@query("""with m as ({rules}) select r.id, coalesce(m.carrier, r.carrier) carrier, case when m.id is null then promo_name end promo_name, case when m.id is null then alleged_issue else m.issue end alleged_issue, case when m.id is null then r.confidence else m.confidence end confidence from records r left join m on m.id = r.id""")
def classified_records(spark: SparkSession, d: str) -> DataFrame:
    """Records after their classification: the carrier only changes to a known one, the rest is overwritten."""
    m = rule_classification(spark, d).select("id", "carrier", F.lit(None).cast("string").alias("promo_name"), F.col("issue").alias("alleged_issue"), "confidence")
    r = read(spark, d, "records").select("id", "carrier", "promo_name", "alleged_issue", "confidence")
    return tables.update_columns(r, m, "id", ["promo_name", "alleged_issue", "confidence"], ["carrier"])


_NUMBERS = r"list_filter(regexp_extract_all(coalesce(t, ''), '\d[\d,\.]*\d|\d'), lambda n: not contains(coalesce(r.excerpt, ''), n))"


@query(rf"""with l as (select doc_id, text t, case when doc_id % 4 <> 0 then doc_id * 3 end rid from documents where text is not null)
select doc_id, case when rid is not null and r.id is null then 'unknown record' when rid is null and regexp_matches(t, '[\d$]') then 'number without record' when regexp_matches(t, '[\d$]') and len({_NUMBERS}) > 0 then 'number not in record' end fault from l left join records r on r.id = l.rid""")
def line_citations(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with a text's citation of a record: not there, none although it has numbers, or numbers the record lacks."""
    lines = read(spark, d, "documents").where("text is not null").select("doc_id", "text", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") * 3).alias("record_id"))
    return quality.citation_faults(lines, "doc_id", "text", "record_id", read(spark, d, "records").select("id", "excerpt"))


@query(f"""with w as (select epoch // 3600 * 3600 window_start, {', '.join(f"count(*) filter (where event_type = '{t}') n{i}" for i, t in enumerate(('view', 'click', 'purchase', 'signup')))}, count(*) filter (where event_type = 'error') roars, count(*) filter (where event_type = 'error' and event_id % 2 = 0) delivered from {_EV} group by 1)
select window_start, (n0 >= 3)::int + (n1 >= 3)::int + (n2 >= 3)::int + (n3 >= 3)::int sufficient_metrics, not (n0 >= 3 and n1 >= 3 and n2 >= 3 and n3 >= 3) insufficient, roars::int roars, delivered::int keep_signal, ((window_start // 3600) % 5 = 0) <> (not (n0 >= 3 and n1 >= 3 and n2 >= 3 and n3 >= 3)) flag_wrong from w""")
def outcome_windows(spark: SparkSession, d: str) -> DataFrame:
    """Nested outcome records of hourly windows: four metrics with their samples, roars as an array; the stored flag against the one recomputed."""
    e = _events(spark, d).withColumn("window_start", F.floor(F.col("epoch") / 3600) * 3600)
    metric = lambda t: F.struct(F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias("value"), F.count(F.when(F.col("event_type") == t, 1)).alias("n"))
    roar = F.when(F.col("event_type") == "error", F.struct("event_id", (F.col("event_id") % 2 == 0).alias("delivered_encore")))
    o = e.groupBy("window_start").agg(*(metric(t).alias(m) for t, m in zip(("view", "click", "purchase", "signup"), signals.METRICS)), F.collect_list(roar).alias("roar_events"))
    o = o.withColumn("insufficient_signal", F.floor(F.col("window_start") / 3600) % 5 == 0)
    enough = sum((signals.sufficient(F.col(m)["value"], F.col(m)["n"], 3).cast("int") for m in signals.METRICS), F.lit(0))
    return o.select("window_start", enough.alias("sufficient_metrics"), signals.insufficient(3).alias("insufficient"), F.size("roar_events").alias("roars"), signals.keep_signal().alias("keep_signal"), (F.col("insufficient_signal") != signals.insufficient(3)).alias("flag_wrong"))


SQL["classified_records"] = SQL["classified_records"].replace("{rules}", CORE_SQL["rule_classification"])
