"""Parsers of the documents collectors fetch: one text column in, typed rows out. JVM-side expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.text import decode_entities, squeeze, strip_tags


def _tag(block: Column, tag: str) -> Column:
    return F.regexp_extract(block, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)


def _first(*options: Column) -> Column:
    """The first that is not empty, else the empty text."""
    return F.coalesce(*(F.when(o != "", o) for o in options), F.lit(""))


def feed_items(pages: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """RSS items and Atom entries of feed texts: (*keep, pos, title, link, description, pub_date); items with neither title nor link are none."""
    blocks = F.regexp_extract_all(F.col(text), F.lit(r"(?is)<(?:item|entry).*?</(?:item|entry)>"), F.lit(0))
    b = F.col("block")
    df = pages.select(*keep, F.posexplode(blocks).alias("pos", "block"))
    link = squeeze(_tag(b, "link"))
    href = F.regexp_extract(b, r'(?i)<link[^>]*href="([^"]+)"', 1)
    date = _first(strip_tags(_tag(b, "pubDate")), strip_tags(_tag(b, "updated")))
    out = df.select(
        *keep, "pos", strip_tags(_tag(b, "title")).alias("title"), decode_entities(_first(link, href)).alias("link"),
        strip_tags(_first(_tag(b, "description"), _tag(b, "summary"), _tag(b, "content"))).alias("description"), F.when(date != "", date).alias("pub_date"),
    )
    return out.where((F.col("title") != "") | (F.col("link") != ""))


def listing_items(pages: DataFrame, text: str, keep: list[str], base: str = "https://www.ftc.gov") -> DataFrame:
    """Press releases of listing pages: (*keep, pos, url, year, month, title); the first anchor of a URL counts, even if it is untitled."""
    rx = r'(?is)<a[^>]+href="([^"]*/news-events/news/press-releases/(\d{4})/(\d{2})/[^"?#]+)"[^>]*>(.*?)</a>'
    anchors = F.regexp_extract_all(F.col(text), F.lit(rx), F.lit(0))
    one = lambda a: F.struct(F.regexp_extract(a, rx, 1).alias("h"), F.regexp_extract(a, rx, 2).alias("y"), F.regexp_extract(a, rx, 3).alias("m"), squeeze(F.regexp_replace(F.regexp_extract(a, rx, 4), r"<[^>]+>", " ")).alias("t"))
    parsed = F.transform(anchors, lambda a: one(a))
    urls = F.transform("__a", lambda x: F.when(x["h"].startswith("http"), x["h"]).otherwise(F.concat(F.lit(base), x["h"])))
    df = pages.select(*keep, parsed.alias("__a")).withColumn("__u", urls)
    df = df.select(*keep, "__u", F.posexplode("__a").alias("pos", "x"))
    url = F.element_at("__u", F.col("pos") + 1)
    df = df.withColumn("url", url).where((F.array_position("__u", F.col("url")) == F.col("pos") + 1) & (F.col("x.t") != ""))
    return df.select(*keep, "pos", "url", F.col("x.y").cast("int").alias("year"), F.col("x.m").cast("int").alias("month"), F.col("x.t").alias("title"))


def data_file_link(html: Column, base: Column) -> Column:
    """The last .xlsx, .xls or .csv address of a page, of those with a year 20dd if any; null without one."""
    hrefs = F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]+\.(?:xlsx|xls|csv)[^"]*)"'), F.lit(1))
    dated = F.filter(hrefs, lambda h: h.rlike(r"20\d\d"))
    best = F.array_max(F.when(F.size(dated) > 0, dated).otherwise(hrefs))
    origin = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    return F.when(best.startswith("http"), best).when(best.startswith("/"), F.concat(origin, best)).otherwise(F.concat(F.regexp_replace(base, r"[^/]*$", ""), best))


def posts(pages: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Posts of a social search: (*keep, uri, text, created_at). Authors are never read."""
    schema = "posts array<struct<uri:string, record:struct<text:string, createdAt:string>>>"
    p = pages.select(*keep, F.explode(F.from_json(F.col(text), schema)["posts"]).alias("p"))
    return p.where(F.coalesce("p.uri", F.lit("")) != "").select(*keep, "p.uri", F.coalesce("p.record.text", F.lit("")).alias("text"), F.coalesce("p.record.createdAt", F.lit("")).alias("created_at"))


def hits(pages: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Items of an item search: (*keep, object_id, text, created_at); the text is the title, else the comment, else the story."""
    schema = "hits array<struct<objectID:string, title:string, comment_text:string, story_text:string, created_at_i:string, url:string>>"
    h = pages.select(*keep, F.explode(F.from_json(F.col(text), schema)["hits"]).alias("h"))
    body = _first(F.col("h.title"), F.col("h.comment_text"), F.col("h.story_text"))
    for a, b in (("&#x2F;", "/"), ("&#x27;", "'")):
        body = F.replace(body, F.lit(a), F.lit(b))
    return h.where(F.coalesce("h.objectID", F.lit("")) != "").select(*keep, F.col("h.objectID").alias("object_id"), strip_tags(body).alias("text"), F.when(F.col("h.created_at_i").rlike(r"^\d+$"), F.col("h.created_at_i")).cast("bigint").alias("created_at"), "h.url")


def filings(pages: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Filing search hits: (*keep, accession, url, title, file_date, cik)."""
    schema = "hits struct<hits: array<struct<_id:string, _source:struct<ciks:array<string>, display_names:array<string>, file_date:string, form:string, file_type:string>>>>"
    h = pages.select(*keep, F.explode(F.from_json(F.col(text), schema)["hits"]["hits"]).alias("h"))
    acc, name = F.substring_index("h._id", ":", 1), F.when(F.contains("h._id", F.lit(":")), F.split("h._id", ":")[1]).otherwise("")
    cik = F.coalesce(F.get("h._source.ciks", F.lit(0)), F.lit(""))
    plain = F.regexp_replace(cik, "^0+", "")
    parts = F.array(F.array_join("h._source.display_names", ", "), F.coalesce("h._source.form", "h._source.file_type"), F.col("h._source.file_date"))
    title = F.array_join(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), " | ")
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.when(plain != "", plain).otherwise(cik), F.lit("/"), F.replace(acc, F.lit("-"), F.lit("")), F.lit("/"), name)
    return h.where(F.coalesce(acc, F.lit("")) != "").select(*keep, acc.alias("accession"), url.alias("url"), title.alias("title"), F.coalesce("h._source.file_date", F.lit("")).alias("file_date"), cik.alias("cik"))


def cik_of(tickers: Column, ticker: str) -> Column:
    """The 10-digit number of a ticker in the text of a ticker file, else null."""
    n = F.regexp_extract(tickers, rf'(?i)"cik_str":(\d+),"ticker":"{ticker}"', 1)
    return F.when(n != "", F.lpad(n, 10, "0"))


def comment_filings(pages: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Comment filings: (*keep, id, date_received, filer_name, proceedings, snippet)."""
    schema = "filings array<struct<id_submission:string, id:string, date_received:string, filers:array<struct<name:string>>, proceedings:array<struct<name:string>>, text_data:string, brief_comment_text:string>>"
    f = pages.select(*keep, F.explode(F.from_json(F.col(text), schema)["filings"]).alias("f"))
    names = F.filter("f.proceedings.name", lambda x: F.coalesce(x, F.lit("")) != "")
    body = squeeze(F.regexp_replace(F.coalesce("f.text_data", "f.brief_comment_text", F.lit("")), r"<[^>]+>", " "))
    ident = F.coalesce("f.id_submission", "f.id", F.lit(""))
    return f.where(ident != "").select(*keep, ident.alias("id"), F.coalesce("f.date_received", F.lit("")).alias("date_received"), F.coalesce(F.get("f.filers.name", F.lit(0)), F.lit("")).alias("filer_name"), F.coalesce(F.array_join(names, ", "), F.lit("")).alias("proceedings"), F.substring(body, 1, 280).alias("snippet"))


def articles(pages: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """News articles: (*keep, title, url, domain, seendate)."""
    a = pages.select(*keep, F.explode(F.from_json(F.col(text), "articles array<struct<url:string, title:string, domain:string, seendate:string>>")["articles"]).alias("a"))
    text_of = lambda c: F.coalesce(f"a.{c}", F.lit("")).alias(c)
    return a.where(F.coalesce("a.url", F.lit("")) != "").select(*keep, text_of("title"), text_of("url"), text_of("domain"), text_of("seendate"))


def dockets(pages: DataFrame, text: str, keep: list[str], host: str = "https://www.courtlistener.com") -> DataFrame:
    """Docket search results: (*keep, case_name, court, date_filed, docket_number, url)."""
    schema = "results array<struct<docket_absolute_url:string, absolute_url:string, caseName:string, case_name_full:string, court:string, court_id:string, dateFiled:string, docketNumber:string>>"
    r = pages.select(*keep, F.explode(F.from_json(F.col(text), schema)["results"]).alias("r"))
    at = _first(F.col("r.docket_absolute_url"), F.col("r.absolute_url"))
    url = F.when(at.startswith("http"), at).when(at != "", F.concat(F.lit(host), at)).otherwise("")
    pick = lambda name, *cs: F.coalesce(*(f"r.{c}" for c in cs), F.lit("")).alias(name)
    return r.where(at != "").select(*keep, pick("case_name", "caseName", "case_name_full"), pick("court", "court", "court_id"), pick("date_filed", "dateFiled"), pick("docket_number", "docketNumber"), url.alias("url"))


def next_page(text: Column, host: str = "https://www.courtlistener.com/") -> Column:
    """The address of a search's next page if it stays on the host, else null."""
    n = F.get_json_object(text, "$.next")
    return F.when(n.startswith(host), n)


def captures(pages: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Capture index rows: (*keep, timestamp, original, digest, status); the first row is the header."""
    rows = F.from_json(F.col(text), "array<array<string>>")
    c = pages.select(*keep, F.explode(F.when(F.size(rows) > 1, F.slice(rows, 2, 1_000_000_000))).alias("c"))
    at = lambda i, name: F.coalesce(F.get("c", F.lit(i)), F.lit("")).alias(name)
    return c.select(*keep, at(0, "timestamp"), at(1, "original"), at(2, "digest"), at(3, "status")).where("timestamp <> '' and original <> ''")
