"""Collectors, sinks, as-of joins, signals and row checks on small inputs."""

from pyspark.sql import functions as F

from evidra.functions import signals
from evidra.operators import asof, quality
from evidra.sources import collectors, feeds, sinks


def test_feed_records(spark):
    items = spark.createDataFrame([(0, "Tellumo settles", "http://a", "about credits", "Mon, 1 Jan 2024 00:00:00 GMT"), (1, "Weather", "http://b", "rain", None), (2, "Mobile carriers warned", "http://c", "", "x"), (3, "Tellumo", "", "", None)], "pos int, title string, link string, description string, pub_date string")
    got = {r.dedupe_key: (r.record_date, r.excerpt, r.carrier) for r in collectors.press_feed(items, "ftc", "ftc").collect()}
    assert got == {"ftc:http://a": (1704067200, "Tellumo settles - about credits", "tellumo"), "ftc:http://c": (None, "Mobile carriers warned", None)}
    assert collectors.press_feed(items, "ftc", "ftc", wide=False).count() == 1
    news = {r.dedupe_key: r.excerpt for r in collectors.news_feed(items).collect()}
    assert news["news:google:http://b"] == "Weather | b" and len(news) == 3


def test_listing_shares_the_feed_key(spark):
    html = '<a href="/news-events/news/press-releases/2024/05/one">Tellumo pays</a><a href="/news-events/news/press-releases/2019/05/old">Tellumo paid</a>'
    items = feeds.listing_items(spark.createDataFrame([(html,)], "body string"), "body", [], "https://b")
    got = collectors.press_listing(items, "ftc", "ftc", (2020, 1)).collect()
    assert [(r.dedupe_key, r.record_date) for r in got] == [("ftc:https://b/news-events/news/press-releases/2024/05/one", 1714521600)]


def test_filers(spark):
    names = spark.createDataFrame([("Acme, Inc.",), ("Ann Lawson",), ("Jo Grouper on behalf of X",), ("City of Ansel",), (None,), ("Ann (Group)",)], "n string")
    assert [r.o for r in names.select(collectors.is_organization(F.col("n")).alias("o")).collect()] == [True, False, True, True, False, True]
    f = spark.createDataFrame([("1", "2024-02-01T00:00:00Z", "Ann Lee", "21-1", "my bill credit"), ("2", "2024-02-02", "Acme LLC", "", "text"), ("3", "2023-01-01", "Acme LLC", "", "text")], "id string, date_received string, filer_name string, proceedings string, snippet string")
    got = {r.dedupe_key: r.excerpt for r in collectors.comment_records(f, "2024-01-01").collect()}
    assert set(got) == {"ecfs:1", "ecfs:2"} and "Ann" not in got["ecfs:1"] and "my bill" not in got["ecfs:1"] and "bill_credit" in got["ecfs:1"] and got["ecfs:2"].startswith("Acme LLC | ECFS 2 | proceeding n/a")


def test_complaints_and_stories(spark):
    c = spark.createDataFrame([("7", "2024-01-02T00:00:00", "Phone", "Billing", "A", "CA", "1"), (None, "2024-01-03", "Phone", None, None, "NV", None), ("8", "2024", "Internet", "x", "y", "z", "w")], "id string, ticket_created string, issue_type string, issue string, city string, state string, zip string")
    assert {r.dedupe_key for r in collectors.complaint_rows(c).collect()} == {"socrata:7", "socrata:2024-01-03::NV:"}
    assert collectors.next_cursor(c, "ticket_created", "2024-01-02").first().cursor == "2024-01-03" and collectors.next_cursor(c.limit(0), "ticket_created", "x").first().cursor == "x"
    s = spark.createDataFrame([("  " + "long enough a story here", "on", "tellumo", " C ", "ca", "1234", ""), ("short", "on", None, None, None, None, None), ("x" * 50, None, None, None, None, None, None), ("y" * 9000, "on", "nobody", "", "C1", "12345", "me")], "what_happened string, agree string, carrier string, city string, state string, zip string, contact string")
    got = sorted(((r.carrier, r.city, r.state, r.zip, r.contact, len(r.what_happened)) for r in collectors.story_submissions(s, ["tellumo"]).collect()), key=str)
    assert got == [("tellumo", "C", "CA", None, None, 24), (None, None, None, "12345", "me", 8000)] or got == [(None, None, None, "12345", "me", 8000), ("tellumo", "C", "CA", None, None, 24)]


def test_small_helpers(spark):
    assert collectors.search_phrases(["A"], ["x", "y", "z"]) == ['"A" "x"', '"A" "y"'] and collectors.rotate([1, 2, 3], 2, 2) == [3, 1] and collectors.rotate([], 1) == []
    h = spark.createDataFrame([("120",), ("Mon, 1 Jan 2024 00:00:10 GMT",), ("soon",), (None,)], "h string")
    assert [r.w for r in h.select(collectors.retry_wait_ms(F.col("h"), F.lit(1704067200000)).alias("w")).collect()][:2] == [120000, 10000]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v int")
    sinks.write_documents(df, f"file://{tmp_path}/docs", "k")
    assert spark.read.json(f"file://{tmp_path}/docs").where("k = 'a'").count() == 2
    sinks.write_document(df, f"file://{tmp_path}/one")
    assert spark.read.json(f"file://{tmp_path}/one").count() == 3
    sinks.swap(df, f"file://{tmp_path}/t/table")
    sinks.swap(df.limit(1), f"file://{tmp_path}/t/table")
    assert spark.read.parquet(f"file://{tmp_path}/t/table").count() == 1
    assert sorted((r.v, r.id) for r in sinks.with_ids(df, "v", first=10).collect()) == [(1, 10), (2, 11), (3, 12)]
    assert sinks.with_ids(df.limit(0), "v").count() == 0


def test_as_of(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 5), (3, "b", 7), (4, None, 1)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 9, "y"), ("a", 11, "z"), ("b", 8, "w")], "k string, t int, v string")
    assert {r.id: r.v for r in asof.as_of(left, right, "k", "t", "t", ["v"]).collect()} == {1: "y", 2: "x", 3: None, 4: None}
    options = [spark.createDataFrame([("a", "one")], "k string, item string"), spark.createDataFrame([("a", "two"), ("b", "evergreen")], "k string, item string")]
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert {r.k: r.item for r in asof.first_available(keys, "k", options, "item", "standing").collect()} == {"a": "one", "b": "evergreen", "c": "standing"}


def test_signals(spark):
    df = spark.createDataFrame([(0.5, 10, 15.0), (2.0, 5, 99.0), (0.5, 4, 15.0), (None, 10, 1.0)], "s double, n int, v double")
    got = [tuple(r.m) for r in df.select(signals.mood(F.col("s"), F.col("n"), F.col("v")).alias("m")).collect()]
    assert got[0] == (0.5, 0.5, 95, 115, 1, 1, False) and got[1] == (1.0, 1.0, 130, 150, 2, 2, False) and got[2][-1] and got[3][-1]
    raw = spark.createDataFrame([('ok {"carrier": "tellumo", "confidence": 3, "rationale": "r"} end',), ('{"carrier": "x"}',), ("none",), (None,)], "r string")
    assert [tuple(r.m) for r in raw.select(signals.model_label(F.col("r"), ["tellumo"]).alias("m")).collect()] == [("tellumo", 1.0, "r"), (None, 0.0, ""), (None, 0.0, ""), (None, 0.0, "")]
    n = spark.createDataFrame([(2024.0,), (1704067200.0,), (1704067200000.0,), (5.0,), (None,)], "n double")
    assert [r.d for r in n.select(signals.loose_date(F.col("n")).alias("d")).collect()] == ["2024", "2024-01-01", "2024-01-01", "5", None]
    c = spark.createDataFrame([("0.8",), ("x",), (None,), ("Infinity",)], "c string")
    assert [r.v for r in c.select(signals.number_or(F.col("c"), 0.7).alias("v")).collect()] == [0.8, 0.7, 0.7, 0.7]
    g = spark.createDataFrame([(404, None), (200, '{"deleted": true}'), (200, "{}"), (500, None)], "s int, b string")
    assert [r.g for r in g.select(signals.item_gone(F.col("s"), F.col("b")).alias("g")).collect()] == [True, True, False, False]


def test_checks(spark):
    s = spark.createDataFrame([("It cost $5.", "paid $5"), ("", "x"), ("A — b. C. D. 7", None)], "t string, src string")
    assert [r.f for r in s.select(quality.summary_faults(F.col("t"), F.col("src")).alias("f")).collect()] == [[], ["empty"], ["dash", "more than two sentences", "number without source"]]
    line = spark.createDataFrame([("co", "hi", 0.5, None), ("x", "", 2.0, 9.0)], "sp string, t string, e double, p double")
    assert [r.f for r in line.select(quality.line_faults(F.col("sp"), F.col("t"), F.col("e"), F.col("p"), ["co"]).alias("f")).collect()] == [[], ["speaker", "text", "emotion", "pace"]]
    t = spark.createDataFrame([("bill credit", ["A Bill Credit here"]), ("one two three four five", ["x"])], "t string, e array<string>")
    assert [r.f for r in t.select(quality.term_faults(F.col("t"), F.col("e")).alias("f")).collect()] == [[], ["more than four words", "in no excerpt"]]
    runs = spark.createDataFrame([("g", i, v) for i, v in enumerate("aaabbaaaa")], "g string, i int, v string")
    assert sorted(r.i for r in quality.repeated_runs(runs, "g", "i", "v").collect()) == [2, 7]
    g = spark.createDataFrame([("a", 0, 5), ("a", 5, 5), ("a", 11, 1)], "k string, s int, l int")
    assert [(r.s, r.expected) for r in quality.gaps(g, "k", "s", "l").collect()] == [(11, 10)]


def test_links_and_queues(spark):
    from evidra.functions import links
    from evidra.operators import queues

    one = spark.createDataFrame([("20240101", "http://a", 2)], "s string, o string, p int")
    r = one.select(links.capture_link(F.col("s"), F.col("o")).alias("a"), links.capture_link(F.col("s"), F.col("o"), raw=True).alias("b"), links.list_page("http://l", F.col("p")).alias("c"), links.query_link("http://q", q=F.lit("a b"), n=F.lit("1")).alias("d")).first()
    assert tuple(r) == ("https://web.archive.org/web/20240101/http://a", "https://web.archive.org/web/20240101id_/http://a", "http://l?page=2", "http://q?q=a+b&n=1")
    jobs = spark.createDataFrame([(1, "pending", 0, 5), (2, "pending", 0, 50), (3, "pending", 4, 1), (4, "done", 1, 0)], "id int, status string, attempts int, scheduled_at bigint")
    claimed = queues.claim(jobs, 10, 5)
    assert {x.id: (x.status, x.attempts) for x in claimed.collect()} == {1: ("claimed", 1), 2: ("pending", 0), 3: ("claimed", 5), 4: ("done", 1)}
    res = spark.createDataFrame([(1, "e"), (3, "e"), (4, "e")], "id int, error string")
    assert {x.id: (x.status, x.scheduled_at) for x in queues.finish(claimed, res, 100).collect()} == {1: ("pending", 160), 2: ("pending", 50), 3: ("dead", 1), 4: ("done", 0)}
    assert {x.status: x.n for x in queues.depths(jobs).collect()} == {"pending": 3, "claimed": 0, "done": 1, "dead": 0}
    assert [x.id for x in queues.newest_of([jobs, jobs.select("id", "scheduled_at")], "scheduled_at", 1).collect()] == [2]
    asked = spark.createDataFrame([("t", 3), ("t", 1), ("u", 2), ("", 0)], "item string, at int")
    assert sorted((x.item, x["at"]) for x in queues.first_requests(asked, "item", "at").collect()) == [("t", 1), ("u", 2)]
