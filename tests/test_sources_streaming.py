"""Sources on small files, and streams run to their end."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from evidra import taxonomy
from evidra.operators.delivery import DeliveryStore
from evidra.sources import feeds, files
from evidra.streaming import incremental as inc


def pages(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page int, body string")


def test_feed(spark):
    rss = "<rss><item><title><![CDATA[A <b>x</b>]]></title><link>http://a</link><description>&lt;p&gt;d&lt;/p&gt;</description><pubDate>Mon, 1 Jan 2024 00:00:00 GMT</pubDate></item><item><title></title></item></rss>"
    atom = '<feed><entry><title>T</title><link href="http://b?x=1&amp;y"/><summary>s</summary><updated>2024</updated></entry></feed>'
    got = [tuple(r)[1:] for r in feeds.feed_items(pages(spark, rss, atom, None, ""), "body", ["page"]).orderBy("page", "pos").collect()]
    assert got == [(0, "A x", "http://a", "d", "Mon, 1 Jan 2024 00:00:00 GMT"), (0, "T", "http://b?x=1&y", "s", "2024")]


def test_listing(spark):
    a = lambda path, t: f'<a class="c" href="{path}">{t}</a>'
    html = a("/news-events/news/press-releases/2024/05/one", "<b>One</b>") + a("/news-events/news/press-releases/2024/05/one", "again") + a("https://x/news-events/news/press-releases/2013/01/two", "Two") + a("/other", "no") + a("/news-events/news/press-releases/2024/06/three", " ")
    got = [(r.url, r.year, r.month, r.title) for r in feeds.listing_items(pages(spark, html), "body", ["page"], "https://b").orderBy("pos").collect()]
    assert got == [("https://b/news-events/news/press-releases/2024/05/one", 2024, 5, "One"), ("https://x/news-events/news/press-releases/2013/01/two", 2013, 1, "Two")]
    link = pages(spark, '<a href="/f/old.xlsx">a</a><a href="/f/q1-2024.xlsx">b</a><a href="/f/q2-2023.csv">c</a>').select(feeds.data_file_link(F.col("body"), F.lit("https://h.x/p/q")).alias("u")).first().u
    assert link == "https://h.x/f/q2-2023.csv"


def test_json_pages(spark):
    p = pages(spark, json.dumps({"posts": [{"uri": "u", "author": {"handle": "h"}, "record": {"text": "t", "createdAt": "c"}}, {"uri": ""}]}), "not json")
    assert [tuple(r) for r in feeds.posts(p, "body", ["page"]).collect()] == [(0, "u", "t", "c")]
    h = pages(spark, json.dumps({"hits": [{"objectID": "1", "title": None, "comment_text": "&lt;p&gt;a&#x2F;b", "created_at_i": 5}, {"objectID": "2", "title": "T", "created_at_i": "x"}]}))
    assert [(r.object_id, r.text, r.created_at) for r in feeds.hits(h, "body", []).collect()] == [("1", "a/b", 5), ("2", "T", None)]
    e = pages(spark, json.dumps({"hits": {"hits": [{"_id": "0001-24-1:f.htm", "_source": {"ciks": ["0000012"], "display_names": ["N"], "file_date": "2024-01-01", "form": "8-K"}}]}}))
    assert [(r.accession, r.url, r.title) for r in feeds.filings(e, "body", []).collect()] == [("0001-24-1", "https://www.sec.gov/Archives/edgar/data/12/0001241/f.htm", "N | 8-K | 2024-01-01")]
    c = pages(spark, json.dumps({"filings": [{"id_submission": "9", "filers": [{"name": "Org"}], "proceedings": [{"name": "1"}, {"name": "2"}], "text_data": "<p>x</p>  y"}]}))
    assert [tuple(r) for r in feeds.comment_filings(c, "body", []).collect()] == [("9", "", "Org", "1, 2", "x y")]
    n = pages(spark, json.dumps({"articles": [{"url": "u", "title": "t", "seendate": "s"}, {"url": ""}]}))
    assert [tuple(r) for r in feeds.articles(n, "body", []).collect()] == [("t", "u", "", "s")]
    d = pages(spark, json.dumps({"results": [{"docket_absolute_url": "/d/1", "caseName": "A v. B"}, {"caseName": "none"}], "next": "https://elsewhere/"}))
    assert [(r.case_name, r.url) for r in feeds.dockets(d, "body", []).collect()] == [("A v. B", "https://www.courtlistener.com/d/1")]
    assert d.select(feeds.next_page(F.col("body")).alias("n")).first().n is None
    w = pages(spark, json.dumps([["timestamp", "original"], ["20240101", "http://a", "x", "200"], ["", "b"]]), "[]")
    assert [tuple(r) for r in feeds.captures(w, "body", []).collect()] == [("20240101", "http://a", "x", "200")]
    assert pages(spark, '{"0":{"cik_str":732,"ticker":"T","title":"X"}}').select(feeds.cik_of(F.col("body"), "t").alias("c")).first().c == "0000000732"


def test_csv_and_workbook(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Case ID,Nonconsumer,Claim Amt Business,Filing Date\r\n1,"Tellumo Communications, Corp.","1,200",02-JUN-21\r\n2,Other,5,\r\n,"Kestrelcom Mobility ""LLC""\nx",,\r\n')
    t = files.read_csv(spark, f"file://{tmp_path}/a.csv")
    got = files.arbitration_rows(t, "aaa", "a.csv", taxonomy.RESPONDENTS).orderBy("carrier").collect()
    assert [(r.carrier, r.record_date) for r in got] == [("kestrelcom", None), ("tellumo", 1622592000)]
    assert got[1].dedupe_key == "arb:aaa:1" and "claim amt business=1,200" in got[1].excerpt
    assert files.arbitration_rows(spark.createDataFrame([("x",)], "nothing string"), "aaa", "f", taxonomy.RESPONDENTS).count() == 0
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>Name</t></si><si><t>Ann</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>N</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row></sheetData></worksheet>')
    spark.dataSource.register(files.WorkbookSource)
    rows = spark.read.format("workbook").load(str(tmp_path))
    assert [r.cells for r in rows.orderBy("row").collect()] == [["Name", "", "N"], ["Ann", "", "7"]]
    assert [(r.a, r.c) for r in files.workbook_table(rows, ["a", "b", "c"]).collect()] == [("Ann", "7")]
    sniffed = files.sniff(spark.read.format("binaryFile").load(f"file://{tmp_path}")).collect()
    assert {r.path.rsplit("/", 1)[1]: r.is_workbook for r in sniffed} == {"a.csv": False, "w.xlsx": True}


def test_lines_and_payloads(spark):
    t = spark.createDataFrame([('{"a": 1}',), ("nope",), ("{bad",)], "line string")
    assert [r.a for r in files.json_lines(t, "line", "a int").collect()] == [1]
    jobs = spark.createDataFrame([(1, "parse_file", '{"provider":"x","v":1}'), (2, "parse_file", '{"provider":"x","v":2}'), (3, "parse_file", "{"), (4, "other", '{"provider":"y"}')], "id int, type string, payload string")
    assert [tuple(r) for r in files.latest_payloads(jobs).collect()] == [("x", '{"provider":"x","v":2}')]


def drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_append_new_over_runs(spark, tmp_path):
    src, out, chk = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/chk"
    drop(src, "1.json", [{"k": "a", "v": 1}, {"k": "a", "v": 2}])
    run = lambda: inc.append_new(inc.json_stream(spark, f"file://{src}", "k string, v int"), out, chk, ["k"], ["v"]).awaitTermination()
    run()
    drop(src, "2.json", [{"k": "a", "v": 3}, {"k": "b", "v": 4}])
    run()
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 4)]


def collect_stream(spark, df, tmp_path, mode):
    got = []
    q = df.writeStream.outputMode(mode).foreachBatch(lambda b, _: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return got


def test_windows_quota_watchdog(spark, tmp_path):
    src = tmp_path / "in"
    drop(src, "1.json", [{"k": "a", "t": "2024-01-01T00:00:10", "n": i, "ok": i not in (1, 2)} for i in range(5)])
    stream = lambda: inc.json_stream(spark, f"file://{src}", "k string, t timestamp, n int, ok boolean")
    w = collect_stream(spark, inc.windowed_counts(stream(), "t", ["k"]), tmp_path / "w", "update")
    assert [x[1:] for x in w] == [("a", 5)]
    assert collect_stream(spark, inc.quota(stream(), "k", 3), tmp_path / "q", "update") == [("a", 3, 2)]
    dog = collect_stream(spark, inc.watchdog(stream(), "k", "n", "ok"), tmp_path / "d", "append")
    assert [x[2:] for x in sorted(dog)] == [("STREAMING", 0), ("BRB", 6), ("BRB", 6), ("BRB", 6), ("BRB", 6)]  # back up, but not probed yet


def test_watchdog_probes_by_the_clock():
    seen = [(0, True), (10, False), (12, True), (15, False), (20, True), (25, False), (44, True), (45, True), (46, True), (50, False)]
    steps, *after = inc.watchdog_steps(seen, "STREAMING", 0, 0.0)
    assert steps == [("STREAMING", 0), ("BRB", 15), ("BRB", 15), ("BRB", 25), ("BRB", 25), ("BRB", 45), ("BRB", 45), ("RESUMING", 0), ("STREAMING", 0), ("BRB", 55)]
    assert inc.watchdog_steps(seen[5:], *inc.watchdog_steps(seen[:5], "STREAMING", 0, 0.0)[1:])[0] == steps[5:] and after == ["BRB", 0, 55]


def test_a_batch_again_changes_nothing(spark, tmp_path):
    b0 = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "k string, v int")
    b1 = spark.createDataFrame([("a", 4), ("b", 5), (None, 6)], "k string, v int")
    out, ok, bad, tot = (f"file://{tmp_path}/{x}" for x in ("out", "ok", "bad", "tot"))
    for n, b in ((0, b0), (0, b0), (1, b1), (1, b1)):
        inc.append_batch(b, n, out, ["k"], ["v"])
        inc.route_batch(b, n, F.col("v") > 2, ok, bad)
        inc.publish(b, tot, n)
    assert sorted(r.v for r in spark.read.parquet(out).collect()) == [1, 2, 3, 5, 6]
    assert sorted(r.v for r in spark.read.parquet(ok).collect()) == [3, 4, 5, 6] and sorted(r.v for r in spark.read.parquet(bad).collect()) == [1, 2]
    assert sorted(r.v for r in inc.published(spark, tot).collect()) == [4, 5, 6]


def test_a_swap_that_fails_keeps_the_table(spark, tmp_path, monkeypatch):
    from evidra.sources import sinks

    path = f"file://{tmp_path}/t"
    sinks.swap(spark.range(3), path)
    sinks.swap(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    rename = sinks._rename

    def fails(fs, a, b):  # noqa: ANN001, ANN202
        if ".new-" in a.toString():
            raise OSError("no")
        rename(fs, a, b)

    monkeypatch.setattr(sinks, "_rename", fails)
    with pytest.raises(OSError):
        sinks.swap(spark.range(9), path)
    assert spark.read.parquet(path).count() == 5 and sorted(x.name for x in tmp_path.iterdir()) == ["t"]


def test_totals_and_routes(spark, tmp_path):
    src = tmp_path / "in"
    drop(src, "1.json", [{"k": "a", "v": 1}, {"k": "a", "v": 2}, {"k": "b", "v": None}])
    stream = lambda: inc.json_stream(spark, f"file://{src}", "k string, v int")
    inc.additive_totals(stream(), "k", {"s": F.col("v")}, f"file://{tmp_path}/tot", f"file://{tmp_path}/c1").awaitTermination()
    assert {r.k: r.s for r in inc.published(spark, f"file://{tmp_path}/tot").collect()} == {"a": 3, "b": None}
    inc.route(stream(), F.col("v") > 1, f"file://{tmp_path}/ok", f"file://{tmp_path}/bad", f"file://{tmp_path}/c2").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/ok").count() == 1 and spark.read.parquet(f"file://{tmp_path}/bad").count() == 2


def test_deduplicated_stream(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    store = DeliveryStore(spark, f"file://{tmp_path}/store", words=64)
    run = lambda: inc.deduplicated(inc.json_stream(spark, f"file://{src}", "tbl string, id bigint, ident string, tb bigint"), store, out, f"file://{tmp_path}/chk").awaitTermination()
    drop(src, "1.json", [{"tbl": "t", "id": i, "ident": k, "tb": i // 2} for i, k in enumerate(["a", "b", "a", None])])
    run()
    drop(src, "2.json", [{"tbl": "t", "id": 10 + i, "ident": k, "tb": 9} for i, k in enumerate(["b", "c", "c"])])
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 11]


def test_sweep(spark):
    from evidra import session

    df, path = session.materialize(spark.range(3), "x")
    assert session.exists(spark, path) and df.count() == 3
    session.release(spark, path)
    assert not session.exists(spark, path)
