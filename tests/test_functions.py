"""Scalar functions and operators: the published examples, and a naive model."""

import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidra.functions import dates, money, text
from evidra.operators import amounts, diffs, linking, schedule, search, tables


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r.x for r in df.select("i", expr(F.col("c")).alias("x")).orderBy("i").collect()]


def test_dollars(spark):
    good = {"$1,234.56": 123456, "1234": 123400, "1,234": 123400, "0": 0, "$0.00": 0, "1234.5": 123450, "  42  ": 4200, "$ 12": 1200, "$1": 100, "\t7\n": 700, "$1,234.5": 123450}
    bad = ["", " ", "N/A", "-", "TBD", "1,23", "1 234", "-50", "$", "1.234", "12,34", "$1,23", "99999999999999999999", None]
    assert column(spark, [*good, *bad], money.parse_dollars) == [*good.values(), *[None] * len(bad)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.from_regex(re.compile(r"\$? ?[0-9,]{0,6}\.?[0-9]{0,3}", re.A), fullmatch=True), min_size=60, max_size=60))
def test_dollars_model(spark, cells):
    def model(c):
        m = re.fullmatch(r"\$?\s*(\d{1,3}(?:,\d{3})*|\d+)(?:\.(\d{1,2}))?", c.strip())
        return int(m[1].replace(",", "")) * 100 + int((m[2] or "").ljust(2, "0")) if m else None

    assert column(spark, cells, money.parse_dollars) == [model(c) for c in cells]


def test_buckets(spark):
    values = [-1, 0, 1, 2, 3, 4, 2_500_000, 2**22, 2**40]
    assert column(spark, values, money.amount_bucket, "bigint") == [0, 0, 1, 2, 2, 3, 22, 22, 22]


@pytest.mark.parametrize("values", [[10000, 20000, 40000, 80000, 160000], [0, 0, 0], [5], []])
def test_median_bound(spark, values):
    df = spark.createDataFrame([("k", v, None) for v in values] + [("k", None, 5)], "k string, c bigint, a bigint")
    r = amounts.tally(df, ["k"], "c", "a").select("cases", "capped_rows", amounts.median_cents().alias("m")).first()
    assert (r.cases, r.capped_rows) == (len(values) + 1, len(values))
    if not values:
        assert r.m is None
    else:
        exact = sorted(values)[len(values) // 2]
        assert abs(r.m - exact) <= max(1, 2 ** max(0, exact.bit_length() - 1))


def test_excerpt_fields(spark):
    e = ["Co | Claim Amt Consumer =$5; x=1; x=2", "no bar; x=9", "Co | claim amount consumer=7", "Co | y", ""]
    assert column(spark, e, lambda c: text.excerpt_field(c, money.CLAIM_KEYS)) == ["$5", None, "7", None, None]
    assert column(spark, e, lambda c: text.excerpt_field(c, ["x"])) == ["1", "9", None, None, None]


def test_terms(spark):
    t = ["Against Mobilewalla", "the t mobile store", "T MOBILE", "5g!", "x5g"]
    assert column(spark, t, lambda c: text.first_match(c, [("a", ["zzz"]), ("tm", ["t mobile"]), ("g", ["5g"])])) == [None, "tm", "tm", "g", None]


def test_markup(spark):
    assert column(spark, ["<![CDATA[a <b>x</b>]]> &amp;lt; &lt;i&gt;y&lt;/i&gt;"], text.strip_tags) == ["a x &lt; y"]
    page = "<p>A</p><script>z</script><p>A</p>\n<p>b &amp;  c</p><!-- q --><style>s</style>/x?cb=12 end"
    assert column(spark, [page], text.page_lines) == ["A\nb & c\n/x end"]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .!?\n", min_size=1, max_size=30), min_size=40, max_size=40))
def test_lossless(spark, texts):
    assert column(spark, texts, lambda c: F.array_join(text.sentences_lossless(c), "")) == texts


def test_dates(spark):
    s = ["02-JUN-21", "20-NOV-19", "2024-03-05", "3/5/2024", "", "not a date", "31-FEB-20", "02-JUN-2021", None]
    assert column(spark, s, dates.filing_date) == [1622592000, 1574208000, 1709596800, 1709596800, None, None, None, 1622592000, None]
    assert column(spark, ["20240501T120000Z", "20240501T120000", "x"], dates.compact_epoch) == [1714564800, 1714564800, None]
    assert column(spark, ["2024050112", "20240501", "x"], dates.capture_epoch) == [1714564800, 1714521600, 0]
    assert column(spark, [0, 1, 2, 6, 99], dates.backoff_seconds, "int") == [60, 60, 120, 1920, 3600]
    assert column(spark, ["2024-12"], lambda c: dates.add_months_ym(c, 2)) == ["2025-02"]


def test_small_texts(spark):
    assert column(spark, ["at://did:x/app.bsky.feed.post/3k", "http://x"], text.post_permalink) == ["https://bsky.app/profile/did:x/post/3k", None]
    assert column(spark, ["A story - The Paper"], lambda c: text.headline_source(c, F.lit("https://h.x/y"))) == ["The Paper"]
    assert column(spark, ["no source"], lambda c: text.headline_source(c, F.lit("https://h.x/y"))) == ["h.x"]
    assert column(spark, ["How many clawbacks?", "is it better", "why"], text.question_intent) == ["count", "trend", "topic"]
    assert column(spark, ["What about the CLAWBACK clawback of a 5g x"], text.question_tokens) == [["clawback", "5g"]]
    assert column(spark, ["say {\"a\": {}} ok", "none"], lambda c: text.json_span(c, "{", "}")) == ['{"a": {}}', None]
    assert len(column(spark, ["x" * 1000], text.capped)[0]) == 900


def test_diff():
    assert diffs.line_diff("a\nb\nc", "a\nc\nd").split("\n")[2:] == ["  a", "- b", "  c", "+ d"]
    assert diffs.line_diff("", "x") == "--- old\n+++ new\n+ x"
    big = "\n".join(str(i) for i in range(1000))
    assert "(coarse diff" in diffs.line_diff(big, big + "\nnew") and diffs.line_diff(big, big + "\nnew").endswith("+ new")


def test_diff_random():
    import random

    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.choice("xyz") for _ in range(rnd.randrange(8))] for _ in range(2))
        lines = diffs.line_diff("\n".join(a), "\n".join(b)).split("\n")[2:]
        assert [x[2:] for x in lines if x[0] in " -"] == a and [x[2:] for x in lines if x[0] in " +"] == b


def test_corroboration(spark):
    day = 86_400
    rows = [(1, "s1", "c", "i", None, 0), (2, "s2", "c", "i", None, 10 * day), (3, "s1", "c", "i", None, 900 * day), (4, "s1", "c", "j", None, 0), (5, "s1", "c", "j", None, day), (6, "s1", "c", "k", None, 0), (7, "s2", "c", "k", None, 91 * day), (8, None, "c", None, "p", 0), (9, "s", "c", None, "p", 90 * day), (10, "s2", None, "i", None, 0)]
    df = spark.createDataFrame(rows, "id bigint, source_id string, carrier string, alleged_issue string, promo_name string, ts bigint")
    assert sorted(r.id for r in linking.corroborated(df).collect()) == [1, 2, 3, 8, 9]


def test_partners_against_brute_force(spark):
    import random

    rnd = random.Random(2)
    rows = [(i, rnd.choice("ab"), rnd.randrange(5000)) for i in range(400)]
    got = {r.id: r.partners for r in linking.partners_within(spark.createDataFrame(rows, "id bigint, key string, ts bigint"), "key", "ts", 300).collect()}
    assert got == {i: sum(1 for j, k2, t2 in rows if j != i and k2 == k and abs(t - t2) <= 300) for i, k, t in rows}


def test_tables(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4), (None, 5), (None, 6)], "k string, v int")
    assert sorted(r.v for r in tables.insert_new(old, new, ["k"], ["v"]).collect()) == [3, 5, 6]
    assert tables.delete_keys(new, old, "k").count() == 4
    assert {r.k: r.v for r in tables.add_up(old, new.where("k is not null"), ["k"], ["v"]).collect()} == {"a": 3, "b": 7}


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([(1, "credit credit plan"), (2, "clawback plan"), (3, "plan plan"), (4, None), (5, "")], "id int, body string")
    q = spark.createDataFrame([(1, "clawback plan"), (2, "the")], "qid int, question string")
    got = [(r.qid, r.id) for r in search.top_documents(docs, "id", "body", q).orderBy("qid", "place").collect()]
    assert got[0] == (1, 2) and {g[0] for g in got} == {1}
    n, df, avg = 5, 1, 7 / 5
    score = math.log((n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / avg)) + 1e-6 * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / avg))
    assert search.top_documents(docs, "id", "body", q).where("id = 2").first().score == pytest.approx(score, abs=2e-6)


def test_schedule(spark):
    assert schedule.template_faults(schedule.TEMPLATE) == []
    assert schedule.template_faults([("a", 0, 10), ("b", 20, 10)])
    e = spark.createDataFrame([(0,), (29,), (30,), (3599,), (86_400 + 600,)], "t bigint")
    assert [r.slot_index for r in schedule.with_slot(e, "t").orderBy("t").collect()] == [0, 0, 1, 13, 2]
    ahead = schedule.slot_starts(spark.createDataFrame([(3500,)], "t bigint"), "t").orderBy("slot_start").collect()
    assert ahead[0].slot_start <= 3500 and ahead[-1].slot_start + ahead[-1].duration_s >= 4400
    slots = spark.createDataFrame([("c", t) for t in range(0, 20_000, 500)], "ch string, slot_start bigint")
    picks = [r.track_id for r in schedule.rotation(slots, "ch", [("a", True), ("b", False), ("c", False), ("d", True)]).orderBy("slot_start").collect()]
    assert picks[:4] == ["a", "b", "d", "c"] and len(picks) == 40


def test_model_stub(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    ok = schedule.classify_batches(df, "id", "t", lambda texts: [("l", 0.5) for _ in texts]).collect()
    assert {(r.label, r.confidence) for r in ok} == {("l", 0.5)}
    bad = schedule.classify_batches(df, "id", "t", lambda texts: 1 / 0).collect()
    assert {(r.label, r.confidence) for r in bad} == {(None, None)}
