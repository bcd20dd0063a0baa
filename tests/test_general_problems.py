"""Heavy keys, time texts and repeated deliveries: brute force on small fixtures, and the odd cases."""

import random
from collections import Counter
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from evidra.operators.delivery import DeliveryStore, delivery_rows, keepers, repeats
from evidra.operators.instants import InstantDictionary, normalise
from evidra.operators.treeagg import heavy_keys, tree_aggregate

RAW = "item bigint, raw string, zone string, date_order string"


# ---- tree aggregation ------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("chunk", "fan"), [(1, 2), (7, 3), (100_000, 16)])
def test_tree_equals_group_by(spark, chunk, fan):
    rnd = random.Random(chunk)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([1, 2, None])) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, v bigint").repartition(5)
    got = {r.k: (r.n, r.s, r.hi) for r in tree_aggregate(df, {"k": F.col("k")}, {"n": (F.lit(1), "sum"), "s": (F.col("v"), "sum"), "hi": (F.col("v"), "max")}, chunk_rows=chunk, fan_in=fan).collect()}
    want = {k: (sum(1 for x, _ in rows if x == k), sum(v or 0 for x, v in rows if x == k), 2) for k in ("a", "b", None)}
    assert got == want


def test_tree_odd_tables(spark):
    empty = spark.createDataFrame([], "node string, k0 string, m0 bigint")
    assert tree_aggregate(empty, {"node": F.col("node")}, {"n": (F.lit(1), "sum")}).count() == 0
    clash = spark.createDataFrame([("x", "y", 1), ("x", None, None)], "node string, k0 string, m0 bigint")  # names the operator uses itself
    assert [tuple(r) for r in tree_aggregate(clash, {"k0": F.col("node")}, {"m0": (F.col("m0"), "sum")}).collect()] == [("x", 1)]


def test_heavy_keys_border(spark):
    counts = spark.createDataFrame([("f", "a", 5), ("f", "b", 94), ("f", "c", 1), ("f", None, 900)], "field string, key string, n bigint")
    assert sorted(r.key_value for r in heavy_keys(counts, "field", "key", "n", 5).collect()) == ["a", "b"]


# ---- time texts ------------------------------------------------------------------------------------------------
def at(*parts, zone="UTC"):
    return int(datetime(*parts, tzinfo=ZoneInfo(zone)).timestamp())


CASES = [
    ("20200513T212149Z", "America/New_York", "mdy", at(2020, 5, 13, 21, 21, 49)),
    ("20200513T212149", "America/New_York", "mdy", at(2020, 5, 13, 21, 21, 49, zone="America/New_York")),
    ("20250126052537", "Europe/Berlin", "dmy", at(2025, 1, 26, 5, 25, 37, zone="Europe/Berlin")),
    ("1706918230", None, None, 1706918230),
    ("1706918230123", None, None, 1706918230),
    ("1706918230.9", None, None, 1706918230),
    ("1738741421845285", None, None, 1738741421),
    ("2023-12-26", "America/New_York", "mdy", at(2023, 12, 26)),
    (" 2018-11-08T02:26:27Z\n", "UTC", "ymd", at(2018, 11, 8, 2, 26, 27)),
    ("2019-08-04t07:54:01z", None, None, at(2019, 8, 4, 7, 54, 1)),
    ("2024-09-24T00:50:43+02:00", None, None, at(2024, 9, 23, 22, 50, 43)),
    ("2021-03-23T04:31:35.808-02:30", None, None, at(2021, 3, 23, 7, 1, 35)),
    ("2024-08-01T04:54:27.655+0530", None, None, at(2024, 7, 31, 23, 24, 27)),
    ("2022-04-30T16:04:45-07:00[America/Los_Angeles]", None, None, at(2022, 4, 30, 23, 4, 45)),
    ("2021-06-18 08:33:10 America/New_York", None, None, at(2021, 6, 18, 12, 33, 10)),
    ("2020-10-25 02:48:45 CEST", "Europe/Berlin", "dmy", at(2020, 10, 25, 0, 48, 45)),
    ("2024-09-30 13:32:43,143 UTC", None, None, at(2024, 9, 30, 13, 32, 43)),
    ("Sat, 18 Apr 2020 03:08:15 GMT", None, None, at(2020, 4, 18, 3, 8, 15)),
    ("Thu, 24 May 2018 01:33:59 -0400", None, None, at(2018, 5, 24, 5, 33, 59)),
    ("06/17/2023 10:05 PM", "America/New_York", "mdy", at(2023, 6, 17, 22, 5, zone="America/New_York")),
    ("04/01/2019 12:14 AM", "America/New_York", "mdy", at(2019, 4, 1, 0, 14, zone="America/New_York")),
    ("17/08/2021 08:17", "Europe/Berlin", "dmy", at(2021, 8, 17, 8, 17, zone="Europe/Berlin")),
    ("30.12.2021 16:41", "Europe/London", "dmy", at(2021, 12, 30, 16, 41)),
    ("24 Jun 2019 20:50 UTC", None, None, at(2019, 6, 24, 20, 50)),
    ("18-MAR-19", "America/Chicago", "mdy", at(2019, 3, 18)),
    ("Apr. 21, 2019", None, None, at(2019, 4, 21)),
    ("August 31, 2017", None, None, at(2017, 8, 31)),
    ("7 November 2021", None, None, at(2021, 11, 7)),
    ("4/12/20", "America/Phoenix", "mdy", at(2020, 4, 12)),
    ("4/12/20", "Europe/London", "dmy", at(2020, 12, 4)),
    ("20180502", "America/Chicago", "mdy", at(2018, 5, 2)),
    ("5/5/2021", None, None, at(2021, 5, 5)),  # one day in either order
    ("2024-02-29", None, None, at(2024, 2, 29)),
    # None of these denotes one instant.
    ("2024-10-27 02:33:02 Europe/Berlin", None, None, None),
    ("29/03/2020 01:08", "Europe/London", "dmy", None),
    ("03/13/2022 2:05 AM", "America/Los_Angeles", "mdy", None),
    ("2020/05/24 05:02", None, None, None),
    ("4/5/2021", None, None, None),
    ("2021-13-04", "UTC", "ymd", None), ("2022-06-31", "UTC", "ymd", None), ("2023-02-29", "UTC", "ymd", None), ("32/13/2022", "UTC", "ymd", None), ("0000-00-00", "UTC", "ymd", None),
    ("20240231T990000Z", "UTC", "ymd", None), ("2023-05-01T25:00:00Z", None, None, None), ("2023-05-01 10:00:00 XYZ", "UTC", "ymd", None), ("2023-05-01 10:00:00 Nowhere/Town", "UTC", "ymd", None),
    ("", "UTC", "ymd", None), ("  ", "UTC", "ymd", None), (None, "UTC", "ymd", None), ("T", "UTC", "ymd", None), ("yesterday", "UTC", "ymd", None), ("n/a", None, None, None), ("--", None, None, None), ("9" * 100_000, "UTC", "ymd", None),
]


def test_instants(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], RAW)
    got = {r.item: r.utc_second for r in normalise(df, ["item"]).collect()}
    assert {CASES[i][0][:60] if CASES[i][0] else None: got[i] for i in got if got[i] != CASES[i][3]} == {}
    assert len(got) == len(CASES)


def test_wall_clock_against_zoneinfo(spark):
    rnd, rows, want = random.Random(5), [], {}
    for i in range(400):
        zone = rnd.choice(["America/New_York", "Europe/Berlin", "Australia/Sydney", "America/St_Johns", "Australia/Lord_Howe", "Asia/Kolkata"])
        edge = rnd.choice([datetime(2021, 3, 14), datetime(2021, 10, 31), datetime(2021, 4, 4), datetime(2021, 11, 7), datetime(2021, 10, 3), datetime(2022, 6, 1)])
        t = edge.replace(hour=rnd.randrange(4), minute=rnd.randrange(60))
        seen = set()
        for fold in (0, 1):
            u = t.replace(tzinfo=ZoneInfo(zone), fold=fold).astimezone(timezone.utc)
            if u.astimezone(ZoneInfo(zone)).replace(tzinfo=None) == t:
                seen.add(int(u.timestamp()))
        rows.append((i, t.strftime("%Y-%m-%d %H:%M:00"), zone, "ymd"))
        want[i] = seen.pop() if len(seen) == 1 else None
    assert {r.item: r.utc_second for r in normalise(spark.createDataFrame(rows, RAW), ["item"]).collect()} == want


def test_dictionary_grows_by_new_texts_only(spark, tmp_path):
    d = InstantDictionary(spark, f"file://{tmp_path}/dict")
    one = spark.createDataFrame([(1, "2020-01-01", "UTC", "ymd"), (2, "2020-01-01", "UTC", "ymd"), (3, None, None, None)], RAW)
    two = spark.createDataFrame([(4, "2020-01-01", "UTC", "ymd"), (5, "2020-01-02", "UTC", "ymd"), (6, "2020-01-01", "UTC", "dmy")], RAW)
    assert d.update(one) == 1
    assert d.update(two) == 3
    assert d.update(two) == 3
    assert {r.item: r.utc_second for r in d.apply(two, ["item"]).collect()} == {4: 1577836800, 5: 1577923200, 6: 1577836800}


def test_instants_odd_tables(spark):
    assert normalise(spark.createDataFrame([], RAW), ["item"]).count() == 0
    many = spark.createDataFrame([(i, "2020-01-01 10:00" if i % 3 else None, "UTC", "ymd") for i in range(3000)], RAW).withColumn("utc_second", F.lit("x")).withColumn("__key", F.lit(1))
    got = normalise(many, ["item"])
    assert Counter(r.utc_second for r in got.collect()) == {1577872800: 2000, None: 1000}


# ---- repeated deliveries ---------------------------------------------------------------------------------------
def brute(rows):
    first, out = {}, set()
    for i, key, _ in sorted(rows):
        if key is None:
            continue
        k = key.strip()
        head, colon, tail = k.partition(":")
        k = head.lower() + colon + tail if colon else k
        if k in first:
            out.add(i)
        else:
            first[k] = i
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([None, "", "HOT:1", "hot:1", f"a:{rnd.randrange(60)}", f" A:{rnd.randrange(60)}\n", f"\tx{rnd.randrange(40)}"]), rnd.choice([None, 0, 50, 10_000, -7])) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, key string, at bigint").withColumn("tb", F.lit("clash")).withColumn("ident", F.lit(0))
    d = delivery_rows(df, "t", "id", "key", "at", 100)
    assert {r.id for r in repeats(d).collect()} == brute(rows)
    keep = [r.id for r in keepers(d).collect()]
    assert len(keep) == len(set(keep)) and set(keep) == {i for i, k, _ in rows if k is not None} - brute(rows)


def test_tables_do_not_mix_and_empty(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1)], "id bigint, key string, at bigint")
    both = delivery_rows(df, "x", "id", "key", "at", 10).union(delivery_rows(df, "y", "id", "key", "at", 10))
    assert sorted((r.tbl, r.id) for r in repeats(both).collect()) == [("x", 2), ("y", 2)]
    assert repeats(delivery_rows(df.limit(0), "x", "id", "key", "at", 10)).count() == 0
    long = spark.createDataFrame([(1, "k" * 200_000, 1), (2, "K" * 200_000, 1), (3, "k" * 200_000, 900)], "id bigint, key string, at bigint")
    assert [r.id for r in repeats(delivery_rows(long, "x", "id", "key", "at", 10)).collect()] == [3]


def test_many_buckets_on_both_sides_of_a_slice(spark):
    rnd = random.Random(4)
    rows = [(i, f"k{rnd.randrange(200)}", rnd.randrange(-4, 70)) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, key string, at bigint")
    assert {r.id for r in repeats(delivery_rows(df, "t", "id", "key", "at", 1)).collect()} == brute(rows)


def test_only_the_buckets_in_question_are_read(spark, tmp_path):
    from evidra.operators import delivery

    df = spark.createDataFrame([(i, f"k{i}", i) for i in range(50)], "id bigint, key string, at bigint")
    path = f"file://{tmp_path}/storage"
    delivery.store(delivery_rows(df, "t", "id", "key", "at", 10), path)
    some = delivery.stored(spark, path, "bigint", [("t", 1), ("t", 3)])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "PartitionFilters: [" in plan
    assert sorted(r.id for r in some.collect()) == [*range(10, 20), *range(30, 40)]
    index = delivery.hash_index(delivery.stored(spark, path, "bigint"))
    placed = delivery.with_words(index, {"t": 64})
    hits = delivery.screen(placed, delivery.sliced_filters(placed))
    assert "ident" not in hits._jdf.queryExecution().executedPlan().toString()


def test_store_over_batches(spark, tmp_path):
    rnd = random.Random(8)
    store, seen, n = DeliveryStore(spark, f"file://{tmp_path}/store", words=64), set(), 0
    for batch in range(4):
        rows = [(n + i, rnd.choice([None, f"k{rnd.randrange(80)}"]), rnd.randrange(400)) for i in range(60)]
        n += 60
        df = delivery_rows(spark.createDataFrame(rows, "id bigint, key string, at bigint"), "t", "id", "key", "at", 100)
        want = {}
        for i, key, _ in rows:
            if key is not None and key not in seen and key not in want:
                want[key] = i
        assert sorted(r.id for r in store.ingest(df, f"b{batch}").collect()) == sorted(want.values()), batch
        assert sorted(r.id for r in store.ingest(df, f"b{batch}").collect()) == sorted(want.values())  # the same batch again
        seen |= set(want)


def test_four_digit_years_stand_as_written(spark):
    from evidra.operators import instants

    want = {"2015-03-01T00:00:00Z": 1425168000, "1 Mar 1999 10:00 UTC": 920282400, "25/12/2040": 2240006400, "20300101": 1893456000, "1 Mar 99": None, "1000000000": None}
    df = spark.createDataFrame([(t, None, "dmy") for t in want], "raw string, zone string, date_order string")
    assert {r.raw: r.utc_second for r in instants.parse_texts(df).collect()} == want
