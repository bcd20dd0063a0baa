"""Percentiles, components, packing and mixing against brute force, and the odd cases."""

import random

import pytest
from pyspark.sql import functions as F

from evidra.llm import components, mixing, packing, quantiles, tokens
from evidra.llm.maxent import fit


# ---- percentiles -----------------------------------------------------------------------------------------------
def exact(values, p):
    v = sorted(values)
    return v[max(1, -(-len(v) * p // 100)) - 1]


@pytest.mark.parametrize("levels", [1, 3, 6])
def test_percentiles_against_sort(spark, levels):
    rnd = random.Random(levels)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, 0, 5, 5, -3, rnd.randrange(10**12), rnd.randrange(100)])) for _ in range(400)] + [("one", 7), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v bigint").withColumn("k0", F.lit("x")).withColumn("p", F.lit(1)).withColumn("lo", F.lit(2))
    got = {(r.g, r.percentile): (r.value, r.n) for r in quantiles.exact_percentiles(df, ["g"], "v", [1, 50, 90, 100], levels=levels).collect()}
    want = {}
    for g in {g for g, v in rows if v is not None}:
        own = [v for x, v in rows if x == g and v is not None]
        want |= {(g, p): (exact(own, p), len(own)) for p in (1, 50, 90, 100)}
    assert got == want


def test_percentiles_by_shuffled_intervals(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BROADCAST_INTERVALS", 0)
    rows = [(i % 7, i * i) for i in range(500)]
    got = {r.g: r.value for r in quantiles.exact_percentiles(spark.createDataFrame(rows, "g bigint, v bigint"), ["g"], "v", [50]).collect()}
    assert got == {g: exact([v for x, v in rows if x == g], 50) for g in range(7)}


def test_percentiles_empty_and_weights(spark):
    assert quantiles.exact_percentiles(spark.createDataFrame([], "g string, v bigint"), ["g"], "v", [50]).count() == 0
    df = spark.createDataFrame([(1, 10, 3), (1, 20, 1), (1, 30, 1)], "g int, v bigint, w bigint")
    assert quantiles.exact_percentiles(df, ["g"], "v", [50, 80], weight="w").orderBy("percentile").collect()[1].value == 20


def test_buckets_and_bounds(spark):
    values = [-5, 0, 1, 127, 128, 129, 255, 256, 10**6, 2_500_000, 6_140_006_805_297]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").withColumn("b", quantiles.bucket_of(F.col("v")))
    low, high = quantiles.bucket_bounds(F.col("b"))
    got = df.select("v", "b", low.alias("lo"), high.alias("hi")).orderBy("v").collect()
    assert [r.b for r in got] == sorted(r.b for r in got)
    assert all(r.lo <= r.v <= r.hi and r.hi - r.lo <= max(0, r.lo >> quantiles.BITS) for r in got if r.v >= 0)


def test_negative_values_in_states(spark):
    rnd = random.Random(8)
    rows = [(d, "a", rnd.randrange(-(10**6), 10**5)) for d in range(4) for _ in range(60)] + [(0, "a", -(2**60)), (1, "a", -1), (2, "a", 0)]
    df = spark.createDataFrame(rows, "day int, g string, v bigint")
    states = quantiles.combine(quantiles.day_states(df, "day", ["g"], "v"), ["g"])
    for r in quantiles.state_percentiles(states, ["g"], [1, 10, 50, 90, 99]).collect():
        v = exact([v for _, _, v in rows], r.percentile)
        assert r.value_low <= v <= r.value_high and r.value_high - r.value_low <= abs(v) / 128


def test_days_combine(spark):
    rnd = random.Random(4)
    rows = [(d, rnd.choice("ab"), rnd.randrange(1, 10**6)) for d in range(6) for _ in range(80)]
    df = spark.createDataFrame(rows, "day int, g string, v bigint")
    days = quantiles.day_states(df, "day", ["g"], "v")
    got = {r.g: r for r in quantiles.state_percentiles(quantiles.combine(days.where("day >= 2"), ["g"]), ["g"], [50]).collect()}
    for g in "ab":
        own = [v for d, x, v in rows if x == g and d >= 2]
        assert got[g].value_low <= exact(own, 50) <= got[g].value_high and got[g].n == len(own)
    assert {r.g: r.t for r in days.groupBy("g").agg(F.sum("total").alias("t")).collect()} == {g: sum(v for _, x, v in rows if x == g) for g in "ab"}


# ---- components ------------------------------------------------------------------------------------------------
def brute_groups(pairs, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b and a in parent and b in parent:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    groups = {}
    for i in ids:
        groups.setdefault(root(i), []).append(i)
    return {i: g for g, xs in groups.items() if len(xs) > 1 for i in xs}


def run_groups(spark, pairs, ids):
    links = spark.createDataFrame(pairs, "a bigint, b bigint").withColumn("hi", F.lit("clash")).withColumn("deg", F.lit(0))
    nodes = spark.createDataFrame([(i,) for i in ids], "id bigint").withColumn("u", F.lit("clash"))
    return {r.node: r.group_id for r in components.components(links, "a", "b", nodes, "id").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graph(spark, seed):
    rnd = random.Random(seed)
    ids = list(range(1, 300))
    pairs = [(rnd.choice([None, *ids, *ids, 999]), rnd.choice([*ids, 998])) for _ in range(160)] + [(5, 5), (7, 8), (8, 7), (7, 8)]
    assert run_groups(spark, pairs, ids) == brute_groups(pairs, ids)


def test_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(1, 200)]
    random.Random(3).shuffle(chain)
    star = [(1000, i) for i in range(1001, 1400)]
    ids = [*range(1, 201), *range(1000, 1400)]
    assert run_groups(spark, chain + star, ids) == brute_groups(chain + star, ids)


def test_no_links(spark):
    assert run_groups(spark, [(1, 1), (None, 2), (3, 99)], [1, 2, 3]) == {}
    empty = spark.createDataFrame([], "a bigint, b bigint")
    assert components.components(empty, "a", "b", spark.createDataFrame([], "id bigint"), "id").count() == 0


# ---- packing ---------------------------------------------------------------------------------------------------
def naive_pack(items, capacity):
    bins, place = [], [None] * len(items)  # [room, sources, clusters]
    for i in sorted(range(len(items)), key=lambda i: (-items[i][0], i)):
        size, src, apart, cluster = items[i]
        fits = [b for b, (room, s, c) in enumerate(bins) if room >= size and not c & cluster and not s & apart]
        best = min(fits, key=lambda b: bins[b][0], default=None)
        if best is None:
            bins.append([capacity, 0, 0])
            best = len(bins) - 1
        bins[best][0] -= size
        bins[best][1] |= src
        bins[best][2] |= cluster
        place[i] = best
    return place


@pytest.mark.parametrize("seed", range(5))
def test_pack_is_tight_and_compatible(seed):
    rnd = random.Random(seed)
    items = [(rnd.randrange(1, 60), 1 << rnd.randrange(3), rnd.choice([0, 0, 4]), rnd.choice([0, 0, 1, 2, 4])) for _ in range(300)]
    place = packing.pack(items, 100)
    used = {}
    for i, b in enumerate(place):
        used.setdefault(b, []).append(items[i])
    for inside in used.values():
        assert sum(x[0] for x in inside) <= 100
        clusters = [x[3] for x in inside if x[3]]
        assert len(clusters) == len(set(clusters))
    assert place == naive_pack(items, 100)


def test_pack_documents(spark):
    rows = [(1, 250, "a", None), (2, 60, "show_script", 5), (3, 40, "court_filing", 5), (4, 40, None, 6), (5, None, "a", 6), (6, 100, None, None), (7, 60, "b", 6)]
    df = spark.createDataFrame(rows, "doc bigint, n bigint, src string, cl bigint").withColumn("id", F.lit("clash")).withColumn("pack_id", F.lit(9))
    caps = spark.createDataFrame([(1, 100), (2, 1000), (3, 0)], "pack_id int, capacity_tokens int")
    apart = (("show_script", "court_filing"),)
    got = packing.pack_documents(df, "doc", "n", "src", "cl", caps, conflicts=apart).collect()
    free = {r.doc: r.container_id for r in packing.pack_documents(df, "doc", "n", "src", "cl", caps).collect() if r.pack_id == 2}
    assert free[1] == free[2] != free[3]  # nothing but clusters keeps them apart
    packed = packing.pack_documents(df, "doc", "n", "src", "cl", caps, conflicts=apart)
    assert {r.violations for r in packing.violations(packed, df, "doc", "n", "src", "cl", caps, apart).collect()} == {0}
    broken = packed.withColumn("container_id", F.lit("all")).where("doc <> 7")
    assert {r.check: r.violations > 0 for r in packing.violations(broken, df, "doc", "n", "src", "cl", caps, apart).collect()} == {"over_capacity": True, "not_whole": True, "divided": False, "same_cluster": True, "conflict": True}
    one = [r for r in got if r.pack_id == 1]
    assert sorted((r.doc, r.piece_tokens) for r in one if r.doc == 1) == [(1, 50), (1, 100), (1, 100)]
    assert all(r.piece == 0 for r in one if r.doc != 1) and {r.pack_id for r in got} == {1, 2}
    bins = {}
    for r in one:
        bins.setdefault(r.container_id, []).append(r)
    assert all(sum(r.piece_tokens for r in b) <= 100 for b in bins.values())
    where = {r.doc: r.container_id for r in got if r.pack_id == 2}
    assert where[2] != where[3] and len({where[4], where[5], where[7]}) == 3
    assert packing.pack_documents(df.limit(0), "doc", "n", "src", "cl", caps).count() == 0
    assert packing.pack_documents(df, "doc", "n", "src", "cl", caps.limit(0)).count() == 0


def test_a_third_copies_pack_in_time():
    import time

    items = [(50, 1, 0, 1)] * 6000 + [(random.Random(i).randrange(1, 400), 2, 0, 0) for i in range(12000)]
    began = time.time()
    place = packing.pack(items, 512)
    assert len(set(place[:6000])) == 6000 and time.time() - began < 20


# ---- mixing ----------------------------------------------------------------------------------------------------
TARGETS = "source string, target_share double, max_repeats int"


def test_mix_shares_and_repeats(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.randrange(1, 300), "big" if i % 10 else "small") for i in range(4000)] + [(9001, None, "big"), (9002, 50, None), (9003, 10, "other")]
    df = spark.createDataFrame(rows, "doc bigint, n bigint, src string").withColumn("id", F.lit("clash")).withColumn("rank", F.lit(0))
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 3), ("none", 0.0, 1)], TARGETS)
    chosen, report = mixing.mix(df, "doc", "n", "src", targets, block_tokens=64)
    r = {x.source: x for x in report.collect()}
    assert abs(r["big"].actual_share - 0.7) < 0.002 and abs(r["small"].actual_share - 0.3) < 0.002 and r["none"].tokens == 0
    assert r["big"].most_copies == 1 and r["small"].most_copies <= 3
    uses = chosen.groupBy("doc", "copy").count()
    assert uses.where("count > 1").count() == 0 and chosen.where("source not in ('big', 'small')").count() == 0
    # The largest mix that the targets allow: one of the sources is nearly used up.
    stock = {s: sum(n or 0 for _, n, x in rows if x == s) for s in ("big", "small")}
    assert max(r["big"].tokens / stock["big"], r["small"].tokens / (3 * stock["small"])) > 0.98


def test_schedule_is_even(spark):
    plan = mixing.schedule(spark, [("a", 0.5), ("b", 0.25), ("c", 0.25)], 1024).orderBy("slot").collect()
    for k in range(0, 1024, 64):
        part = [r.source for r in plan[k : k + 64]]
        assert abs(part.count("a") - 32) <= 3
    seen = {"a": 0, "b": 0, "c": 0}
    for r in plan:
        assert r["rank"] == seen[r.source]
        seen[r.source] += 1


def test_mix_of_repeated_targets(spark):
    df = spark.createDataFrame([(i, 10, "a" if i % 2 else "b") for i in range(400)], "doc bigint, n bigint, src string")
    targets = spark.createDataFrame([("a", 0.25, 1), ("a", 0.25, 2), ("b", 0.5, 1), (None, 0.1, 1), ("c", None, 1)], TARGETS)
    r = {x.source: x for x in mixing.mix(df, "doc", "n", "src", targets, block_tokens=4)[1].collect()}
    assert abs(r["a"].actual_share - 0.5) < 0.02 and r["a"].max_repeats == 2 and set(r) == {"a", "b", "c", None}


def test_blocks_have_one_size_whatever_the_corpus(spark):
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 1)], TARGETS)
    for docs in (600, 2400):
        df = spark.range(docs).select(F.col("id").alias("doc"), (F.col("id") % 37 + 1).alias("n"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("src"))
        chosen, report = mixing.mix(df, "doc", "n", "src", targets, block_tokens=100)
        r = {x.source: x for x in report.collect()}
        assert abs(r["a"].actual_share - 0.6) < 0.003
        slots, total = chosen.agg(F.max("slot")).first()[0] + 1, r["a"].tokens + r["b"].tokens
        assert abs(total / slots - 100) < 10


def test_mix_without_documents(spark):
    df = spark.createDataFrame([], "doc bigint, n bigint, src string")
    chosen, report = mixing.mix(df, "doc", "n", "src", spark.createDataFrame([("a", 1.0, 1)], TARGETS))
    assert chosen.count() == 0 and report.first().actual_share == 0.0


# ---- tokens and the classifier ---------------------------------------------------------------------------------
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, " \n "), (4, "word " * 40_000), (5, "")], "doc int, body string").withColumn("__text", F.lit("clash"))
    got = {r.doc: r.tokens for r in tokens.token_counts(df, "body", ["doc"]).collect()}
    assert got[1] == 2 and set(got) == {1, 4} and got[4] == 40_001


def test_long_texts_have_exact_counts():
    rnd = random.Random(12)
    words = ["alpha", "it's", "  ", "\n\n", "3,14", "مرحبا", "漢字かな", "ｶﾅ。", "don't", "...", "\t x", "😀", "é", "   trailing  "]
    enc = tokens._encoder(tokens.VOCABULARY)
    for text in (" ".join(rnd.choice(words) for _ in range(15_000)), "".join(rnd.choice(words) for _ in range(22_000)), " " * 60_000 + "x", "漢字、" * 22_000):
        assert len(text) > tokens.PIECE and tokens.count_tokens(text) == len(enc.encode_ordinary(text))
        assert "".join(tokens.pieces(text, 1000)) == text and sum(len(enc.encode_ordinary(p)) for p in tokens.pieces(text, 1000)) == tokens.count_tokens(text)


def test_fractional_percentiles(spark):
    df = spark.createDataFrame([("a", v) for v in range(-500, 500)], "g string, v bigint")
    got = {r.percentile: r.value for r in quantiles.exact_percentiles(df, ["g"], "v", [0.05, 12.5, 99.9, 99.95]).collect()}
    assert got == {0.05: -500, 12.5: -376, 99.9: 498, 99.95: 499}


def test_fit_separates():
    import numpy as np

    rnd = random.Random(1)
    rows, y = [], []
    for _ in range(400):
        label = rnd.random() < 0.5
        rows.append(np.array([1 if label else 2, 3 + rnd.randrange(20)]))
        y.append(label)
    w = fit(rows, np.array(y), 64)
    assert all((w[0] + w[r].sum() > 0) == label for r, label in zip(rows, y))
    assert fit([], np.array([]), 4).tolist() == [0, 0, 0, 0] and fit([np.array([1])], np.array([1]), 4)[0] > 0


def test_mix_of_few_tokens_keeps_the_cap(spark):
    df = spark.createDataFrame([(1, 7, "a"), (2, 5, "a"), (3, 900, "b"), (4, 80, "b")], "doc bigint, n bigint, src string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], TARGETS)
    chosen, report = mixing.mix(df, "doc", "n", "src", targets, block_tokens=64)
    assert all(r.most_copies <= r.max_repeats for r in report.collect())
    assert {(r.doc, r.copy) for r in chosen.where("source = 'a'").collect()} == {(1, 0), (1, 1), (2, 0), (2, 1)}
