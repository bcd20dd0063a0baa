"""The queries of p4 to p9 on the small tables, against their SQL where there is one."""

import os
from collections import defaultdict

import pytest

from tests.test_queries import SF, compare, duck  # noqa: F401

from evidra.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, duck, name):  # noqa: F811
    compare(spark, duck, name)


def test_every_carrier_has_statistics(spark):
    claims = spark.read.parquet(f"{SF}/arb_claims.parquet")
    carriers = sorted((r.carrier for r in claims.select("carrier").distinct().collect()), key=str)
    stats = {(r.scope, r.carrier): r for r in queries.p4_all_claim_stats(spark, SF).collect()}
    assert sorted((c for scope, c in stats if scope == "carrier"), key=str) == carriers and ("all", None) in stats
    for c in ("drasktel", "haskelair"):  # without amounts, and with amounts above the cap only
        assert tuple(stats["carrier", c])[2:] == (0, 0, None)
    got = {(r.carrier, r.measure, r.percentile): r for r in queries.p4_all_percentiles(spark, SF).where("scope = 'carrier'").collect()}
    assert len(got) == len(carriers) * 2 * len(queries.PERCENTS)
    assert (got["drasktel", "raw", 50].value, got["drasktel", "raw", 50].n) == (None, 0)
    assert got["haskelair", "raw", 50].n == 2 and got["haskelair", "capped", 50].value is None


def test_containers(spark):
    rows = queries.p7_containers(spark, SF).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").where(r"text rlike '[^\\s\\p{Z}]'").collect()}
    sums = defaultdict(int)
    for r in rows:
        sums[r.container_id, r.capacity_tokens] += r.piece_tokens
    assert all(t <= cap for (_, cap), t in sums.items())
    for pack in (1, 2, 3):
        assert {r.doc_id for r in rows if r.pack_id == pack} == docs
    assert all(r.unused_share < 0.2 for r in queries.p7_fill(spark, SF).collect())


def test_shares(spark):
    shares = queries.p8_shares(spark, SF).collect()
    assert abs(sum(r.actual_share for r in shares) - 1) < 1e-9
    assert all(r.most_copies <= r.max_repeats for r in shares)


def test_cut_and_sentences(spark):
    n = queries.p5_found(spark, SF).count()
    assert 0 < n < 400 and queries.p5_source_shares(spark, SF).agg({"n_cut": "sum"}).first()[0] == n
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.p9_found(spark, SF).collect():
        piece = texts[r.doc_id][r.sent_start : r.sent_end]
        assert piece and piece == piece.strip()
