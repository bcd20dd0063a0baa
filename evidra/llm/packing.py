"""Filling containers of a fixed number of tokens, under conflicts, by best fit.

Bins stand in the order of their free space. Each carries a bitmap of the sources and one of the
duplicate clusters in it. An item goes into the bin that it fills most tightly among those that are
compatible: starting from the least sufficient free space, the successor search goes on until one is
found, else a bin is opened. Items come longest first. Two members of a duplicate cluster never share
a bin, nor do sources that are named as conflicting.

The table is divided into shards of a bounded number of items by a hash of the id, so no task holds
more; a shard wastes at most part of its last bins. Copies of one text spread evenly over the shards.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a shard, about. The space that open bins waste at a shard's end is below 1 / 1000 of a shard's.
SHARD_ITEMS = 40_000

def pack(items: list[tuple[int, int, int, int]], capacity: int) -> list[int]:
    """Bins (from 0) of ``items``: (size, source bits, bits of sources it conflicts with, cluster bits), size <= capacity.

    Bins with the same bitmaps and the same free space wait in one heap, so the search looks at each
    kind of bin once however many there are. Ties take the bin opened first.
    """
    order = sorted(range(len(items)), key=lambda i: (-items[i][0], i))
    place = [-1] * len(items)
    # free space -> {(sources, clusters): heap of bins}; ``spaces`` holds the free spaces that have bins, in order
    free: dict[int, dict[tuple[int, int], list[int]]] = {}
    spaces: list[int] = []
    n, before, passed = 0, None, 0
    for i in order:
        size, src, apart, cluster = items[i]
        # What was no place for the same kind of item a moment ago is none now: copies don't search anew.
        k, found = bisect_left(spaces, passed if items[i] == before and cluster else size), None
        while k < len(spaces) and found is None:
            fits = [(bins[0], kind) for kind, bins in free[spaces[k]].items() if not (kind[1] & cluster) and not (kind[0] & apart)]
            if fits:
                found = min(fits)[1]
            else:
                k += 1
        if found is None:
            b, room, kind = n, capacity, (0, 0)
            n += 1
        else:
            room, kind = spaces[k], found
            same = free[room][kind]
            b = heappop(same)
            if not same:
                del free[room][kind]
                if not free[room]:
                    del free[room]
                    del spaces[k]
        place[i], before, passed = b, items[i], room if found is not None else capacity + 1
        left, now = room - size, (kind[0] | src, kind[1] | cluster)
        if left > 0:
            if left not in free:
                free[left] = {}
                insort(spaces, left)
            heappush(free[left].setdefault(now, []), b)
    return place


def pack_documents(sizes: DataFrame, id_col: str, size_col: str, source_col: str, cluster_col: str, capacities: DataFrame, *, conflicts: tuple[tuple[str, str], ...] = (), shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(pack_id, id, piece, container_id, piece_tokens, capacity_tokens): where every item lies, for every row of ``capacities``(pack_id, capacity_tokens).

    An item within the capacity is one piece (0). A longer one is divided into full containers and a rest,
    which is packed as an item. Sizes of 0 count as 1. Null sources conflict with none; null clusters are
    single. Ids must be unique; an empty table gives no rows.
    """
    n = sizes.count()
    shards = max(1, -(-n // shard_items))
    base = sizes.select(F.col(id_col).alias("id"), F.greatest(F.col(size_col), F.lit(1)).alias("size"), F.col(source_col).alias("source"), F.col(cluster_col).alias("cluster"))
    # Capacities are a few rows of a fixed table: each item is asked for once per capacity.
    caps = [(r.pack_id, r.capacity_tokens) for r in capacities.select("pack_id", "capacity_tokens").where("capacity_tokens > 0").distinct().orderBy("pack_id").collect()]
    each = F.array(*(F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("int").alias("cap")) for p, c in caps)) if caps else F.expr("cast(array() as array<struct<pack_id:int,cap:int>>)")
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    ready = base.withColumn("shard", shard).withColumn("p", F.explode(each)).select("id", "size", "source", "cluster", "shard", "p.pack_id", "p.cap")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id"], ascending=[False, True], kind="stable")
        pack_id, shard_no = int(key[0]), int(key[1])
        cap = int(pdf["cap"].iloc[0])
        known = {s: i for i, s in enumerate(sorted({*pdf["source"].dropna()} | {s for pair in conflicts for s in pair}))}
        apart: dict[str, int] = {}
        for a, b in conflicts:
            apart[a] = apart.get(a, 0) | 1 << known[b]
            apart[b] = apart.get(b, 0) | 1 << known[a]
        counts = pdf["cluster"].value_counts()
        bits = {c: 1 << i for i, c in enumerate(counts.index[counts > 1])}
        ids, pieces, conts, toks, items, at = [], [], [], [], [], []
        full = 0
        for i, size, s, c in zip(pdf["id"].tolist(), pdf["size"].tolist(), pdf["source"].tolist(), pdf["cluster"].tolist()):
            piece = 0
            while size > cap:  # whole containers of their own
                ids.append(i), pieces.append(piece), conts.append(-1 - full), toks.append(cap)
                full, piece, size = full + 1, piece + 1, size - cap
            at.append(len(ids))
            ids.append(i), pieces.append(piece), conts.append(0), toks.append(size)
            text = isinstance(s, str)
            items.append((size, 1 << known[s] if text else 0, apart.get(s, 0) if text else 0, bits.get(c, 0)))
        bins = pack(items, cap)
        for row, b in zip(at, bins):
            conts[row] = b
        top = max(bins, default=-1) + 1
        names = [f"{pack_id}-{shard_no}-{c if c >= 0 else top - 1 - c}" for c in conts]
        return pd.DataFrame({"pack_id": pack_id, "id": ids, "piece": pieces, "container_id": names, "piece_tokens": toks, "capacity_tokens": cap})

    kind = dict(sizes.dtypes)[id_col]
    out = ready.groupBy("pack_id", "shard").applyInPandas(one, f"pack_id int, id {kind}, piece int, container_id string, piece_tokens bigint, capacity_tokens int")
    return out.withColumnRenamed("id", id_col)


def fill_report(packed: DataFrame) -> DataFrame:
    """(pack_id, containers, tokens, unused_share) of a packing."""
    per = packed.groupBy("pack_id", "container_id").agg(F.sum("piece_tokens").alias("t"), F.max("capacity_tokens").alias("cap"))
    return per.groupBy("pack_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.round(1 - F.sum("t") / F.sum("cap"), 6).alias("unused_share"))


def violations(packed: DataFrame, sizes: DataFrame, id_col: str, size_col: str, source_col: str, cluster_col: str, capacities: DataFrame, conflicts: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(check, violations) of a packing against what was to be packed, recomputed from its rows: 0 everywhere if it is sound.

    over_capacity: containers with more than their capacity; not_whole: (pack, item) whose pieces are missing, repeated
    or don't add up; divided: items within the capacity in more than one piece; same_cluster: repeated (container, cluster);
    conflict: containers with two sources that conflict.
    """
    s = sizes.select(F.col(id_col).alias("__id"), F.greatest(F.col(size_col), F.lit(1)).alias("__size"), F.col(source_col).alias("__source"), F.col(cluster_col).alias("__cluster"))
    caps = capacities.where("capacity_tokens > 0").select(F.col("pack_id").alias("__pack"), F.col("capacity_tokens").alias("__cap"))
    per = packed.groupBy("pack_id", "container_id").agg(F.sum("piece_tokens").alias("t"), F.max("capacity_tokens").alias("cap"))
    n = lambda name, df: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
    wanted = s.join(F.broadcast(caps))  # a row per container size
    got = packed.groupBy(F.col("pack_id").alias("gp"), F.col(id_col).alias("gi")).agg(F.sum("piece_tokens").alias("gt"), F.count(F.lit(1)).alias("gn"), F.countDistinct("piece").alias("gd"))
    both = wanted.join(got, (F.col("__pack") == F.col("gp")) & (F.col("__id") == F.col("gi")), "full")
    whole = F.col("gi").isNotNull() & F.col("__id").isNotNull() & (F.col("gt") == F.col("__size")) & (F.col("gn") == F.col("gd"))
    inside = packed.select("pack_id", "container_id", F.col(id_col).alias("gi")).join(s, F.col("gi") == F.col("__id"))
    twice = inside.where(F.col("__cluster").isNotNull()).groupBy("pack_id", "container_id", "__cluster").agg(F.countDistinct("__id").alias("n")).where("n > 1")
    out = n("over_capacity", per.where("t > cap")).union(n("not_whole", both.where(~F.coalesce(whole, F.lit(False))))).union(n("divided", both.where("__size <= __cap and gn > 1"))).union(n("same_cluster", twice))
    apart = F.lit(False)
    has = inside.groupBy("pack_id", "container_id").agg(F.collect_set("__source").alias("sources"))  # at most a name per source
    for a, b in conflicts:
        apart = apart | (F.array_contains("sources", a) & F.array_contains("sources", b))
    return out.union(n("conflict", has.where(apart)))
