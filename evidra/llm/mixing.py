"""A mix of sources with target shares of the tokens, by a low-discrepancy schedule.

Slots 0, 1, 2, ... become points of the golden-ratio sequence in [0, 1); the cumulative target weights
map each point to a source, so every run of slots holds nearly the target shares. A source's slots are
ranked; its r-th slot takes the r-th block of its documents in shuffled order, the source beginning again
after its last document, at most ``max_repeats`` times. The mix is the largest in which no source runs
out. A block is about ``block_tokens`` tokens whatever the corpus' size: the number of slots follows from
the mix. All ranks and token offsets are two-level sums: no task orders a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators.skew import two_level_running
from evidra.session import materialize

#: Fixed value: the golden ratio's fractional part.
GOLDEN = 0.6180339887498949
#: Tokens of a slot's block, about. Within a block the mix is of one source.
BLOCK_TOKENS = 4_096
#: Rows that a part of a shuffled source holds, about.
PART_ROWS = 20_000


def schedule(spark: SparkSession, targets: list[tuple[str, float]], slots: int) -> DataFrame:
    """(slot, source, rank): the source of each slot and the number of its slots before."""
    total = sum(w for _, w in targets)
    point = F.pmod((F.col("id") + 0.5) * GOLDEN, F.lit(1.0))
    source, upto = F.lit(targets[-1][0]), total
    for name, w in reversed(targets):
        source = F.when(point * total < upto, F.lit(name)).otherwise(source)
        upto -= w
    df = spark.range(slots).select(F.col("id").alias("slot"), source.alias("source"), F.expr("id div 4096").alias("part"), F.lit(1).alias("one"))
    return two_level_running(df, "source", "part", ["slot"], "one", "rank").select("slot", "source", "rank")


def mix(sizes: DataFrame, id_col: str, size_col: str, source_col: str, targets: DataFrame, *, block_tokens: int = BLOCK_TOKENS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The chosen documents (slot, id, source, tokens, copy) and the report
    (source, target_share, actual_share, tokens, documents, copies, most_copies).

    ``targets``(source, target_share, max_repeats): a few rows; of a source that stands there more than
    once the shares add up and the greatest number of repeats holds. Sources with a null name, without target,
    a share of 0 or no documents are left out and the remaining shares hold among each other; the report
    has all targets. Sizes of 0 or null count as 0 tokens. Without documents both tables are empty.
    """
    spark = sizes.sparkSession
    targets = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    want = [(r.source, float(r.target_share), int(r.max_repeats)) for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").orderBy("source").collect()]
    docs = sizes.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("bigint").alias("tokens"), F.col(source_col).alias("source"))
    docs = docs.join(targets.where("target_share > 0 and max_repeats > 0").select(F.col("source").alias("__s")), F.col("source") == F.col("__s")).drop("__s")
    docs, _ = materialize(docs, "mix-sizes")
    stock = {r.source: (r.t, r.n) for r in docs.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).where("t > 0").collect()}  # at most a row a target
    use = [x for x in want if x[0] in stock]
    if not use:
        empty = spark.createDataFrame([], f"slot bigint, {id_col} {dict(sizes.dtypes)[id_col]}, source string, tokens bigint, copy int")
        return empty, _report(empty, id_col, targets)
    weight = {k: w / sum(w for _, w, _ in use) for k, w, _ in use}
    # The largest mix with which no source is used more often than it may be; so many slots that blocks have their size, and that every source has one.
    size = min(m * stock[k][0] / weight[k] for k, _, m in use)
    slots = max(round(size / block_tokens), round(4 / min(weight.values())))
    plan, _ = materialize(schedule(spark, [(k, w) for k, w, _ in use], slots), "mix-slots")
    ranks = {r.source: r.n for r in plan.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most a row a target
    parts = max(1, max(n for _, n in stock.values()) // PART_ROWS)
    rows = docs.withColumn("__h", F.xxhash64("id", F.lit(seed))).withColumn("part", F.pmod("__h", F.lit(parts)))
    placed = two_level_running(rows, "source", "part", ["__h", "id"], "tokens", "start")
    # What a source is to give, how long it is, and its blocks.
    known = F.element_at(F.create_map(*(F.lit(x) for k, _, _ in use for x in (k, F.struct(F.lit(weight[k] * size).alias("reach"), F.lit(stock[k][0]).cast("bigint").alias("length"), F.lit(ranks[k]).cast("bigint").alias("slots"))))), F.col("source"))
    placed = placed.withColumn("k", known).where(F.col("k").isNotNull() & (F.col("tokens") > 0)).select("id", "source", "tokens", "start", "k.*")
    copies = F.greatest(F.lit(0), F.floor((F.col("reach") + 1e-6 - F.col("start") - F.col("tokens")) / F.col("length")) + 1).cast("int")
    placed, _ = materialize(placed.withColumn("copies", copies), "mix-placed")
    added = _fillers(placed, {k: weight[k] * size for k, _, _ in use})
    used = placed.join(added, (F.col("source") == F.col("as")) & (F.col("start") == F.col("at")), "left").withColumn("uses", F.col("copies") + F.col("at").isNotNull().cast("int"))
    used = used.where("uses > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
    rank = F.floor((F.col("copy") * F.col("length") + F.col("start")) / (F.col("reach") / F.col("slots")))
    rank = F.when(F.col("copy") >= F.col("copies"), F.col("slots") - 1).otherwise(rank)
    used = used.select("id", "source", "tokens", "copy", F.least(rank, F.col("slots") - 1).cast("bigint").alias("rank"))
    chosen = used.join(plan, ["source", "rank"]).select("slot", F.col("id").alias(id_col), "source", "tokens", F.col("copy").cast("int").alias("copy"))
    return chosen, _report(chosen, id_col, targets)


def _fillers(placed: DataFrame, reach: dict[str, float]) -> DataFrame:
    """(as, at): source and place of documents used once more, to fill what the last turn leaves of a source's share, as no document is divided.

    One pass takes, of each source and power of two, the most tokens a document has that may be used again; of
    these at most 64 a source the longest that still fits is taken as long as there is one. A second pass finds
    the first document of each such length. Both are hash aggregates of numbers.
    """
    spark = placed.sparkSession
    again = F.col("copies") < F.ceil(F.col("reach") / F.col("length"))
    size_class = F.floor(F.log2("tokens")).cast("int")
    longest = placed.where(again).groupBy("source", size_class.alias("c")).agg(F.max("tokens").alias("t")).collect()
    reached = {r.source: r.t for r in placed.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("t")).collect()}
    wanted = []
    for source, most in reach.items():
        gap = most + 1e-6 - (reached.get(source) or 0)
        for t in sorted((r.t for r in longest if r.source == source), reverse=True):
            if t <= gap:
                wanted.append((source, t))
                gap -= t
    lengths = spark.createDataFrame(wanted, "as string, t bigint")
    fits = placed.where(again).join(F.broadcast(lengths), (F.col("source") == F.col("as")) & (F.col("tokens") == F.col("t")))  # at most 64 rows a target
    return fits.groupBy("as", "t").agg(F.min("start").alias("at")).select("as", "at")


def _report(chosen: DataFrame, id_col: str, targets: DataFrame) -> DataFrame:
    per_doc = chosen.groupBy("source", id_col).agg(F.count(F.lit(1)).alias("c"), F.sum("tokens").alias("t"))
    per = per_doc.groupBy(F.col("source").alias("s")).agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("c").alias("copies"), F.max("c").alias("most_copies"))
    from pyspark.sql import Window

    all_rows = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # over the targets: a few rows
    t = targets.select("source", "target_share", "max_repeats").join(per, F.col("source") == F.col("s"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return t.withColumn("actual_share", F.coalesce(F.col("tokens") / all_rows, F.lit(0.0))).select("source", "target_share", "max_repeats", "actual_share", *(zero(c) for c in ("tokens", "documents", "copies", "most_copies")))
