"""Exactly one row per identifier from at-least-once deliveries.

Deliveries are stored by time bucket. Each bucket has a Bloom filter over 64-bit hashes of its
identifiers. The filters are kept bit-sliced, as a table: a row holds, for one word of 64 filter bits
and 64 neighbouring buckets, which of the buckets have each bit. Probing all 64 buckets is the AND of a
few longs, and filters are built and probed by one shuffle of hashes; they never meet the driver.

A hash that stands once in its bucket and that no earlier bucket's filter knows is definitely new. Only
possible repeats are verified: the stored rows of just the buckets in question are read again, and
identifiers are compared exactly. So identifiers are shuffled only where stored rows meet the possible
repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from evidra.session import exists, materialize, new_path, release

#: Filter size and hash count: with about 3 identifiers a word and 5 bits each, under 0.1 % false hits a bucket.
IDS_PER_WORD, BITS_PER_ID = 3, 5
#: Buckets that one row of the bit-sliced filters covers.
SLICE = 64


def normal_identifier(c: Column) -> Column:
    """Without white space around it, and in lower case up to the first colon."""
    t = F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    at = F.instr(t, ":")
    return F.when(at > 0, F.concat(F.lower(t.substr(F.lit(1), at)), t.substr(at + 1, F.length(t)))).otherwise(t)


def _places(h: str) -> list[Column]:
    """The filter bits (0 to 63) of an identifier within its word."""
    return [F.expr(f"cast(shiftrightunsigned(xxhash64({h}), {6 * i}) & 63 as int)") for i in range(BITS_PER_ID)]


def _mask(h: str) -> Column:
    """Those bits as one long."""
    m = F.lit(0).cast("bigint")
    for p in _places(h):
        m = m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), p))
    return m


def _bucket_bit() -> Column:
    return F.expr(f"shiftleft(1L, cast(pmod(tb, {SLICE}) as int))")


def _buckets_of(known: str) -> Column:
    """The buckets of a group that a long names by its bits."""
    return F.expr(f"transform(filter(sequence(0, {SLICE - 1}), i -> (shiftrightunsigned({known}, i) & 1) = 1), i -> i + grp * {SLICE})")


def hash_index(storage: DataFrame) -> DataFrame:
    """(tbl, tb, h, n): the hashes of every bucket with their rows, partially aggregated where they are read."""
    return storage.groupBy("tbl", "tb", "h").agg(F.count(F.lit(1)).alias("n"))


def with_words(index: DataFrame, words: dict[str, int]) -> DataFrame:
    """Adds the word of each hash in its table's filters and brings equal words together: the one shuffle of building and probing."""
    size = F.element_at(F.create_map(*(F.lit(x) for kv in words.items() for x in kv)), F.col("tbl"))
    # Not null by their making; said here, so that builder and prober have one plan and share the shuffle.
    placed = index.select("tbl", "tb", "h", F.pmod("h", size.cast("bigint")).alias("word")).where("tbl is not null and h is not null and word is not null and tb is not null")
    return placed.repartition("tbl", "word")


def sliced_filters(placed: DataFrame) -> DataFrame:
    """The filters of all buckets: (tbl, word, grp, slices), slice i telling by its bits which of the group's buckets have filter bit i."""
    f = placed.select("tbl", "word", F.floor(F.col("tb") / SLICE).alias("grp"), _mask("h").alias("mask"), _bucket_bit().alias("bit"))
    has = [f"(mask & {1 << i}L) <> 0" for i in range(63)] + ["mask < 0"]
    one = [F.bit_or(F.expr(f"if({x}, bit, 0L)")).alias(f"s{i}") for i, x in enumerate(has)]
    return f.groupBy("tbl", "word", "grp").agg(*one).select("tbl", "word", "grp", F.array(*(f"s{i}" for i in range(64))).alias("slices"))


def screen(placed: DataFrame, filters: DataFrame) -> DataFrame:
    """(tbl, tb, h, hit): the earlier buckets whose filter knows a bucket's hash. One direction is enough: the later bucket finds the earlier."""
    p = placed.withColumn("own", F.floor(F.col("tb") / SLICE))
    f = filters.select(F.col("tbl").alias("ft"), F.col("word").alias("fw"), "grp", "slices")
    met = p.join(f, (F.col("tbl") == F.col("ft")) & (F.col("word") == F.col("fw")) & (F.col("grp") <= F.col("own")))
    known = F.lit(-1).cast("bigint")
    for place in _places("h"):
        known = known.bitwiseAND(F.get("slices", place))
    known = F.when(F.col("grp") < F.col("own"), known).otherwise(known.bitwiseAND(F.expr(f"~shiftleft(-1L, cast(pmod(tb, {SLICE}) as int))")))
    some = met.withColumn("known", known).where("known <> 0")
    return some.select("tbl", "tb", "h", F.explode(_buckets_of("known")).alias("hit"))


def possible_repeats(index: DataFrame, hits: DataFrame) -> DataFrame:
    """(tbl, tb, h): hashes to be verified, with every bucket in question: repeated within a bucket, found in an earlier one, or found there."""
    keys = F.array(F.col("tb"), F.col("hit"))
    across = hits.select("tbl", "h", F.explode(keys).alias("tb"))
    return index.where("n > 1").select("tbl", "h", "tb").union(across).distinct()


def store(rows: DataFrame, path: str) -> None:
    """Write ``rows``(tbl, id, ident, tb) by table and time bucket, without a shuffle; null identifiers drop out here."""
    known = rows.where(F.col("ident").isNotNull()).withColumn("h", F.xxhash64("tbl", "ident"))
    known.write.mode("append").partitionBy("tbl", "tb").parquet(path)


def stored(spark: SparkSession, path: str, id_type: str, buckets: list[tuple[str, int]] | None = None, above: str = "") -> DataFrame:
    """Stored rows, of the ``buckets`` only if given: the filter names partitions, so no file of another is opened. ``above``: partition columns above."""
    schema = f"id {id_type}, ident string, h bigint, {above}tbl string, tb bigint"
    try:
        df = spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    if buckets is None:
        return df
    by: dict[str, list[int]] = {}
    for tbl, tb in buckets:
        by.setdefault(tbl, []).append(tb)
    wanted = F.lit(False)
    for tbl, tbs in by.items():
        wanted = wanted | ((F.col("tbl") == tbl) & F.col("tb").isin(tbs))
    return df.where(wanted)


def superseded(rows: DataFrame) -> DataFrame:
    """(tbl, id) of every row of ``rows``(tbl, id, ident, tb) whose identifier stands in a row with a smaller id."""
    spark, id_type = rows.sparkSession, dict(rows.dtypes)["id"]
    path = new_path(spark, "delivery-storage")
    store(rows, path)
    index, index_path = materialize(hash_index(stored(spark, path, id_type)), "delivery-hashes")
    per = index.groupBy("tbl", "tb").agg(F.count(F.lit(1)).alias("n")).groupBy("tbl").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("buckets")).collect()  # a row a table
    if not per:
        return rows.select("tbl", "id").limit(0)
    placed = with_words(index, {r.tbl: max(64, r.n // r.buckets // IDS_PER_WORD) for r in per})
    maybe, _ = materialize(possible_repeats(index, screen(placed, sliced_filters(placed))), "delivery-repeats")
    release(spark, index_path)
    buckets = [(r.tbl, r.tb) for r in maybe.select("tbl", "tb").distinct().collect()]  # at most a row a bucket
    rows_there = stored(spark, path, id_type, buckets)
    checked, _ = materialize(rows_there.select("tbl", "h", "ident", "id").join(maybe.select("tbl", "h"), ["tbl", "h"], "left_semi").select("tbl", "ident", "id"), "delivery-checked")
    first = checked.groupBy("tbl", "ident").agg(F.min("id").alias("id")).select("tbl", "id")
    return checked.select("tbl", "id").join(first, ["tbl", "id"], "left_anti")


def keepers(rows: DataFrame) -> DataFrame:
    """(tbl, id) of the one row to keep for each identifier: the smallest id. Null identifiers are no identifiers."""
    return rows.where(F.col("ident").isNotNull()).select("tbl", "id").join(superseded(rows), ["tbl", "id"], "left_anti")


def repeats(rows: DataFrame) -> DataFrame:
    """(tbl, id) of every row to drop. Null identifiers are no repeats; rows that share the kept row's id count as that row."""
    return superseded(rows)


def delivery_rows(df: DataFrame, name: str, id_col: str, key: str, time: str, width: int) -> DataFrame:
    """One table's deliveries in the shape the functions above take; ``width``: seconds a time bucket spans.

    A null or odd time only decides the bucket: it changes how much is compared, never the result.
    Empty identifiers are identifiers. Columns not named are not read.
    """
    return df.select(F.lit(name).alias("tbl"), F.col(id_col).alias("id"), normal_identifier(F.col(key)).alias("ident"), F.coalesce(F.floor(F.col(time) / width), F.lit(-1)).cast("bigint").alias("tb"))


class DeliveryStore:
    """The same over batches as they arrive: ``ingest`` gives a batch's new rows and remembers them at ``path``.

    Storage is partitioned by table and time bucket; an arriving identifier is looked for only in the
    partitions whose filter knows it. What came in an earlier batch wins, within a batch the smallest id.
    ``words`` is the filters' size per time bucket, for good; it changes how much is compared, never the
    result. The filters are one table per batch done, all earlier ones merged into it; older ones go.
    """

    def __init__(self, spark: SparkSession, path: str, words: int = 1 << 20):
        self.spark, self.path, self.words = spark, path, words

    _FILTERS = "tbl string, word bigint, grp bigint, slices array<bigint>"

    def _done(self) -> list[str]:
        """Names of the batches done, in their order."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/done")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files = [f.getPath() for f in fs.listStatus(p)] if fs.exists(p) else []
        return [q.getName().split("-", 1)[1] for q in sorted(files, key=lambda q: int(q.getName().split("-", 1)[0]))]

    def _filters(self, done: list[str]) -> DataFrame:
        if not done:
            return self.spark.createDataFrame([], self._FILTERS)
        return self.spark.read.schema(self._FILTERS).parquet(f"{self.path}/filters/{done[-1]}")

    def ingest(self, rows: DataFrame, batch: str) -> DataFrame:
        """(tbl, id) of the rows of ``rows``(tbl, id, ident, tb) to keep; rows without identifier are not for this store.

        ``batch`` names the batch: its answer is written first, so a batch that is ingested again after a
        failure, or after it was done, gets the same answer.
        """
        id_type, done = dict(rows.dtypes)["id"], self._done()
        out = f"{self.path}/batches/batch={batch}"
        if not exists(self.spark, f"{out}/_SUCCESS"):
            self._new(rows, done, id_type).write.mode("overwrite").partitionBy("tbl", "tb").parquet(out)
        new = stored(self.spark, out, id_type)
        if batch not in done:
            words = self._words(new)
            merged = sliced_filters(words).union(self._filters(done))
            ors = F.array(*(F.bit_or(F.get("slices", F.lit(i))) for i in range(64)))
            merged.groupBy("tbl", "word", "grp").agg(ors.alias("slices")).write.mode("overwrite").parquet(f"{self.path}/filters/{batch}")
            self.spark.range(0).write.mode("overwrite").parquet(f"{self.path}/done/{len(done)}-{batch}")
            for old in done[-2:-1]:  # the last one stays for readers of this moment
                release(self.spark, f"{self.path}/filters/{old}")
        return new.select("tbl", "id")

    def _words(self, index: DataFrame) -> DataFrame:
        return index.withColumn("word", F.pmod("h", F.lit(self.words)))

    def _new(self, rows: DataFrame, done: list[str], id_type: str) -> DataFrame:
        first = rows.where(F.col("ident").isNotNull()).groupBy("tbl", "ident").agg(F.min(F.struct("id", "tb")).alias("m"))
        keyed = first.select("tbl", F.col("m.tb").alias("tb"), "ident", F.col("m.id").alias("id")).withColumn("h", F.xxhash64("tbl", "ident"))
        batch, _ = materialize(keyed, "delivery-batch")
        f = self._filters(done).select(F.col("tbl").alias("ft"), F.col("word").alias("fw"), "grp", "slices")
        known = F.lit(-1).cast("bigint")
        for place in _places("h"):
            known = known.bitwiseAND(F.get("slices", place))
        p = self._words(batch).select("tbl", "h", "word")
        some = p.join(f, (F.col("tbl") == F.col("ft")) & (F.col("word") == F.col("fw"))).withColumn("known", known).where("known <> 0")
        maybe, _ = materialize(some.select("tbl", "h", F.explode(_buckets_of("known")).alias("tb")).distinct(), "delivery-hits")
        buckets = [(r.tbl, r.tb) for r in maybe.select("tbl", "tb").distinct().collect()]  # at most a row a bucket
        if not buckets:
            return batch.select("id", "ident", "h", "tbl", "tb")
        there = stored(self.spark, f"{self.path}/batches", id_type, buckets, "batch string, ").where(F.col("batch").isin(done))
        # Stored rows of those buckets and hashes only, then identifiers exactly.
        met = there.select("tbl", "tb", "h", "ident").join(maybe, ["tbl", "tb", "h"], "left_semi").select("tbl", "ident").distinct()
        return batch.join(met, ["tbl", "ident"], "left_anti").select("id", "ident", "h", "tbl", "tb")
