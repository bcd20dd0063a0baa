"""Structured Streaming twins of the incremental operators. State lives in checkpoints and tables of the caller's folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.utils import AnalysisException

from evidra.operators.delivery import DeliveryStore
from evidra.operators.tables import insert_new
from evidra.session import exists, release


def json_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """JSON lines dropped into a folder; lines that don't fit the schema become nulls."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:  # noqa: ANN001
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_batch(batch: DataFrame, n: int, table: str) -> None:
    """A batch's rows as a folder of ``table`` of its own: a batch that comes again takes its own place, so nothing is written twice."""
    batch.write.mode("overwrite").parquet(f"{table}/batch={n}")


def append_batch(batch: DataFrame, n: int, table: str, keys: list[str], order: list[str]) -> None:
    """What batch ``n`` adds to ``table`` under unique ``keys``: first writer wins over all batches before; rows with a null key are all new."""
    old = _stored(batch.sparkSession, table, batch.schema)
    if "batch" in old.columns and "batch" not in batch.columns:
        old = old.where(F.col("batch") != n)
    write_batch(insert_new(old.select(*batch.columns), batch, keys, order), n, table)


def append_new(stream: DataFrame, table: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """First writer wins on ``keys`` over all batches, without a horizon: each batch is anti-joined with the others' rows and written to its own folder.

    A batch that was written but not yet committed is written again after a failure, in the same place, rows with null keys included.
    """
    return stream.writeStream.foreachBatch(lambda b, n: append_batch(b, n, table, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, store: DeliveryStore, out: str, checkpoint: str) -> StreamingQuery:
    """(tbl, id) of the rows to keep of a stream of (tbl, id, ident, tb), appended to ``out``: over all batches one per identifier.

    The store answers a repeated batch as it did at first, and ``out`` holds a folder per batch, so nothing is written twice.
    """

    def write(batch: DataFrame, n: int) -> None:
        store.ingest(batch, str(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], length: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts by event-time window and key; rows later than ``late`` behind the newest are left out."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def unique_within(stream: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """One row per key within the watermark: bounded state, so weaker than ``append_new``."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def publish(df: DataFrame, table: str, version: int) -> None:
    """``df`` as version ``version`` of a published table. A version is whole or not there; the one before stays for those who read it, older ones go."""
    df.write.mode("overwrite").parquet(f"{table}/v{version}")
    release(df.sparkSession, *(f"{table}/v{v}" for v in _versions(df.sparkSession, table) if v < version - 1))


def _versions(spark: SparkSession, table: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and exists(spark, f"{table}/{n}/_SUCCESS"))


def published(spark: SparkSession, table: str) -> DataFrame:
    """The newest whole version of a published table."""
    return spark.read.parquet(f"{table}/v{_versions(spark, table)[-1]}")


def additive_totals(stream: DataFrame, key: str, measures: dict[str, Column], table: str, checkpoint: str) -> StreamingQuery:
    """Running totals per key, published as a new version by every batch: ``published`` always reads a whole one."""
    agg = stream.groupBy(key).agg(*(F.sum(c).alias(n) for n, c in measures.items()))
    return agg.writeStream.outputMode("complete").foreachBatch(lambda b, n: publish(b, table, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quota(stream: DataFrame, key: str, most: int) -> DataFrame:
    """(key, admitted, refused) updates: the first ``most`` rows of a key over the stream's life are admitted."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        seen += sum(len(b) for b in batches)
        state.update((seen,))
        yield pd.DataFrame({key: [k[0]], "admitted": [min(seen, most)], "refused": [max(0, seen - most)]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, admitted bigint, refused bigint", "seen bigint", "update", GroupStateTimeout.NoTimeout)


#: Seconds to wait before each further try to resume.
RESUME_BACKOFF = [5, 10, 20, 40, 60]


def watchdog_steps(seen: list[tuple[float, bool]], status: str, fails: int, probe_at: float) -> tuple[list[tuple[str, float]], str, int, float]:
    """(status, next probe) at each of ``seen``(time, whether the line is up) in time order, and the state after.

    The first loss shows BRB at once; from then on the line only counts as probed when the wait is over. A
    probe that fails waits longer, up to the last wait; one that succeeds resumes, by the clock of that moment.
    """
    out = []
    for t, up in seen:
        if status == "RESUMING":
            status = "STREAMING"
        if status == "STREAMING":
            if not up:
                status, fails, probe_at = "BRB", 0, t + RESUME_BACKOFF[0]
        elif t >= probe_at:
            if up:
                status, fails, probe_at = "RESUMING", 0, 0.0
            else:
                fails = min(fails + 1, len(RESUME_BACKOFF) - 1)
                probe_at = t + RESUME_BACKOFF[fails]
        out.append((status, probe_at if status == "BRB" else 0.0))
    return out, status, fails, probe_at


def watchdog(stream: DataFrame, who: str, at: str, ok: str) -> DataFrame:
    """(who, at, status, probe_at) of every sample of a feed's line, ``at`` in seconds. A trigger's samples of a feed are put in time order first."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, fails, probe_at = state.get if state.exists else ("STREAMING", 0, 0.0)
        b = pd.concat([x[[at, ok]] for x in batches]).sort_values(at, kind="stable")
        steps, status, fails, probe_at = watchdog_steps([(float(t), bool(up)) for t, up in b.itertuples(index=False)], status, fails, probe_at)
        state.update((status, fails, probe_at))
        yield pd.DataFrame({who: k[0], at: b[at].to_numpy(), "status": [x[0] for x in steps], "probe_at": [x[1] for x in steps]})

    kinds = dict(stream.dtypes)
    return stream.groupBy(who).applyInPandasWithState(fold, f"{who} {kinds[who]}, {at} {kinds[at]}, status string, probe_at double", "status string, fails int, probe_at double", "append", GroupStateTimeout.NoTimeout)


def route_batch(batch: DataFrame, n: int, good: Column, out: str, failed: str, shape: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    marked = shape(batch).withColumn("__ok", F.coalesce(good, F.lit(False)))
    write_batch(marked.where("__ok").drop("__ok"), n, out)
    write_batch(marked.where("not __ok").drop("__ok"), n, failed)


def route(stream: DataFrame, good: Column, out: str, failed: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Each batch in two branches: what passes to ``out``, the rest to ``failed``, each in the batch's own folder."""
    return stream.writeStream.foreachBatch(lambda b, n: route_batch(b, n, good, out, failed, shape)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
