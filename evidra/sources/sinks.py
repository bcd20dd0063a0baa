"""Sinks: published documents, swaps of whole tables, ids of new rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.operators.skew import two_level_running
from evidra.session import materialize


def write_document(df: DataFrame, path: str) -> None:
    """A small result as one JSON-lines file, replaced as a whole."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_documents(df: DataFrame, path: str, by: str) -> None:
    """A folder of JSON lines per value of ``by``, all in one job; values are spread over tasks first."""
    df.repartition(F.col(by)).write.mode("overwrite").partitionBy(by).json(path)


def _rename(fs, a, b) -> None:  # noqa: ANN001
    if not fs.rename(a, b):
        raise OSError(f"{a} could not be renamed to {b}")


def swap(df: DataFrame, path: str) -> None:
    """Replace the table at ``path``: written beside it, the old one moved aside, the new one moved in, the old one deleted last.

    If a move fails the old table is moved back, so at every moment one of the two is whole.
    """
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    tag = uuid.uuid4().hex[:12]
    dst, new, old = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.new-{tag}", f"{path}.old-{tag}"))
    df.write.parquet(new.toString())
    fs = dst.getFileSystem(conf)
    there = fs.exists(dst)
    try:
        if there:
            _rename(fs, dst, old)
        try:
            _rename(fs, new, dst)
        except Exception:
            if there:
                _rename(fs, old, dst)
            raise
    except Exception:
        fs.delete(new, True)
        raise
    if there:
        fs.delete(old, True)


#: Rows that a task orders at a time when ids are given out, about.
PART_ROWS = 1_000_000


def with_ids(rows: DataFrame, order: str, first: int = 1, name: str = "id", part_rows: int = PART_ROWS) -> DataFrame:
    """Consecutive ids from ``first`` in the order of a unique column. Ranges of about ``part_rows`` rows are found by sampling,
    each is numbered by itself, and offsets are the sums of the ranges before. An empty table gives no rows."""
    parts = max(1, -(-rows.count() // part_rows))
    placed, _ = materialize(rows.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()), "ranges")
    df = placed.withColumn("__all", F.lit(0)).withColumn("__one", F.lit(1))
    return two_level_running(df, "__all", "__part", [order], "__one", "__before").withColumn(name, F.col("__before") + first).drop("__all", "__part", "__one", "__before")
