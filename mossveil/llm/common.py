"""Shared helpers: reading tables, materialising in the shared folder, running totals."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; one of this machine only where none is set and Spark runs on it alone."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="mossveil-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder there."""
    return f"{shared_dir(spark)}/mossveil-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediates that this application has written; results that were not saved cannot be read after."""
    delete(spark, scratch_dir(spark))


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of a (small) intermediate with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Paths written by ``saved`` within each open ``temporary`` block, the innermost last.
_OPEN: list[list[str]] = []


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write a (large) intermediate once as compressed Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame) -> None:
    """Delete what ``saved`` wrote for these, once all that is made of them has been written itself."""
    for df in frames:
        delete(df.sparkSession, df._saved_at)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """At its end, delete what ``saved`` has written in this block; what is used after it has to be materialised in it."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            delete(spark, path)


def give_back() -> None:
    """Return what Arrow and the C library hold of freed memory to the system, where they can: workers are kept."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | list[pa.RecordBatch] | None], schema: T.StructType | str, limit: int = 8 << 20, last: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` over slices of bounded bytes, so that very long texts never meet in one Python list.

    What Arrow has freed goes back to the system after some slices: workers outlive their stage. ``last`` is called
    at the end of each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        try:
            for batch in batches:
                for part in slices(batch, limit):
                    out, done = fn(part), done + part.nbytes
                    if done >= 8 << 20 or limit >= 8 << 20:
                        pa.default_memory_pool().release_unused()
                        done = 0
                    if out is None:
                        continue
                    yield from out if isinstance(out, list) else [out]
        finally:
            if last:
                last()
            give_back()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of about ``limit`` bytes each; a single longer row stays whole."""
    if batch.num_rows < 2 or batch.nbytes <= limit:
        yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), limit)
    yield from slices(batch.slice(half), limit)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column out of one array per row."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def rows_of(column: pa.Array) -> list[np.ndarray]:
    """One numpy array per row of a list column; null rows are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [flat[ends[i] : ends[i + 1]] if valid[i] else flat[:0] for i in range(len(column))]


def fnv(*values: Column) -> Column:
    """A 64-bit hash of columns, nulls included."""
    return F.xxhash64(*values)


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Number the rows densely from 0 in ``order`` (nulls first, ties in any fixed order), without one global window.

    Rows are range-partitioned and sorted; each gets its place in its partition plus the rows of the partitions
    before it. ``df`` should be materialised: range partitioning samples it first.
    """
    from pyspark.sql import Window as W

    by = [F.col(c).asc_nulls_first() for c in order]
    ranged = materialise(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_n", F.monotonically_increasing_id()))
    part, place = F.shiftright("_n", 33), F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    # One row a partition, whose number is bounded by the shuffle partitions: safe to order and to broadcast.
    before = ranged.groupBy(part.alias("_part")).count().select("_part", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + place).drop("_part", "_before", "_n")
