"""Comparing the members of groups in blocks: a group of any size becomes tasks of two blocks of bounded size.

The members of a group are dealt to blocks by a hash of their ids. Each unordered pair of blocks is one piece of
work, and a member is sent to every piece that its block takes part in; so a pair of members meets exactly once,
no task holds more than two blocks, and results are counts and spanning links rather than all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossveil.llm.common import give_back


def deal(members: DataFrame, keys: list[str], ident: str, size: int = 256) -> DataFrame:
    """Add ``_work`` (array of struct of left and right block) and ``_block`` to distinct (keys, ident) rows."""
    counts = members.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("_blocks"))
    # Joined by an expression, the counts get a shuffle of their own, and a hot group can be split.
    counts = counts.select(*[F.col(k).bitwiseXOR(F.lit(0)).alias(k) for k in keys], "_blocks")
    dealt = members.join(counts, keys).withColumn("_block", F.pmod(F.xxhash64(ident, F.lit(7)), F.col("_blocks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("_blocks") - 1)
    return dealt.withColumn("_work", F.transform(other, lambda o: F.struct(F.least("_block", o).alias("left"), F.greatest("_block", o).alias("right")))).drop("_blocks")


def by_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.RecordBatch, np.ndarray], list[pa.RecordBatch]], schema: str, then: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``fn`` to batches of whole groups, and to the bounds of the groups in them (one more than groups).

    Groups must be of bounded size. Rows are shuffled by the keys and sorted within partitions (within a group by
    ``then``), and the stream of Arrow batches is cut where a key changes, which costs far less than a call of Python per group from Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def changes(batch: pa.RecordBatch) -> np.ndarray:
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                c = batch.column(k).to_numpy(zero_copy_only=False)
                new[1:] |= c[1:] != c[:-1]
            return new

        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if parts:
                whole = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                bounds = np.concatenate([[0], np.flatnonzero(changes(whole)), [whole.num_rows]])
                yield from (out for out in fn(whole, bounds) if out.num_rows)

        for batch in batches:
            if not batch.num_rows:
                continue
            first, new = tuple(batch.column(k)[0].as_py() for k in keys), changes(batch)
            new[0] = last is not None and first != last
            last = tuple(batch.column(k)[-1].as_py() for k in keys)
            cut = int(np.flatnonzero(new)[-1]) if new.any() else None
            if cut is None:
                held.append(batch)
                continue
            if cut:
                held.append(batch.slice(0, cut))
            yield from done(held)
            held = [batch.slice(cut)]
        yield from done(held)
        held.clear()
        give_back()

    return df.repartition(*keys).sortWithinPartitions(*keys, *then).mapInArrow(run, schema)


def by_group(df: DataFrame, keys: list[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``by_groups`` for one group at a time."""

    def each(batch: pa.RecordBatch, bounds: np.ndarray) -> list[pa.RecordBatch]:
        made = (fn(batch.slice(a, b - a)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        return [out for out in made if out is not None]

    return by_groups(df, keys, each, schema)


def local_roots(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix of links: the smallest id that each member reaches."""
    roots = ids.copy()
    while True:
        best = np.where(links, roots[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
        lower = np.minimum(roots, best)
        if (lower == roots).all():
            return roots
        roots = lower


def sides(block: np.ndarray, left: int, right: int) -> np.ndarray:
    """Which pairs of members meet in this piece of work (boolean, symmetric, no self-pairs)."""
    if left == right:
        meet = np.ones((len(block), len(block)), bool)
    else:
        a = block == left
        meet = a[:, None] != a[None, :]
    np.fill_diagonal(meet, False)
    return meet
