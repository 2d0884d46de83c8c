"""Token-id files: blocks of ids in canonical, length-limited Huffman code.

``write_tokens`` puts documents into ascending order by range partitioning, encodes their texts once, counts ids
over the whole corpus, and writes one row per block: its place in the corpus, its documents, the bit string, and
the bit offset of every 256th id. Blocks decode independently; the offsets let a table-driven decoder follow all
stretches of 256 ids at once. Code lengths (one small row per id in use) lie beside the blocks, from which the
canonical codes follow. Everything is written by Spark's committer in the folder given, so lost executors only
repeat their tasks, and any store that Spark reaches will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mossveil.llm.common import lists, map_arrow, rows_of, saved, slices
from mossveil.llm.tokens import tokens

#: Longest code in bits, ids to a block (documents are not split, so a longer one fills a block), ids to an offset.
MAX_BITS, BLOCK_IDS, STRETCH = 18, 1 << 17, 256

#: The last row of a partition has no documents but the counts of the partition's ids.
RAW = "part int, seq int, before long, doc_ids array<long>, doc_tokens array<long>, ids binary, used array<int>, times array<long>"
CODED = "part int, seq int, before long, doc_ids array<long>, doc_tokens array<long>, n_ids long, offsets array<long>, bits binary"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids without counts."""
    used = np.flatnonzero(counts)
    order = used[np.argsort(counts[used], kind="stable")]
    lengths = np.zeros(len(counts), np.uint8)
    if len(order) < 2:
        lengths[order] = 1
        return lengths
    limit = max(limit, int(np.ceil(np.log2(len(order)))))
    leaves, packages, levels = counts[order].astype(np.float64), np.empty(0), []
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(leaves))
        both = both[by]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take, depth = 2 * len(order) - 2, np.zeros(len(order), np.uint8)
    for leaf in reversed(levels):
        mine = int(leaf[:take].sum())
        depth[:mine] += 1
        take = 2 * (take - mine)
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if n := int(lengths[i]):
            code <<= n - last
            codes[i], last = code, n
            code += 1
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit string of the ids, in big-endian 32-bit words, and the bit offset of every STRETCH-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    words = np.zeros((int(ends[-1]) >> 5) + 2 if len(ids) else 0, np.uint32)
    if len(ids):
        word, value = at >> 5, codes[ids].astype(np.uint64) << (64 - size - (at & 31)).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] |= np.bitwise_or.reduceat((value >> np.uint64(32)).astype(np.uint32), first)
        words[word[first] + 1] |= np.bitwise_or.reduceat(value.astype(np.uint32), first)
    return words.astype(">u4").tobytes(), at[::STRETCH]


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each window of as many bits as the longest code has: the id and the length of its code."""
    width = max(int(lengths.max(initial=1)), 1)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (width - lengths[order].astype(np.int64))
    ids = np.zeros(1 << width, np.int32)
    steps = np.ones(1 << width, np.uint8)
    ids[: spans.sum()], steps[: spans.sum()] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return ids, steps, width


def unpack_bits(blocks: list[tuple[bytes, np.ndarray, int]], table: tuple[np.ndarray, np.ndarray, int]) -> list[np.ndarray]:
    """Ids of each (bits, offsets, count), all stretches of all blocks side by side."""
    ids, steps, width = table
    starts = np.cumsum([0, *(len(b) for b, _, _ in blocks)])
    data = np.frombuffer(b"".join(b for b, _, _ in blocks) + bytes(8), np.uint8)
    window = np.ascontiguousarray(np.lib.stride_tricks.as_strided(data, (len(data) - 4, 4), (1, 1))).view(">u4").ravel().astype(np.uint32)
    at = np.concatenate([8 * s + o for s, (_, o, _) in zip(starts, blocks)] or [np.empty(0, np.int64)])
    most = 8 * (len(window) - 1)
    out = np.empty((STRETCH, len(at)), np.int32)
    for i in range(STRETCH):
        key = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - width)
        out[i] = ids[key]
        at = np.minimum(at + steps[key], most)
    flat, result, k = out.T.reshape(-1), [], 0
    for _, o, n in blocks:
        result.append(flat[k * STRETCH : k * STRETCH + n])
        k += len(o)
    return result


def id_blocks(df: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """Documents (``doc_id``, ``text``) in ascending order as blocks of raw ids, each text encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tail = TaskContext.get().partitionId(), [] if end_id is None else [end_id]
        tail, seq, before, docs, parts, held = np.array(tail, np.int32), 0, 0, [], [], 0
        counts = np.zeros(0, np.int64)

        def row(ids: np.ndarray, used: np.ndarray | None = None) -> pa.RecordBatch:
            sizes = np.array([len(p) for p in parts], np.int64)
            times = None if used is None else counts[used]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([docs], pa.list_(pa.int64())), lists([sizes], pa.int64()), pa.array([ids.astype("<i4").tobytes()], pa.binary()), pa.array([used], pa.list_(pa.int32())), pa.array([times], pa.list_(pa.int64()))],
                ["part", "seq", "before", "doc_ids", "doc_tokens", "ids", "used", "times"],
            )

        def block() -> pa.RecordBatch:
            nonlocal counts
            ids = np.concatenate(parts)
            more = np.bincount(ids, minlength=len(counts))
            more[: len(counts)] += counts
            counts = more
            return row(ids)

        for whole in batches:
            for batch in slices(whole):
                for doc, ids in zip(batch.column("doc_id").to_pylist(), tokens(path).encode(batch.column("text").to_pylist())):
                    docs.append(doc)
                    parts.append(np.concatenate([ids, tail]))
                    held += len(parts[-1])
                    if held >= BLOCK_IDS:
                        yield block()
                        seq, before, docs, parts, held = seq + 1, before + held, [], [], 0
        if docs:
            yield block()
            before, docs, parts = before + held, [], []
        yield row(np.empty(0, np.int32), np.flatnonzero(counts))

    by = F.col("doc_id").asc_nulls_first()
    return df.select(F.col("doc_id").cast("long"), "text").repartitionByRange(by).sortWithinPartitions(by).mapInArrow(run, RAW)


def write_tokens(df: DataFrame, path: str, folder: str, end_id: int | None = None) -> None:
    """Write the ids of ``df`` (``doc_id``, ``text``; null texts are empty) to ``folder``, ascending by ``doc_id``.

    Equal or null ``doc_id`` values are kept, nulls first, and repeated rows each for itself. Other columns play no
    part. A text longer than a block fills one by itself. An empty table gives an empty file set that reads back as
    no rows.
    """
    raw = saved(id_blocks(df, path, end_id), "ids")

    # One row for each id of the vocabulary at most, and one for each range partition.
    ends = raw.where("used IS NOT NULL")
    found = ends.select(F.explode(F.arrays_zip("used", "times")).alias("c")).groupBy("c.used").agg(F.sum("c.times").alias("n")).collect()
    sizes = ends.select("part", F.col("before").alias("n")).collect()
    counts = np.zeros(max([r["used"] for r in found], default=0) + 1, np.int64)
    for r in found:
        counts[r["used"]] = r["n"]
    parts = dict(sorted((r["part"], r["n"]) for r in sizes))
    shift = dict(zip(parts, np.cumsum([0, *parts.values()]).tolist()))
    lengths = code_lengths(counts)
    codes = canonical(lengths)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(b, "<i4") for b in batch.column("ids").to_pylist()]
        coded = [pack_bits(i, codes, lengths) for i in ids]
        first = [b + shift[p] for p, b in zip(batch.column("part").to_pylist(), batch.column("before").to_pylist())]
        return pa.RecordBatch.from_arrays(
            [batch.column("part"), batch.column("seq"), pa.array(first, pa.int64()), batch.column("doc_ids"), batch.column("doc_tokens"), pa.array([len(i) for i in ids], pa.int64()), lists([o for _, o in coded], pa.int64()), pa.array([b for b, _ in coded], pa.binary())],
            ["part", "seq", "before", "doc_ids", "doc_tokens", "n_ids", "offsets", "bits"],
        )

    spark = df.sparkSession
    map_arrow(raw.where("used IS NULL").drop("used", "times"), encode, CODED).write.option("compression", "none").parquet(f"{folder}/blocks")
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id int, length int").coalesce(1).write.parquet(f"{folder}/codes")


def read_tokens(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens`` and ``ids`` (array of int), or with ``digest`` their ``ids_crc32`` instead.

    One row for each row that was written, null and repeated ids and empty texts among them (then of the end id alone,
    if there is one). Blocks are read one by one, so a long document is one row of one task; files of an empty table
    give no rows.
    """
    book = spark.read.schema("id int, length int").parquet(f"{folder}/codes").collect()  # vocabulary-sized
    lengths = np.zeros(max([r["id"] for r in book], default=0) + 1, np.uint8)
    for r in book:
        lengths[r["id"]] = r["length"]

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = decode_table(lengths)
        blocks = list(zip(batch.column("bits").to_pylist(), rows_of(batch.column("offsets")), batch.column("n_ids").to_pylist()))
        ids, sizes = unpack_bits(blocks, table), rows_of(batch.column("doc_tokens"))
        docs = [d for row in batch.column("doc_ids").to_pylist() for d in row]
        starts = [f + np.cumsum(s) - s for f, s in zip(batch.column("before").to_pylist(), sizes)]
        each = [p for i, s in zip(ids, sizes) for p in np.split(i, np.cumsum(s)[:-1])]
        last = pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in each], pa.int64()) if digest else lists(each, pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(np.concatenate(starts), pa.int64()), pa.array(np.concatenate(sizes), pa.int64()), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    blocks = spark.read.schema(CODED).parquet(f"{folder}/blocks")
    return map_arrow(blocks, decode, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<int>'}")
