"""Packing by powers of two: every document is cut into pieces of binary length, and equal lengths share a bucket.

A document of n ids gives n // size pieces of the full size and one piece for each set bit of the rest. Each piece
is a sequence by itself, so no sequence crosses documents and none needs padding; a trainer draws batches from one
bucket at a time.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mossveil.llm.common import lists, map_arrow, materialise, numbered
from mossveil.llm.tokens import REMEMBERED, tokens


def binary_pieces(n: int, size: int) -> list[int]:
    """Lengths of the pieces of n ids, longest first."""
    return [size] * (n // size) + [1 << b for b in reversed(range(size.bit_length() - 1)) if n % size >> b & 1]


def cut_pieces(df: DataFrame, path: str, size: int = 2048, end_id: int | None = 1, with_ids: bool = True, remembered: int = REMEMBERED, forget: bool = False) -> DataFrame:
    """Pieces of ``df`` (``doc_id``, ``text``): ``doc_id, start, length, ids_crc32, doc_tokens`` and ``ids`` if asked.

    Row-local. Null and empty texts consist of the end id alone (no piece if there is none); repeated rows are
    documents of their own; an empty table gives no rows; other columns play no part. ``size`` is a power of two. ``remembered``
    stretches of text at most keep their ids in a worker's memory, which changes no result; with ``forget`` only as
    long as a task, so that little is left beside the stages that follow. A long text is cut in one task, whole.
    """
    if size & (size - 1) or size < 1:
        raise ValueError("size must be a power of two")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        docs, starts, sizes, crcs, totals, pieces = [], [], [], [], [], []
        for doc, ids in zip(batch.column("doc_id").to_pylist(), tokens(path, remembered).encode(batch.column("text").to_pylist())):
            ids = ids if end_id is None else np.append(ids, np.int32(end_id))
            at = 0
            for n in binary_pieces(len(ids), size):
                piece = ids[at : at + n]
                docs.append(doc), starts.append(at), sizes.append(n), totals.append(len(ids))
                crcs.append(zlib.crc32(piece.astype("<u4").tobytes()))
                at += n
                if with_ids:
                    pieces.append(piece)
        columns = [pa.array(c, pa.int64()) for c in (docs, starts, sizes, crcs, totals)] + ([lists(pieces, pa.int32())] if with_ids else [])
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    return map_arrow(df.select("doc_id", "text"), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids, last=(lambda: tokens(path, remembered).forget()) if forget else None)


def pack(pieces: DataFrame) -> DataFrame:
    """Give each piece its ``sequence_id``, dense and in order of (length, doc_id, start), and ``offset`` 0.

    Null ids come first; pieces equal in all three (of rows that repeat an id) get numbers of their own, in any order.
    Columns of these two names are replaced, all others pass through; no pieces give no rows.
    """
    from pyspark.sql import functions as F

    return numbered(materialise(pieces), ["length", "doc_id", "start"], "sequence_id").withColumn("offset", F.lit(0).cast("long"))
