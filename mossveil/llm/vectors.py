"""Embedding near-dedup by randomised-rotation binary codes.

Vectors are scaled to length 1, padded and rotated at random; the signs of the rotated coordinates are the code,
and the correction factor stored with it (the inner product of the vector and its code) makes the estimate of the
inner product with any other vector unbiased, with an error bound that falls with the code's length. The signs of a
second, longer rotation are cut into runs, the hash tables in which vectors meet.

What travels to the tables is the code, its factor and the vector rounded to one byte a component, with the length of
what rounding took, which widens the bound. The vectors themselves are sent only to the pieces of work in which a pair
of theirs has an upper confidence bound that reaches the threshold; there they are computed in double precision, and
only what is computed can become a link.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossveil.llm.blocks import by_groups, deal, local_roots, sides
from mossveil.llm.common import lists, map_arrow, materialise, numbered, rows_of, saved
from mossveil.llm.components import components

#: Bound of the estimate in standard errors of the code; beyond it a pair at the threshold is missed 1 time in 10^4.
ERRORS = 4.0


@functools.lru_cache(maxsize=8)
def rotation(dim: int, bits: int, seed: int = 5) -> np.ndarray:
    """``dim`` orthonormal columns in ``bits`` dimensions: a random rotation of the padded vectors."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))
    return q * np.sign(np.diag(r))


def code_width(dim: int) -> int:
    """Bits of the code: at least 128 and twice the dimension, in whole bytes."""
    return max(128, -(-2 * dim // 8) * 8)


def tables(count: int, threshold: float, recall: float, bucket: int = 128) -> tuple[int, int]:
    """Bits and number of the hash tables: buckets of some ``bucket`` unrelated vectors, tables for the target recall.

    A bucket costs little more than sending its vectors, so wide buckets pay: they need fewer tables. A recall of 1
    has one table without bits, in which all vectors meet.
    """
    if recall >= 1:
        return 0, 1
    bits = min(max(round(math.log2(max(count, 1) / bucket)), 4), 24)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def units(rows: list[np.ndarray]) -> list[np.ndarray | None]:
    """Vectors in double precision at length 1; None for empty, zero or non-finite ones (nulls come as NaN)."""
    out = []
    for r in rows:
        v = np.asarray(r, np.float64)
        top = np.abs(v).max(initial=0.0)
        out.append(v / top / np.linalg.norm(v / top) if top > 0 and np.isfinite(top) else None)
    return out


def near_vectors(df: DataFrame, threshold: float = 0.9, recall: float = 0.995, block: int = 512) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``df`` (``vec_id``, ``embedding``); other columns play no part.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, as do rows with a
    null ``vec_id`` and vectors of different dimensions among each other. Equal vectors are one class, of which
    only the smallest id is compared. ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest id that links reach. A ``vec_id`` that comes twice is two rows: linked with each other if their vectors
    are near or equal, else each with links and a component of its own. An empty table gives no rows.

    Links are exact, but not all are found: the number of vectors (one count) sets the tables' bits and number, and so
    which of the links near the threshold ``recall`` leaves out. With a recall of 1 every pair of different vectors is
    computed, in blocks.
    """
    base = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bits, number = tables(base.count(), threshold, recall)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = units([np.asarray(r, np.float64) for r in rows_of(batch.column("embedding"))])
        keys, hashes, codes, factors, rough, steps, misses = [], [], [], [], [], [], []
        for v in vectors:
            if v is None:
                for column in (keys, codes, factors, rough, steps, misses):
                    column.append(None)
                hashes.append(np.empty(0, np.int64))
                continue
            rotated = rotation(len(v), code_width(len(v))) @ v
            signs = rotation(len(v), max(bits * number, len(v)), 7) @ v >= 0
            table = signs[: bits * number].reshape(number, bits) @ (1 << np.arange(bits))
            keys.append(hashlib.md5(v.tobytes()).hexdigest())
            hashes.append(table)
            codes.append(np.packbits(rotated >= 0).tobytes()), factors.append(float(np.abs(rotated).sum() / math.sqrt(len(rotated))))
            step = float(np.abs(v).max()) / 127
            small = np.rint(v / step).astype(np.int8)
            rough.append(small.tobytes()), steps.append(step), misses.append(float(np.linalg.norm(v - step * small)))
        vectors = lists([np.empty(0) if v is None else v for v in vectors], pa.float64())
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.string()), vectors, pa.array(codes, pa.binary()), pa.array(factors, pa.float64()), pa.array(rough, pa.binary()), pa.array(steps, pa.float64()), pa.array(misses, pa.float64()), lists(hashes, pa.int32())], ["vec_id", "key", "unit", "code", "factor", "rough", "step", "miss", "buckets"])

    coded = saved(map_arrow(base, encode, "vec_id long, key string, unit array<double>, code binary, factor double, rough binary, step double, miss double, buckets array<int>"), "vectors")
    linkable = coded.where("key IS NOT NULL AND vec_id IS NOT NULL")
    # Nodes are classes, numbered in order of their smallest ids.
    classes = materialise(linkable.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    classes = materialise(numbered(classes, ["rep", "key"], "node"))
    firsts = linkable.join(classes.select("key", F.col("rep").alias("vec_id"), "node", "copies"), ["key", "vec_id"])
    firsts = saved(firsts.select("node", "copies", "unit", "code", "factor", "rough", "step", "miss", "buckets"), "classes")
    # Vectors of different dimensions never share a bucket.
    members = firsts.select("node", F.size("unit").cast("long").alias("dim"), F.posexplode("buckets").alias("table", "run"))
    members = members.select("node", "table", (F.col("dim") * (1 << 32) + F.col("run")).alias("bucket")).distinct()
    busy = members.groupBy("table", "bucket").count().where("count > 1").drop("count")
    dealt = deal(members.join(busy, ["table", "bucket"], "left_semi"), ["table", "bucket"], "node", block)
    work = dealt.select("node", "table", "bucket", F.col("_block").alias("block"), F.explode("_work").alias("w")).select("node", "table", "bucket", "block", "w.left", "w.right")
    coded_pieces = work.join(firsts.select("node", "code", "factor", "rough", "step", "miss"), "node")

    def screen(batch: pa.RecordBatch, bounds: np.ndarray) -> list[pa.RecordBatch]:
        """Of each piece, the nodes that have another one in it whose bound reaches the threshold."""
        node, block_of, left, right = (batch.column(c).to_numpy() for c in ("node", "block", "left", "right"))
        factors, steps, misses = (batch.column(c).to_numpy() for c in ("factor", "step", "miss"))
        codes, rough = batch.column("code").to_pylist(), batch.column("rough").to_pylist()
        chosen = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            nodes, at = np.unique(node[a:b], return_index=True)  # repeated rows of one id count once
            if len(nodes) < 2:
                continue
            at += a
            meet = sides(block_of[at], left[a], right[a])
            if recall < 1:
                x = np.frombuffer(b"".join([rough[i] for i in at]), np.int8).reshape(len(at), -1) * steps[at][:, None]
                width, factor = code_width(x.shape[1]), factors[at]
                signs = np.unpackbits(np.frombuffer(b"".join([codes[i] for i in at]), np.uint8).reshape(len(at), -1), axis=1)
                estimate = (2.0 * signs - 1) @ (x @ rotation(x.shape[1], width).T).T / (math.sqrt(width) * factor[:, None])
                error = ERRORS * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / (width - 1))[:, None] + misses[at][None, :] / factor[:, None]
                meet &= estimate + error >= threshold
            meet = np.triu(meet)
            chosen.append(at[meet.any(0) | meet.any(1)])
        return [batch.select(["node", "table", "bucket", "block", "left", "right"]).take(pa.array(np.concatenate(chosen) if chosen else np.empty(0, np.int64)))]

    keys = ["table", "bucket", "left", "right"]
    screened = by_groups(coded_pieces, keys, screen, "node long, table int, bucket long, block int, left int, right int")
    # The runs before the table's own say which pairs have met already.
    pieces = screened.join(firsts.select("node", "copies", "unit", "buckets"), "node").withColumn("buckets", F.slice("buckets", F.lit(1), F.col("table")))

    def verify(batch: pa.RecordBatch, bounds: np.ndarray) -> list[pa.RecordBatch]:
        node, copies, block_of, left, right, table = (batch.column(c).to_numpy() for c in ("node", "copies", "block", "left", "right", "table"))
        units, runs = rows_of(batch.column("unit")), rows_of(batch.column("buckets"))
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            nodes, at = np.unique(node[a:b], return_index=True)
            if len(nodes) < 2:
                continue
            at += a
            x = np.stack([units[i] for i in at])
            near = np.triu(sides(block_of[at], left[a], right[a])) & (x @ x.T >= threshold - 1e-9)
            i, j = np.nonzero(near)
            near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            if table[a]:  # pairs that share a run of an earlier table are counted there
                before = np.stack([runs[k] for k in at])
                near[near] = ~(before[i[near]] == before[j[near]]).any(1)
            i, j = i[near], j[near]
            if not len(i):
                continue
            links = np.zeros((len(nodes), len(nodes)), bool)
            links[i, j] = links[j, i] = True
            linked = links.any(1)
            out.append(pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array((links * copies[at][None, :]).sum(1)[linked], pa.int64()), pa.array(local_roots(links, nodes)[linked])], ["node", "links", "root"]))
        return out

    found = materialise(by_groups(pieces, keys, verify, "node long, links long, root long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found, "node", "root").join(classes.select(F.col("node").alias("root"), F.col("rep").alias("low")), "root").select("node", "low")
    verdicts = classes.join(counts, "node", "left").join(roots, "node", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("low", "rep").alias("component_id"))
    joined = coded.select("vec_id", "key").join(verdicts, "key", "left")
    linked = F.col("key").isNotNull() & F.col("vec_id").isNotNull()
    out = joined.select("vec_id", F.when(linked, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.when(linked, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
