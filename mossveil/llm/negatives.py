"""Hard-negative mining with a pivot table.

1. A vector x of length at most M gets one more component, sqrt(M^2 - |x|^2), and an anchor q a 0 there; then
   |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the largest inner products are the smallest Euclidean distances.
2. The pivot table has each vector's distances to some fixed pivots. By the triangle inequality, |d(q, p) - d(x, p)| and
   d(q, p) + d(x, p) bracket the distance of q and x for every pivot p, and so their score.
3. Vectors lie in blocks by their nearest pivot, anchors likewise. The ranges of the distances of two blocks bracket all
   their scores: pairs of blocks that cannot hold a result are never sent anywhere. Of the rest, a block of anchors
   meets its rows as a stream, best bracket first; rows whose bracket cannot reach what has been found are passed
   over, and the survivors are scored exactly in whole numbers.

First come the positives (rows of an anchor's label), then, within the bounds that their scores set, the negatives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mossveil.llm.common import lists, map_arrow, materialise, rows_of, saved

#: Whole components are held to this, so that scores of up to 1,024 dimensions stay whole numbers of 64 bits.
LARGEST = 1 << 26
#: Brackets are wider than computed by this share of the greatest length, far more than rounding takes.
SLACK = 1e-5
#: Rows of a stream at least, as each stream gives up to ``negatives`` rows for every bound of its anchors.
STREAM = 4096


def whole(rows: list[np.ndarray], scale: float) -> list[np.ndarray]:
    return [np.clip(np.floor(scale * r), -LARGEST, LARGEST).astype(np.int32) for r in rows]


def padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def farthest(sample: np.ndarray, number: int) -> np.ndarray:
    """Rows of the sample that lie far from each other: the first, then always the one farthest from those chosen."""
    chosen, away = [0], np.full(len(sample), np.inf)
    for _ in range(min(number, len(sample)) - 1):
        away = np.minimum(away, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
        chosen.append(int(away.argmax()))
    return sample[chosen]


def best(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k rows a group with the highest scores, ties by the smaller id; an id counts once a group."""
    order = np.lexsort((-scores, ids, groups))
    g, i = groups[order], ids[order]
    once = np.ones(len(order), bool)
    once[1:] = (g[1:] != g[:-1]) | (i[1:] != i[:-1])
    order = order[once]
    order = order[np.lexsort((ids[order], -scores[order], groups[order]))]
    g = groups[order]
    first = np.searchsorted(g, g, "left")
    return order[np.arange(len(order)) - first < k]


class Pivots:
    """The pivots with their added component, the greatest length M, and the distances to them."""

    def __init__(self, sample: np.ndarray, most: int, number: int):
        self.square = float(most)
        self.points = farthest(self.lifted(sample.astype(np.float64)), number)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.square - (x * x).sum(1, keepdims=True), 0))])

    def distances(self, x: np.ndarray) -> np.ndarray:
        gap = (x * x).sum(1)[:, None] + (self.points * self.points).sum(1)[None, :] - 2 * x @ self.points.T
        return np.sqrt(np.maximum(gap, 0))


def hard_negatives(df: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, pivots: int = 16, sample: int = 1024, block: int = 4096, anchors: int = 1024, lanes: int | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the anchors of ``df``.

    Rows are ``vec_id, embedding, label``; ``anchor`` says which are anchors. Those with a null id, label or vector,
    or a null or non-finite component, take no part; an empty vector is one of zeros, and a shorter one counts as if
    filled up with zeros. Components become floor(``scale`` x) (held to 2^26 on either side) and a score is their inner
    product. An anchor's positives are the first ``positives`` other rows of its label, and the negatives of each are
    the first ``negatives`` rows of another label with ``low`` positive_score <= 100 negative_score <= ``high``
    positive_score; fewer where there are fewer. Higher scores come first, ties by the smaller id. Of rows that repeat
    an id, the anchor is the one of the smallest label, then vector; as a positive or negative an id counts once, with
    its best score there, and never for itself. An empty table gives no rows; other columns play no part.

    Pivots come from ``sample`` rows of the lowest hashes, whatever the size of the table; they change the work, never
    the result. What travels: the rows of each pair of blocks that its bracket leaves, once for each ``anchors``
    anchors; with vectors that no pivot tells apart, that is all rows for each of them.
    """
    spark = df.sparkSession
    given = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    given = given.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)

    def floors(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = whole(rows_of(batch.column("embedding")), scale)
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("anchor"), lists(rows, pa.int32()), pa.array([int((r.astype(np.int64) ** 2).sum()) for r in rows], pa.int64())], ["vec_id", "label", "anchor", "x", "square"])

    made = saved(map_arrow(given, floors, "vec_id long, label long, anchor boolean, x array<int>, square long"), "whole-vectors")
    facts = made.agg(F.max("square").alias("most"), F.max(F.size("x")).alias("width"), F.count_if("anchor").alias("anchors"), F.count("*").alias("rows")).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not facts.anchors:
        return spark.createDataFrame([], result)
    width, lanes = facts.width, lanes or max(1, min(math.ceil(facts.rows / STREAM), math.ceil(4 * int(spark.conf.get("spark.sql.shuffle.partitions")) * anchors / facts.anchors)))
    lowest = made.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("x").toArrow()
    table = Pivots(padded(rows_of(lowest.column("x")), width), facts.most, pivots)
    number = len(table.points)
    # Anchors are told apart by so many pivots as their number fills blocks.
    coarse = max(1, min(number, facts.anchors // anchors))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = padded(rows_of(batch.column("x")), width).astype(np.float64)
        far = table.distances(table.lifted(x))
        asked = table.distances(np.hstack([x, np.zeros((len(x), 1))]))
        columns = [batch.column(c) for c in ("vec_id", "label", "anchor", "x", "square")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(far.argmin(1), pa.int32()), pa.array(asked[:, :coarse].argmin(1), pa.int32()), lists(list(far), pa.float32()), lists(list(asked), pa.float32())], ["vec_id", "label", "anchor", "x", "square", "cell", "side", "far", "asked"])

    placed = saved(map_arrow(made, place, "vec_id long, label long, anchor boolean, x array<int>, square long, cell int, side int, far array<float>, asked array<float>"), "pivot-table")
    queries = placed.where("anchor").groupBy("vec_id").agg(F.min_by(F.struct("label", "x", "square", "side", F.col("asked").alias("far")), F.struct("label", "x")).alias("q")).select("vec_id", "q.*")
    queries = saved(queries, "anchors")
    slack, most = SLACK * max(math.sqrt(facts.most), 1.0), float(facts.most)

    # For the positives, blocks are of one label.
    first = in_blocks(queries, ["label", "side"], anchors)
    same = in_blocks(placed, ["label", "cell"], block)
    met = bracketed(ranges(first, number, "a", "label"), ranges(same, number, "d", "label"), "label", number, slack, most)
    # What so many rows surely reach, no row below need be looked at for (one row more, as an anchor may be among them).
    sure = F.sum("d_rows").over(W.partitionBy("a_block").orderBy(F.desc("lowest"), "d_block"))
    enough = F.max(F.when(F.col("_sure") >= positives + 1, F.col("lowest"))).over(W.partitionBy("a_block"))
    met = met.withColumn("_sure", sure).withColumn("_least", enough).where("_least IS NULL OR highest >= _least")
    found = streamed(first.withColumn("bounds", F.lit(None).cast("array<struct<id:long,low:long,high:long,score:long>>")), same, met, lanes, positives, width, slack, most, True)
    ranked = W.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    chosen = materialise(found.withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= positives).select("anchor_id", F.col("id").alias("positive_id"), "score"))

    hundredths = lambda n: F.col("score").cast("decimal(20,0)") * F.lit(n).cast("decimal(9,0)") / F.lit(100).cast("decimal(3,0)")
    bounds = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.ceil(hundredths(low)).cast("long").alias("low"), F.floor(hundredths(high)).cast("long").alias("high"), "score"))).alias("bounds"))
    asked = saved(in_blocks(queries.join(bounds, "vec_id"), ["side"], anchors), "bounded-anchors")
    every = in_blocks(placed, ["cell"], block)
    wanted = asked.groupBy(F.col("block").alias("a_block")).agg(F.min(F.array_min(F.transform("bounds", lambda b: b["low"]))).alias("_low"), F.max(F.array_max(F.transform("bounds", lambda b: b["high"]))).alias("_high"))
    met = bracketed(ranges(asked, number, "a"), ranges(every, number, "d"), None, number, slack, most)
    met = met.join(wanted, "a_block").where("highest >= _low AND lowest <= _high")
    found = streamed(asked, every, met, lanes, negatives, width, slack, most, False)
    ranked = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    out = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), F.col("positive_score"), F.col("score").alias("negative_score"))


def in_blocks(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Add ``block``, of some ``size`` rows with equal keys; a group of any size is split by a hash of the id."""
    counts = df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("_parts"))
    counts = counts.select(*[F.col(k).bitwiseXOR(F.lit(0)).cast(df.schema[k].dataType).alias(k) for k in keys], "_parts")
    part = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.col("_parts"))
    return df.join(counts, keys).withColumn("block", F.concat_ws("-", *keys, part)).drop("_parts")


def ranges(df: DataFrame, number: int, name: str, *keys: str) -> DataFrame:
    """Of each block: its rows, the ranges of the distances to every pivot, and of the squared lengths."""
    far = [F.get("far", F.lit(i)) for i in range(number)]
    rows = df.groupBy(*keys, F.col("block").alias(f"{name}_block")).agg(F.count("*").alias(f"{name}_rows"), F.min("square").alias(f"{name}_short"), F.max("square").alias(f"{name}_long"), F.array(*[F.min(x) for x in far]).alias(f"{name}_near"), F.array(*[F.max(x) for x in far]).alias(f"{name}_far"))
    return materialise(rows)


def bracketed(anchors: DataFrame, rows: DataFrame, key: str | None, number: int, slack: float, most: float) -> DataFrame:
    """Pairs of blocks with the least and greatest score that any anchor and row in them can have."""
    pairs = anchors.join(rows, key) if key else anchors.join(rows, F.lit(True))  # summaries of blocks, some thousand rows each
    at = lambda c, i: F.get(c, F.lit(i))
    least = F.greatest(F.lit(0.0), *[F.greatest(at("a_near", i) - at("d_far", i), at("d_near", i) - at("a_far", i)) - slack for i in range(number)])
    # least() and greatest() take two arguments or more.
    greatest = F.least(F.lit(float("inf")), *[at("a_far", i) + at("d_far", i) + slack for i in range(number)])
    highest = (F.col("a_long") + most - least * least) / 2 + rounding(most)
    lowest = (F.col("a_short") + most - greatest * greatest) / 2 - rounding(most)
    return pairs.select("a_block", "d_block", "d_rows", highest.alias("highest"), lowest.alias("lowest"))


def rounding(most: float) -> float:
    """What the doubles of a bracket of scores can be wrong by at most."""
    return 1 + 1e-9 * most


def streamed(anchors: DataFrame, rows: DataFrame, met: DataFrame, lanes: int, k: int, width: int, slack: float, most: float, same: bool) -> DataFrame:
    """The best k rows of each anchor (``same`` label) or of each of its bounds (another label), by lane.

    An anchor block's rows come in ``lanes`` streams, dealt by id; a stream may be of any length, as a task holds the
    anchors, the best so far, and one batch of rows.
    """
    needed = met.select("a_block").distinct()
    lane = F.pmod(F.xxhash64("vec_id", F.lit(13)), F.lit(lanes)).cast("int")
    empty = F.lit(None)
    a = anchors.join(needed, F.col("block") == F.col("a_block"), "left_semi").select(F.col("block").alias("a_block"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), empty.cast("double").alias("highest"), F.lit("").alias("d_block"), "vec_id", "label", "x", "far", "bounds")
    d = rows.join(met.select("a_block", "highest", F.col("d_block").alias("block")), "block").select("a_block", lane.alias("lane"), "highest", F.col("block").alias("d_block"), "vec_id", "label", "x", "far", empty.cast("array<struct<id:long,low:long,high:long,score:long>>").alias("bounds"))
    work = a.union(d).repartition("a_block", "lane").sortWithinPartitions("a_block", "lane", F.desc_nulls_first("highest"), "d_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key = None, None
        for batch in batches:
            blocks, lanes_of = batch.column("a_block").to_pylist(), batch.column("lane").to_pylist()
            cuts = [0, *[i for i in range(1, len(blocks)) if blocks[i] != blocks[i - 1] or lanes_of[i] != lanes_of[i - 1]], len(blocks)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if (blocks[a], lanes_of[a]) != key:
                    if now:
                        yield now.result()
                    now, key = Search(k, width, slack, most, same), (blocks[a], lanes_of[a])
                now.take(batch.slice(a, b - a))
        if now:
            yield now.result()

    return work.mapInArrow(run, "anchor_id long, positive_id long, positive_score long, id long, score long")


class Search:
    """The best rows of a block of anchors over a stream of rows; every bound of an anchor has a list of its own."""

    def __init__(self, k: int, width: int, slack: float, most: float, same: bool):
        self.k, self.width, self.slack, self.most, self.same = k, width, slack, most, same
        self.given: list[pa.RecordBatch] = []
        self.ready = False

    def take(self, batch: pa.RecordBatch) -> None:
        new = batch.column("highest").is_valid().to_numpy(zero_copy_only=False)
        n = int((~new).sum())  # anchors come first
        if n:
            self.given.append(batch.slice(0, n))
        if n < batch.num_rows:
            if not self.ready:
                self.start()
            self.search(batch.slice(n))

    def start(self) -> None:
        whole = pa.Table.from_batches(self.given).combine_chunks()
        self.ids, self.labels = whole.column("vec_id").to_numpy(), whole.column("label").to_numpy()
        self.x = padded(rows_of(whole.column("x")), self.width)
        self.far = np.stack(rows_of(whole.column("far"))).astype(np.float64)
        bounds = [b or [None] for b in whole.column("bounds").to_pylist()]
        self.owner = np.repeat(np.arange(len(bounds)), [len(b) for b in bounds])
        flat = [b for of in bounds for b in of]
        self.low = np.array([np.iinfo(np.int64).min if b is None else b["low"] for b in flat])
        self.high = np.array([np.iinfo(np.int64).max if b is None else b["high"] for b in flat])
        self.about = [(None, None) if b is None else (b["id"], b["score"]) for b in flat]
        self.square = (self.x.astype(np.float64) ** 2).sum(1)
        self.slot, self.score, self.found = (np.empty(0, np.int64) for _ in range(3))
        self.least = self.low.copy()
        self.ready, self.step = True, 64

    def search(self, batch: pa.RecordBatch) -> None:
        ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        x, far = padded(rows_of(batch.column("x")), self.width), np.stack(rows_of(batch.column("far"))).astype(np.float64)
        near, wide = self.far.min(0), self.far.max(0)
        at = 0
        while at < len(ids):
            part = np.arange(at, min(at + self.step, len(ids)))
            at, self.step = at + len(part), min(self.step * 4, 2048)
            # Rows by the bracket of their distance to all anchors of the block.
            gap = np.maximum(near - far[part], far[part] - wide).max(1)
            gap = np.maximum(gap - self.slack, 0)
            reach = (far[part] + wide).min(1) + self.slack
            highest = (self.square.max() + self.most - gap**2) / 2 + rounding(self.most)
            lowest = (self.square.min() + self.most - reach**2) / 2 - rounding(self.most)
            part = part[(highest >= self.least.min()) & (lowest <= self.high.max())]
            if len(part):
                self.check(ids[part], labels[part], x[part])

    def check(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        """Exact scores of the survivors, and the new best."""
        if float(np.abs(self.x).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(self.width, 1) < 2**53:
            scores = self.x.astype(np.float64) @ x.T.astype(np.float64)  # whole numbers, exact in doubles
        else:
            scores = self.x @ x.T
        right = (self.labels[:, None] == labels[None, :]) == self.same
        right &= self.ids[:, None] != ids[None, :]
        size = len(self.ids)
        floor, top = np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)
        np.minimum.at(floor, self.owner, self.least)
        np.maximum.at(top, self.owner, self.high)
        right &= (scores >= floor[:, None]) & (scores <= top[:, None])
        i, j = np.nonzero(right)
        if not len(i):
            return
        value = scores[i, j].astype(np.int64)
        first, last = np.searchsorted(self.owner, i, "left"), np.searchsorted(self.owner, i, "right")
        slot, row, got = [self.slot], [self.found], [self.score]
        for step in range(int((last - first).max())):
            mine = first + step < last
            s = (first + step)[mine]
            ok = (value[mine] >= self.least[s]) & (value[mine] <= self.high[s])
            slot.append(s[ok]), row.append(ids[j[mine][ok]]), got.append(value[mine][ok])
        slot, row, got = np.concatenate(slot), np.concatenate(row), np.concatenate(got)
        keep = best(slot, got, row, self.k)
        self.slot, self.found, self.score = slot[keep], row[keep], got[keep]
        # Once a list is full, only what reaches its last score can still come in.
        full = np.bincount(self.slot, minlength=len(self.low)) >= self.k
        last_score = np.full(len(self.low), np.iinfo(np.int64).max)
        np.minimum.at(last_score, self.slot, self.score)
        self.least = np.where(full, np.maximum(self.low, last_score), self.low)

    def result(self) -> pa.RecordBatch:
        if not self.ready:
            self.start()
        about = [self.about[s] for s in self.slot.tolist()]
        columns = [pa.array(self.ids[self.owner[self.slot]], pa.int64()), pa.array([p for p, _ in about], pa.int64()), pa.array([s for _, s in about], pa.int64()), pa.array(self.found, pa.int64()), pa.array(self.score, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["anchor_id", "positive_id", "positive_score", "id", "score"])
