"""N-gram Jaccard join: MinHash banding finds candidates, the full n-gram sets decide.

1. Every text gives the set of its word n-grams; texts of equal sets are one class, stood for by the smallest id.
2. Band and row counts are chosen for the target recall at the threshold; classes meet by their band hashes.
3. Candidates, which are the pairs that share a band and no others, are verified in blocks (``blocks.py``). Classes
   that band hashes connect make a component. Where comparing the whole component costs no more than comparing its
   buckets, it is the group to be compared, so each set is sent once however many bands agree; else its buckets are,
   and a pair counts in its first shared band. Which of the two it is changes the work, never the pairs.
4. Verified links are summed to counts and spanning links, whose connected components are the near-duplicate groups.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossveil.llm.blocks import by_group, deal, local_roots, sides
from mossveil.llm.common import lists, map_arrow, materialise, rows_of, saved, temporary
from mossveil.llm.components import components
from mossveil.llm.shingles import BASE, U64, mix, ngram_hashes, word_hashes


def choose_bands(threshold: float, recall: float, stray: float = 0.2) -> tuple[int, int]:
    """Bands and their rows: the fewest rows with which a pair of half the threshold shares a band at most ``stray``
    often, and the bands that give a pair at the threshold the target recall. A recall of 1 has one band without rows,
    which all sets share."""
    if recall >= 1:
        return 1, 0
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if 1 - (1 - (threshold / 2) ** rows) ** bands <= stray:
            break
    return bands, rows


def text_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    grams, ends = ngram_hashes(*word_hashes(texts), n)
    return [np.unique(grams[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def signatures(sets: list[np.ndarray], bands: int, rows: int, seed: int = 1) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each set its band hashes (none for an empty set) and a 128-bit key of the whole set."""
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sets), bands), np.int64)
    keys = np.zeros((2, len(sets)), U64)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        at = np.cumsum(sizes[full]) - sizes[full]
        random = np.random.default_rng(seed)
        factors = random.integers(1 << 63, size=(bands * rows, 2), dtype=U64) * U64(2) + U64(1)
        with np.errstate(over="ignore"):
            for b in range(bands):
                h = np.full(len(full), U64(b + 1))
                for a, c in factors[b * rows : (b + 1) * rows]:
                    h = mix(h * BASE + np.minimum.reduceat(flat * a + c, at))
                out[full, b] = h.view(np.int64)
            keys[0, full], keys[1, full] = np.add.reduceat(flat, at), np.add.reduceat(mix(flat), at)
    return [out[i] if sizes[i] else out[i, :0] for i in range(len(sets))], keys[0].view(np.int64), keys[1].view(np.int64)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999, block: int = 256) -> DataFrame:
    """``doc_id, n_links, group_id, kept`` for every row of ``docs`` (``doc_id``, ``text``); other columns play no part.

    Two rows are linked if the Jaccard similarity of their n-gram sets is at least ``threshold``; ``n_links`` counts
    the other rows linked to a row, copies included, ``group_id`` is the smallest ``doc_id`` that links reach, and
    ``kept`` says that it is the row's own. Words are ``[^\\x20\\x09-\\x0D]+``, case kept; a text of fewer than n
    words has one n-gram of all of them. Texts without words (null, empty, blank) and rows with a null ``doc_id``
    link with nothing (a null id has a null group and is kept). A ``doc_id`` that comes twice counts as two rows, also
    with one text; rows of one id share their group, and every row of a kept id is kept. An empty table gives no
    rows; the set of a very long text has to fit a task, and sets are compared two blocks at a time.
    """
    bands, rows = choose_bands(threshold, recall)

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = text_sets(batch.column("text"), n)
        signed, k1, k2 = signatures(sets, bands, rows)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array(k1), pa.array(k2), lists(signed, pa.int64())], ["doc_id", "size", "k1", "k2", "bands"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = saved(map_arrow(texts, sign, "doc_id long, size int, k1 long, k2 long, bands array<long>", 1 << 20), "signatures")
    linkable = signed.where("size > 0 AND doc_id IS NOT NULL")
    key = ["size", "k1", "k2"]
    classes = materialise(linkable.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))

    firsts = linkable.join(classes.select(*key, F.col("rep").alias("doc_id")), [*key, "doc_id"], "left_semi")
    members = firsts.select(F.col("doc_id").alias("rep"), F.posexplode("bands").alias("band", "hash")).distinct()
    buckets = members.groupBy("band", "hash").agg(F.count("*").alias("size"), F.min("rep").alias("low")).where("size > 1")
    shared = materialise(members.join(buckets, ["band", "hash"]))
    reached = materialise(components(shared, "rep", "low").select(F.col("node").alias("rep"), "root"))

    cost = shared.join(reached, "rep").groupBy("root").agg(F.sum("size").alias("by_bucket")).join(reached.groupBy("root").agg((F.count("*") * F.count("*")).alias("at_once")), "root")
    plan = materialise(reached.join(cost.select("root", (F.col("at_once") <= F.col("by_bucket")).alias("whole")), "root"))
    groups = plan.where("whole").select(F.lit(-1).alias("band"), F.col("root").alias("group"), "rep").union(shared.join(plan.where("NOT whole").select("rep"), "rep", "left_semi").select("band", "hash", "rep"))
    dealt = deal(groups, ["band", "group"], "rep", block)
    work = dealt.groupBy("rep").agg(F.collect_list(F.struct("band", "group", "_block", "_work")).alias("_todo"))
    work = work.join(classes.select("rep", "copies", *key), "rep")

    def open_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = text_sets(batch.column("text"), n)
        signed, k1, k2 = signatures(sets, bands, rows)
        mine = pa.array((k1 == batch.column("k1").to_numpy()) & (k2 == batch.column("k2").to_numpy()))
        out = pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), batch.column("_todo"), lists([s.view(np.int64) for s in sets], pa.int64()), lists(signed, pa.int64())], ["rep", "copies", "_todo", "grams", "bands"])
        return out.filter(mine)

    todo = dict(work.dtypes)["_todo"]
    opened = map_arrow(texts.join(work.withColumnRenamed("rep", "doc_id"), "doc_id").select(F.col("doc_id").alias("rep"), "copies", "_todo", "k1", "k2", "text"), open_sets, f"rep long, copies long, _todo {todo}, grams array<long>, bands array<long>")
    pieces = opened.select("rep", "copies", "grams", "bands", F.explode("_todo").alias("t")).select("rep", "copies", "grams", "bands", "t.band", "t.group", F.col("t._block").alias("block"), F.explode("t._work").alias("w"))
    pieces = pieces.select("rep", "copies", "grams", "bands", "band", "group", "block", "w.left", "w.right")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        reps, at = np.unique(batch.column("rep").to_numpy(), return_index=True)  # repeated rows of one id count once
        if len(reps) < 2:
            return None
        sets = [s for i, s in enumerate(rows_of(batch.column("grams")))]
        sets = [sets[i] for i in at]
        copies = batch.column("copies").to_numpy()[at]
        meet = sides(batch.column("block").to_numpy()[at], batch.column("left")[0].as_py(), batch.column("right")[0].as_py())
        band = batch.column("band")[0].as_py()
        signed = np.stack(rows_of(batch.column("bands")))[at]
        if band < 0:
            shared = np.zeros(meet.shape, bool)
            for b in range(bands):
                shared |= signed[:, b][:, None] == signed[:, b][None, :]
            meet &= shared
        for b in range(band):  # such pairs are counted there
            meet &= signed[:, b][:, None] != signed[:, b][None, :]
        size = np.array([len(s) for s in sets])
        common = intersections(sets)
        links = meet & (common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9)
        linked = links.any(1)
        if not linked.any():
            return None
        ids, counts, roots = reps[linked], (links * copies[None, :]).sum(1)[linked], local_roots(links, reps)[linked]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts, pa.int64()), pa.array(roots)], ["rep", "links", "root"])

    found = materialise(by_group(pieces, ["band", "group", "left", "right"], verify, "rep long, links long, root long"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found, "rep", "root").select(F.col("node").alias("rep"), "root")
    verdicts = classes.join(counts, "rep", "left").join(roots, "rep", "left")
    verdicts = verdicts.select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("group_id"))
    joined = signed.drop("bands").join(verdicts, key, "left")
    alone = F.col("size").eqNullSafe(0) | F.col("doc_id").isNull()
    out = joined.select("doc_id", F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(alone, F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("group_id")))


def intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of membership matrices of bounded width."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grams, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1  # others are in no intersection
    number = np.cumsum(several) - 1
    owner, place = owner[several[place]], number[place[several[place]]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for low in range(0, int(several.sum()), columns):
        a, b = np.searchsorted(place, (low, low + columns))
        part = np.zeros((len(sets), columns), np.float32)
        part[owner[a:b], place[a:b] - low] = 1
        common += part @ part.T
    np.fill_diagonal(common, [len(s) for s in sets])
    return common


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near-duplicates: that of the smallest ``doc_id``.

    Of rows that share an id, all stay or none. Null ids, null and empty texts stay, as they link with nothing; all
    columns pass through, whatever their names. An empty table gives no rows.
    """
    with temporary(docs.sparkSession):
        gone = materialise(near_duplicates(docs, **options).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
