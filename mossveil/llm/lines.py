"""Line dedup by a deletion-neighbourhood join over words.

A line is dropped if an earlier line (by ``doc_id``, then line number) equals it, or is within one word edit
(insertion, deletion or substitution of a word) that leaves at least ``similarity`` of the longer line. Two lines are within one edit if deleting at most one word from
each leaves the same words; so every line gives the hashes of its variants with one word deleted, and of itself,
and lines meet where variants are equal.

To keep the neighbourhoods small, lines first meet by halves: of two lines within one edit, either the first half
of the words or the last is the same, so a line whose halves nobody shares has no neighbour, and one that shares
its first half needs only the variants that delete a word of its last. Nothing is lost by this. Equal lines are
one line throughout, and in each group of equal variants every line is paired with the earliest alone, so a group
of any size gives no more pairs than it has lines. Word edits of all pairs found are verified on the words.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossveil.llm.common import map_arrow, materialise, numbered, quoted, saved, temporary
from mossveil.llm.shingles import BASE, INVERSE, U64, mix, repeated, text_bytes, word_hashes

#: Scripts written without blanks, whose code points are words: Thai, Lao, Burmese, Khmer, kana and Han.
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
#: Texts are hashed by so many bytes at a time, whose arrays the processor's cache holds.
BYTES = 1 << 19
#: A second base, for 128-bit keys of lines.
OTHER = U64(0xD1B54A32D192ED03)


class Ranges:
    """Hashes of any ranges of a sequence of word hashes, each in constant time."""

    def __init__(self, words: np.ndarray, base: np.uint64 = BASE):
        n = len(words)
        self.power, self.back = np.ones(n + 1, U64), np.ones(n + 1, U64)
        with np.errstate(over="ignore"):
            self.power[1:] = np.cumprod(np.full(n, base), dtype=U64)
            self.back[1:] = np.cumprod(np.full(n, U64(pow(int(base), -1, 1 << 64))), dtype=U64)
            self.sums = np.zeros(n + 1, U64)
            np.cumsum(words * self.power[:n], dtype=U64, out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.back[a]


def spread(text: str) -> str:
    """A text with blanks around the code points that are words."""
    return text if text.isascii() else UNSPACED.sub(r" \1 ", text)


def least_words(similarity: float) -> int:
    """Words of the shortest line of which one may change: 5 at 0.8, and none has as many at 1."""
    return math.ceil(1 / (1 - similarity) - 1e-9) if similarity < 1 else 1 << 30


#: Bytes that begin the UTF-8 of a code point which UNSPACED may match.
LEADS = np.isin(np.arange(256), [0xE0, 0xE1, *range(0xE3, 0xEA), 0xEF, 0xF0])


def words_of_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, words before each line (one more than lines), and lines before each text."""
    texts = pc.fill_null(texts, "")
    data, offsets = text_bytes(texts)
    if LEADS[data].any():
        texts = pa.array([spread(t) for t in texts.to_pylist()], pa.string())
        data, offsets = text_bytes(texts)
    words, _, starts = word_hashes(texts, places=True)
    breaks = np.flatnonzero(data == 10)
    at = np.searchsorted(breaks, offsets) + np.arange(len(texts) + 1)
    begins = np.empty(at[-1], np.int64)
    begins[at[:-1]] = offsets[:-1]
    begins[np.arange(len(breaks)) + np.searchsorted(offsets, breaks, "right")] = breaks + 1
    return words, np.append(np.searchsorted(starts, begins), len(words)), at


def line_keys(words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each line, and its 128-bit key."""
    a, b = before[:-1], before[1:]
    return b - a, mix(Ranges(words).of(a, b)).view(np.int64), mix(Ranges(words, OTHER).of(a, b)).view(np.int64)


def half_keys(words: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    """Four keys a line: its first and last half at its own length, and at one word less (as the longer of a pair)."""
    a, b = before[:-1], before[1:]
    ranges, out = Ranges(words), []
    with np.errstate(over="ignore"):
        for length in (b - a, b - a - 1):
            length = np.maximum(length, 0)
            half, tag = length // 2, length.astype(U64) * U64(4)
            out.append(mix(ranges.of(a, a + half) + tag).view(np.int64))
            out.append(mix(ranges.of(b - (length - half), b) + tag + U64(1)).view(np.int64))
    return out


def deletions(words: np.ndarray, hits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place (-1: none) of the variants of one line which its shared halves call for."""
    n, places = len(words), []
    for bit, length in ((0, n), (2, n - 1)):
        half = length // 2
        if hits >> bit & 1:  # the first half is shared: the edit is in the rest
            places.append(np.arange(half, n))
        if hits >> bit & 2:
            places.append(np.arange(0, half + 1 if bit else half))
    places = np.unique(np.concatenate(places))
    ranges = Ranges(words)
    with np.errstate(over="ignore"):
        less = ranges.sums[places] + (ranges.sums[n] - ranges.sums[places + 1]) * INVERSE
        whole = [mix(ranges.sums[n : n + 1] + U64(n))] if hits & 3 else []
        hashes = np.concatenate([mix(less + U64(n - 1)), *whole])
    return hashes.view(np.int64), np.concatenate([places, np.full(len(whole), -1)])


def within_one_edit(a: list, b: list) -> bool:
    """Whether one inserted, deleted or substituted word at most turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def split_words(line: str) -> list[str]:
    return line.translate(BLANKS).split(" ") if line else []


#: White space between words becomes U+0020; runs of it leave empty words, which both sides of a comparison drop.
BLANKS = {c: " " for c in (9, 10, 11, 12, 13)}


def line_verdicts(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``doc_id, text_id, line_no`` of every line to be dropped; see ``dedup_lines``."""
    least = least_words(similarity)
    # A document is its id and the hash of its text.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, before, at = words_of_lines(batch.column("text"))
        n, k1, k2 = line_keys(words, before)
        keep = np.flatnonzero(n)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(at))
        no = np.arange(len(n)) - np.repeat(at[:-1], np.diff(at))
        short = n[keep] < least - 1  # not even the longer line of a pair could have so few and one more
        halves = [pa.array(h[keep], mask=short) for h in half_keys(words, before)]
        owner = owner[keep]
        again = repeated(owner, k1[keep], k2[keep], n[keep])
        doc_id, text_id = (pa.array(batch.column(c).to_numpy()[owner]) for c in ("doc_id", "text_id"))
        return pa.RecordBatch.from_arrays([doc_id, text_id, pa.array(no[keep], pa.int32()), pa.array(n[keep], pa.int32()), pa.array(k1[keep]), pa.array(k2[keep]), *halves, pa.array(again)], ["doc_id", "text_id", "line_no", "n", "k1", "k2", "h0", "h1", "h2", "h3", "again"])

    signed = saved(map_arrow(texts, sign, "doc_id long, text_id long, line_no int, n int, k1 long, k2 long, h0 long, h1 long, h2 long, h3 long, again boolean", BYTES), "lines")
    key = ["n", "k1", "k2"]
    # The earliest place of each line; of its places in one document only the first is asked.
    places = signed.where("NOT again").groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.min_by("text_id", "doc_id").alias("text_id"), F.min_by("line_no", "doc_id").alias("line_no"), *[F.min(h).alias(h) for h in ("h0", "h1", "h2", "h3")])
    places = materialise(places)

    halves = places.where("h0 IS NOT NULL").select("doc_id", "text_id", "line_no", F.posexplode(F.array("h0", "h1", "h2", "h3")).alias("side", "half"))
    shared = halves.groupBy("half").count().where("count > 1").select("half")
    hits = halves.join(shared, "half", "left_semi").groupBy("doc_id", "text_id", "line_no").agg(F.expr("bit_or(shiftleft(1, side))").alias("hits"))
    hits = numbered(materialise(hits), ["doc_id", "line_no", "text_id"], "line_id")

    wanted = hits.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("line_no", "hits", "line_id")).alias("_wanted"))

    def fetch(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, lines, found = [], [], []
        for text, wanted in zip(batch.column("text"), batch.column("_wanted").to_pylist()):
            split = text.as_py().split("\n")
            for w in wanted:
                ids.append(w["line_id"]), lines.append(spread(split[w["line_no"]])), found.append(w["hits"])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.string()), pa.array(found, pa.int32())], ["line_id", "line", "hits"])

    near = saved(map_arrow(texts.join(wanted, ["doc_id", "text_id"]).select("text", "_wanted"), fetch, "line_id long, line string, hits int").dropDuplicates(["line_id"]), "near")

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, before = word_hashes(batch.column("line"))
        parts = [deletions(words[before[i] : before[i + 1]], h) for i, h in enumerate(batch.column("hits").to_pylist())]
        sizes = [len(p[0]) for p in parts]
        ids = np.repeat(batch.column("line_id").to_numpy(), sizes)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[0] for p in parts])), pa.array(np.concatenate([p[1] for p in parts]), pa.int32()), pa.array(ids)], ["variant", "place", "line_id"])

    variants = map_arrow(near, emit, "variant long, place int, line_id long")
    # Of each variant: the earliest line as it is, and the earliest with a word deleted there, and anywhere.
    at_place = variants.groupBy("variant", "place").agg(F.min("line_id").alias("low"), F.count("*").alias("lines"))
    at_place = materialise(at_place)
    by_variant = at_place.groupBy("variant").agg(F.min(F.when(F.col("place") < 0, F.col("low"))).alias("whole"), F.min(F.when(F.col("place") >= 0, F.col("low"))).alias("less"), F.sum("lines").alias("all")).where("all > 1")
    same = at_place.where("place >= 0 AND lines > 1").select("variant", "place", F.col("low").alias("partner"))
    rows = variants.join(by_variant, "variant")
    pairs = rows.where("place >= 0 AND whole < line_id").select("line_id", F.col("whole").alias("partner"))
    pairs = pairs.union(rows.where("place < 0 AND less < line_id").select("line_id", F.col("less").alias("partner")))
    pairs = pairs.union(variants.where("place >= 0").join(same, ["variant", "place"]).where("partner < line_id").select("line_id", "partner")).distinct()

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = zip(*([[w for w in split_words(line) if w] for line in batch.column(c).to_pylist()] for c in ("line", "other")))
        ok = [max(len(a), len(b)) >= least and within_one_edit(a, b) for a, b in both]
        return pa.RecordBatch.from_arrays([batch.column("line_id").filter(pa.array(ok, pa.bool_()))], ["line_id"])

    texts_of = near.select("line_id", "line")
    both = pairs.join(texts_of, "line_id").join(texts_of.select(F.col("line_id").alias("partner"), F.col("line").alias("other")), "partner")
    edited = map_arrow(both.select("line_id", "line", "other"), verify, "line_id long").distinct()
    late = hits.join(edited, "line_id", "left_semi").select("doc_id", "text_id", "line_no", F.lit(True).alias("late"))
    firsts = places.select(*key, "doc_id", "text_id", "line_no").join(late, ["doc_id", "text_id", "line_no"], "left")
    first = F.struct("doc_id", "text_id", "line_no")
    gone = signed.select(*key, first.alias("place")).join(firsts.select(*key, first.alias("first"), "late"), key).where("late OR place <> first")
    return gone.select("place.*")


def dedup_lines(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` with duplicate lines cut out of ``text``, and ``n_lines, n_removed`` added.

    Lines end at ``\\n``; words are ``[^\\x20\\x09-\\x0D]+``, and each code point of a script without blanks (UNSPACED)
    is a word; lines are compared by their words. A line is dropped if an earlier one has the same words, or is within
    one word edit, which may be at most a share of 1 - ``similarity`` of the longer of the two: at 0.8 that one has
    five words or more, at 0 any two lines within one edit meet, whatever their length, and at 1 equal lines alone. Lines without words stay.
    Null texts stay null with no lines; rows with a null ``doc_id`` stay as they are. Rows that repeat a document's id
    and text are at the same place, so neither is a copy of the other; of rows that share an id but not the text, which place of a line is its first is open. An empty table gives no rows; very long texts
    are taken line by line. All other columns pass through, also those named like the working columns here; columns
    named ``n_lines`` or ``n_removed`` are replaced.
    """
    with temporary(docs.sparkSession):
        gone = materialise(line_verdicts(docs, similarity).distinct())
    cut = gone.groupBy(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text_id")).agg(F.collect_list("line_no").alias("_gone"))
    work = docs.select(F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text_id"), "text")
    work = work.join(cut, ["_id", "_text_id"], "left").select("_row", "text", "_gone")

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, removed = batch.column("text").to_pylist(), np.zeros(batch.num_rows, np.int64)
        total = [0 if t is None else t.count("\n") + 1 for t in texts]
        for i, gone in enumerate(batch.column("_gone")):
            if gone.is_valid and texts[i] is not None:
                drop, split = set(gone.as_py()), texts[i].split("\n")
                texts[i] = "\n".join(line for k, line in enumerate(split) if k not in drop)
                removed[i] = len(drop)
        return pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed)], ["_row", "text", "n_lines", "n_removed"])

    row = work.schema["_row"].dataType.simpleString()
    done = map_arrow(work, apply, f"_row {row}, text string, n_lines long, n_removed long")
    rest = [(i, c) for i, c in enumerate(docs.columns) if c not in ("n_lines", "n_removed")]
    return done.select(*[F.col("text") if c == "text" else F.col(f"_row.c{i}").alias(c) for i, c in rest], "n_lines", "n_removed")


def keep_first_lines(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` without duplicate lines; documents of which nothing but white space is left by that go.

    Columns, null texts, null ids, repeated rows and empty tables are as with ``dedup_lines``; here a caller's
    ``n_lines`` and ``n_removed`` stay too.
    """
    others = F.struct(F.lit(0).alias("c"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")])
    done = dedup_lines(docs.select("doc_id", "text", others.alias("_others")), similarity)
    done = done.where((F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return done.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_others.c{i}").alias(c) for i, c in enumerate(docs.columns)])
