"""Substring dedup by collinear chaining: passages that an earlier document holds too, also with small changes.

1. Seeds: all word k-mers of a text (``fraction`` below 1: those whose hash is in the lowest part of all hashes; the choice hangs on
   the k-mer alone, so one that two documents share is a seed in both, whatever stands around it). They are joined range by
   range of their hashes, so that only some lie on disk at a time. Every seed is
   matched with its earliest document alone, so a passage in any number of documents gives as many matches as it has
   occurrences, never their square. Matches that follow each other word by word in both documents are one run. As the parts of a passage may each stand alone in other, earlier documents, pairs
   of shared seeds at least so many words apart (``spans``) whose seeds have different earliest documents are matched
   too, each with the earliest document that holds the pair.
2. Chains: the matches of a document and an earlier one are chained in order of both (one alone is a chain too); the best chain before a match
   comes from a Fenwick tree of prefix maxima over places in the earlier document, less a cost for the gap. Where
   whole runs follow each other in both documents, that is the run before.
3. Alignment: the words around each chain (of a short run alone only if enough bytes of their hashes are equal) are aligned, and stretches of ``min_words`` in which at least
   ``similarity`` of the words are matched become passages; a sparse stretch is split at its widest gap.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mossveil.llm.blocks import by_group, by_groups
from mossveil.llm.common import discard, map_arrow, materialise, numbered, quoted, rows_of, saved, temporary
from mossveil.llm.shingles import BASE, U64, mix, ngram_hashes, repeated, word_hashes, word_spans

#: What follows are the defaults of parameters. Words of a k-mer, and the share of k-mers that are seeds.
K, FRACTION = 5, 1
#: Ranges of hashes whose seeds are joined one after the other: what is on disk for it is that part of all seeds.
PARTS = 4
#: Least distances in words of the pairs of seeds: a seed is paired with the next shared one from there on.
SPANS = (12, 30)
#: Cost of a word skipped in a gap (a seed is worth K), the widest gap of a chain, and words looked at around it.
GAP_COST, MAX_GAP, MARGIN = 0.05, 60, 40
#: By how much mismatches (2 each) may outweigh matches beyond the ends of a chain: ten changed words in a row.
FALL = 20
#: Words travel to the chains that need them in pieces of so many.
PIECE = 128
#: A byte of each word goes first, in pieces that begin so many words apart.
LOOK = 1024


def short_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32 bits of the hash of each word, and the number of words before each text (one more than texts)."""
    words, before = word_hashes(texts)
    return (words >> U64(32)).astype(np.uint32).view(np.int32), before


def seeds(texts: pa.Array, fraction: float = FRACTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, word place and hash of each seed in order; texts of fewer than K words have none."""
    return seeds_of(*short_words(texts), fraction)


def seeds_of(words: np.ndarray, before: np.ndarray, fraction: float = FRACTION, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``seeds`` of texts given by their words; of ``parts`` ranges of hashes only those of one."""
    grams, ends = ngram_hashes(mix(words.view(np.uint32).astype(U64)), before, K)
    least, most = (min(int(fraction * 2**64) * k // parts, 2**64) for k in (part, part + 1))
    chosen = np.flatnonzero((grams >= U64(least)) & (grams <= U64(most - 1)) if most > least else np.zeros(len(grams), bool))
    owner = np.searchsorted(ends, chosen, "right") - 1
    long = np.diff(before)[owner] >= K
    chosen, owner = chosen[long], owner[long]
    return owner, chosen - ends[owner], grams[chosen].view(np.int64)


def pairs_of(place: np.ndarray, seed: np.ndarray, spans: tuple[int, ...] = SPANS, max_gap: int = MAX_GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second number and hash of the pairs of one document's shared seeds, which are in order of place."""
    i, j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for span in spans:
        second = np.searchsorted(place, place + span)
        first = np.flatnonzero(second < len(place))
        second = second[first]
        near = place[second] - place[first] <= span + max_gap
        i, j = [*i, first[near]], [*j, second[near]]
    i, j = np.concatenate(i), np.concatenate(j)
    with np.errstate(over="ignore"):
        keys = mix(seed[i].view(U64) * BASE + seed[j].view(U64)).view(np.int64)
    return i, j, keys


def chains(p: np.ndarray, q: np.ndarray, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[np.ndarray]:
    """Chains (indices in order) of matches at p and q, strictly rising in both.

    The score of a match is K and the best of: nothing, or the score of an earlier match less ``gap_cost`` for every
    word between them on either side. As that cost is a difference of p + q, the best predecessor is a prefix
    maximum of score + cost over smaller q, which the Fenwick tree holds for all smaller p.
    """
    order = np.lexsort((-q, p))  # of matches at one p, greater q first: they never follow each other
    ranks = (np.unique(q, return_inverse=True)[1] + 1).tolist()
    n, p, q = max(ranks) + 1, p.tolist(), q.tolist()
    tree, holder = [-1e18] * n, [-1] * n
    score, before = [0.0] * len(p), [-1] * len(p)
    for i in order.tolist():
        cost = gap_cost * (p[i] + q[i])
        r, best, at = ranks[i] - 1, -1e18, -1
        while r > 0:
            if tree[r] > best:
                best, at = tree[r], holder[r]
            r -= r & -r
        gain = best - cost
        score[i] = K + max(gain, 0.0)
        if gain > 0:
            before[i] = at
        r, value = ranks[i], score[i] + cost
        while r < n:
            if tree[r] < value:
                tree[r], holder[r] = value, i
            r += r & -r
    used, out = [False] * len(p), []
    for i in np.argsort(-np.array(score), kind="stable").tolist():
        path = []
        while i >= 0 and not used[i]:
            if path and (p[path[-1]] - p[i] > max_gap or q[path[-1]] - q[i] > max_gap):
                out.append(np.array(path[::-1]))
                path = []
            used[i] = True
            path.append(i)
            i = before[i]
        if path:
            out.append(np.array(path[::-1]))
    return out


def runs(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches at p and q, in order, as runs: the places of their first matches and how many follow word by word."""
    heads = np.flatnonzero(np.append(True, (np.diff(p) != 1) | (np.diff(q) != 1)))
    return p[heads], q[heads], np.diff(np.append(heads, len(p)))


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of all matches of runs."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def chains_of_runs(p: np.ndarray, q: np.ndarray, n: np.ndarray, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``chains`` of the matches of runs in order of p, as runs.

    Where every run begins beyond the end of the one before in both documents, the best predecessor of a match is the
    one before it (any other path would gain by it), so scores go from run to run, and a chain is a stretch of them.
    """
    if len(p) == 1:
        return [(p, q, n)]
    across, along = p[1:] - p[:-1] - n[:-1] + 1, q[1:] - q[:-1] - n[:-1] + 1
    if max_gap < 1 or 2 * gap_cost >= K or (across < 1).any() or (along < 1).any():
        x, y = spread(p, n), spread(q, n)
        found = chains(x, y, gap_cost, max_gap)
        ends, order = np.cumsum([0, *map(len, found)]), np.concatenate(found)
        x, y = x[order], y[order]
        heads = np.append(True, (np.diff(x) != 1) | (np.diff(y) != 1))
        heads[ends[:-1]] = True
        heads = np.flatnonzero(heads)
        p, q, n, edges = x[heads], y[heads], np.diff(np.append(heads, len(x))), np.searchsorted(heads, ends).tolist()
        return [(p[a:b], q[a:b], n[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    rise = ((n - 1) * (K - 2 * gap_cost)).tolist()
    scores, linked = [K + rise[0]], [False]
    for cost, more in zip((gap_cost * (across + along)).tolist(), rise[1:]):
        gain = scores[-1] - cost
        linked.append(gain > 0)
        scores.append(K + max(gain, 0.0) + more)
    used, out, wide = [False] * len(p), [], np.maximum(across, along) > max_gap
    for i in np.argsort(-np.array(scores), kind="stable").tolist():
        if used[i]:
            continue
        k, used[i] = i, True
        while linked[k] and not used[k - 1]:
            k -= 1
            used[k] = True
        edges = [k, *(k + 1 + np.flatnonzero(wide[k:i])).tolist(), i + 1]
        out += [(p[a:b], q[a:b], n[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    return out


def align(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, n: np.ndarray, fall: int = FALL) -> tuple[np.ndarray, np.ndarray]:
    """Matched word places of a and b along a chain of runs of n seeds at p and q, and beyond its ends."""
    pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def straight(i: int, j: int, n: int) -> None:
        hit = np.flatnonzero(a[i : i + n] == b[j : j + n])
        pairs.append((i + hit, j + hit))

    def reach(i: int, j: int, step: int) -> None:
        """Extend on the diagonal until mismatches outweigh matches by ``fall``; what is too sparse is cut off later."""
        n = min(i, j) if step < 0 else min(len(a) - i, len(b) - j)
        same = a[i - n : i][::-1] == b[j - n : j][::-1] if step < 0 else a[i : i + n] == b[j : j + n]
        if n:
            total = np.cumsum(np.where(same, 1, -2))
            fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(total, 0)) - total > fall)
            hit = np.flatnonzero(same[: fallen[0]] if len(fallen) else same)
            if len(hit):
                pairs.append((i - 1 - hit[::-1], j - 1 - hit[::-1]) if step < 0 else (i + hit, j + hit))

    reach(int(p[0]), int(q[0]), -1)
    i, j = int(p[0]), int(q[0])
    for x, y, m in zip(p.tolist(), q.tolist(), (n - 1 + K).tolist()):
        if x < i or y < j:  # overlaps what is aligned already
            if x - i == y - j:
                if x + m > i:
                    straight(i, j, x + m - i)
                    i, j = x + m, y + m
                continue
            skip = max(i - x, j - y)
            if skip > m - K:
                continue
            x, y, m = x + skip, y + skip, m - skip
        if x - i == y - j:
            straight(i, j, x - i)
        elif x > i and y > j:
            pairs.append(common_words(a[i:x], b[j:y], i, j))
        straight(x, y, m)
        i, j = x + m, y + m
    reach(i, j, 1)
    return np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])


def common_words(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """A longest common subsequence of two gaps, of which a chain has none wider than its ``max_gap`` words."""
    same = a[:, None] == b[None, :]
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for x in range(len(a) - 1, -1, -1):
        row = np.maximum(best[x + 1, :-1], best[x + 1, 1:] + same[x])
        best[x, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    x = y = 0
    out = []
    while x < len(a) and y < len(b):
        if same[x, y] and best[x, y] == best[x + 1, y + 1] + 1:
            out.append((i + x, j + y))
            x, y = x + 1, y + 1
        elif best[x + 1, y] >= best[x, y + 1]:
            x += 1
        else:
            y += 1
    found = np.array(out, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def on_diagonal(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    """Where words at places that differ by ``shift`` are equal; a chain on one diagonal aligns no others."""
    a, b = a[max(shift, 0) :], b[max(-shift, 0) :]
    n = min(len(a), len(b))
    return a[:n] == b[:n]


def equal_bytes(a: pa.Array, b: pa.Array) -> np.ndarray:
    """For each row of two binary columns, where both have the same byte; rows are as wide as the longest."""
    (flat_a, edge_a), (flat_b, edge_b) = ((np.frombuffer(c.buffers()[2] or b"", np.uint8), np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]) for c in (a, b))
    n = np.minimum(np.diff(edge_a), np.diff(edge_b))
    ends = np.concatenate([[0], np.cumsum(n)])
    at = lambda edge: np.repeat(edge[:-1] - ends[:-1], n) + np.arange(ends[-1])
    out = np.zeros((len(n), int(n.max(initial=0))), bool)
    out[np.repeat(np.arange(len(n)), n), at(np.zeros(len(n) + 1, np.int64))] = flat_a[at(edge_a)] == flat_b[at(edge_b)]
    return out


def holds_dense(equal: np.ndarray, min_words: int, similarity: float) -> np.ndarray:
    """Whether some stretch of ``min_words`` or more of a row is equal for the share of ``similarity``.

    Less that share for every word, the sum of equal words is then no lower at the end of the stretch than before it.
    """
    if equal.shape[1] < min_words:
        return np.zeros(len(equal), bool)
    total = np.zeros((len(equal), equal.shape[1] + 1))
    np.cumsum(equal - similarity, axis=1, out=total[:, 1:])
    return (total[:, min_words:] >= np.minimum.accumulate(total[:, : total.shape[1] - min_words], axis=1) - 1e-6).any(1)


def along_diagonals(words: np.ndarray, a: np.ndarray, b: np.ndarray, width: np.ndarray, first: np.ndarray, last: np.ndarray, min_words: int, similarity: float, fall: int) -> tuple[np.ndarray, np.ndarray]:
    """``align`` for chains on one diagonal each: which rows can hold a passage, and the places matched in those.

    The words of both sides begin at a and b; the chain goes from ``first`` to ``last``.
    """
    at = np.arange(int(width.max()))
    inside = at < width[:, None]
    equal = words[np.minimum(a[:, None] + at, len(words) - 1)] == words[np.minimum(b[:, None] + at, len(words) - 1)]
    equal &= inside
    rows = np.flatnonzero(holds_dense(equal, min_words, similarity))
    equal, inside, first, last = equal[rows], inside[rows], first[rows, None], last[rows, None]

    def reached(equal: np.ndarray, beyond: np.ndarray) -> np.ndarray:
        total = np.cumsum(np.where(beyond, np.where(equal, 1, -2), 0), axis=1)
        return ~np.logical_or.accumulate((np.maximum.accumulate(np.maximum(total, 0), axis=1) - total > fall) & beyond, axis=1)

    equal &= reached(equal, inside & (at >= last))
    return rows, equal & reached(equal[:, ::-1], (at < first)[:, ::-1])[:, ::-1]


def dense_stretches(p: np.ndarray, q: np.ndarray, min_words: int, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """Start and end in either text and matched words of the stretches that are long and similar enough."""
    out, todo = [], [(0, len(p))]
    while todo:
        lo, hi = todo.pop()
        if hi <= lo:
            continue
        here, there = p[hi - 1] - p[lo] + 1, q[hi - 1] - q[lo] + 1
        if here < min_words or hi - lo < similarity * min_words:
            continue
        if hi - lo >= similarity * max(here, there):
            out.append((int(p[lo]), int(p[hi - 1]) + 1, int(q[lo]), int(q[hi - 1]) + 1, hi - lo))
            continue
        cut = lo + 1 + int(np.maximum(np.diff(p[lo:hi]), np.diff(q[lo:hi])).argmax())
        todo += [(lo, cut), (cut, hi)]
    return out


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``doc, text`` of the rows that can have passages, and, where an id has several texts, what ``doc`` stands for.

    A document is an id and a text. Where every id has one text, the id is the key and the second is None; else all
    documents are numbered by id and the hash of their text, and the second has ``doc, doc_id, text_id``.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    hashed = texts.select("doc_id", F.xxhash64("text").alias("text_id"))
    if hashed.groupBy("doc_id").agg((F.min("text_id") != F.max("text_id")).alias("several")).where("several").isEmpty():
        return texts.withColumnRenamed("doc_id", "doc"), None
    names = materialise(numbered(materialise(hashed.distinct()), ["doc_id", "text_id"], "doc"))
    return texts.withColumn("text_id", F.xxhash64("text")).join(names, ["doc_id", "text_id"]).select("doc", "text"), names


def repeated_passages(docs: DataFrame, min_words: int = 50, similarity: float = 0.8, **options) -> DataFrame:
    """``doc_id, start, end, src_doc_id, src_start, src_end, matched``: passages of ``docs`` in an earlier document.

    Places are words (``[^\\x20\\x09-\\x0D]+``) from 0, ends exclusive; ``matched`` words are aligned. Passages of
    one document may overlap if their parts come from different sources; one within another is left out (of equal
    ones, that of the smallest source stays). Repeats within one document do not count. Rows that share a ``doc_id``
    but not their text are documents of their own, in order of a hash of their texts; rows that share both are one.
    Null, empty and short texts and rows with a null ``doc_id`` have none, nor has an empty table; a text may be of any
    length that fits a row, and its seeds are one task's group. Other columns play no part.

    ``options`` are those of ``find_passages``. Every k-mer is a seed (``fraction=1``), and a passage is missed only
    if its document and every earlier one that holds it share no k-mer of it, nor pair of them, whose earliest document holds enough.
    """
    texts, names = keyed(docs)
    return named(find_passages(texts, min_words, similarity, **options), names).drop("text_id")


def named(passages: DataFrame, names: DataFrame | None) -> DataFrame:
    """Passages with ids, and the hash of the text (null where the id says all), in place of keys."""
    if names is None:
        return passages.withColumnsRenamed({"doc": "doc_id", "src": "src_doc_id"}).withColumn("text_id", F.lit(None).cast("long"))
    rest = ("start", "end", "src_doc_id", "src_start", "src_end", "matched", "text_id")
    return passages.join(names, "doc").join(names.select(F.col("doc").alias("src"), F.col("doc_id").alias("src_doc_id")), "src").select("doc_id", *rest)


def find_passages(texts: DataFrame, min_words: int, similarity: float, fraction: float = FRACTION, spans: tuple[int, ...] = SPANS, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP, margin: int = MARGIN, fall: int = FALL, parts: int = PARTS) -> DataFrame:
    """``doc, start, end, src, src_start, src_end, matched`` of the documents ``doc, text``, none of them null."""

    def to_words(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, before = short_words(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc"), pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(words))], ["doc", "words"])

    def sow(part: int) -> DataFrame:
        def seeds_in(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column("words")
            edges = column.offsets.to_numpy().astype(np.int64)
            words = column.values.to_numpy()[edges[0] : edges[-1]]
            owner, place, gram = seeds_of(words, edges - edges[0], fraction, part, parts)
            return pa.RecordBatch.from_arrays([pa.array(batch.column("doc").to_numpy()[owner]), pa.array(place, pa.int32()), pa.array(gram), pa.array(repeated(owner, gram))], ["doc_id", "place", "seed", "again"])

        return map_arrow(worded, seeds_in, "doc_id long, place int, seed long, again boolean", 1 << 19)

    worded = saved(map_arrow(texts, to_words, "doc long, words array<int>", 1 << 19), "words")
    shared = []
    for part in range(parts):
        # Tables of one row a seed are written before they are joined, so that the adaptive join can split a hot seed.
        sown = saved(sow(part), "seeds")
        first = sown.where("NOT again").groupBy("seed").agg(F.min("doc_id").alias("src"), F.min_by("place", "doc_id").alias("src_place"), F.max("doc_id").alias("last"))
        first = saved(first.where("src < last").drop("last"), "sources")
        shared.append(saved(sown.drop("again").join(first, "seed"), "placed"))
        discard(sown, first)

    def couple(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        doc = batch.column("doc_id")[0].as_py()
        place, there, seed, src = (batch.column(c).to_numpy() for c in ("place", "src_place", "seed", "src"))
        _, order = np.unique(place, return_index=True)  # a document that comes as several equal rows has its seeds several times
        place, there, seed, src = place[order], there[order], seed[order], src[order]
        # The matches with one earlier document are one row, a list of runs.
        order = np.flatnonzero(src != doc)
        order = order[np.argsort(src[order], kind="stable")]
        sources, p, q = src[order], place[order], there[order]
        heads = np.flatnonzero(np.append(True, (np.diff(sources) != 0) | (np.diff(p) != 1) | (np.diff(q) != 1))) if len(p) else order
        n = np.diff(np.append(heads, len(p)))
        sources, p, q = sources[heads], p[heads], q[heads]
        firsts = np.flatnonzero(np.append(True, np.diff(sources) != 0)) if len(p) else order
        i, j, keys = pairs_of(place, seed, spans, max_gap)
        # Where the earliest document of both seeds holds them at the same distance, their own matches say as much,
        # and the same goes for every other document that holds them.
        new = (src[i] != src[j]) | (place[j] - place[i] != there[j] - there[i])
        i, j, keys = i[new], j[new], keys[new]
        # A pair is one row of its document, however often it recurs there: a text that repeats itself has few of them.
        order = np.argsort(keys, kind="stable")
        i, j, keys = i[order], j[order], keys[order]
        pairs = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else order
        edges = np.concatenate([firsts, len(p) + pairs, [len(p) + len(keys)]])
        listed = lambda *parts: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(parts), pa.int32()))
        rows = len(firsts) + len(pairs)
        if not rows:
            return None
        of_pair = np.arange(rows) >= len(firsts)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(rows, doc, np.int64)),
            pa.array(np.concatenate([sources[firsts], np.zeros(len(pairs), np.int64)]), mask=of_pair),
            pa.array(np.concatenate([np.zeros(len(firsts), np.int64), keys[pairs]]), mask=~of_pair),
            listed(p, place[i]), listed(q, place[j]), listed(n, np.ones(len(keys), np.int64)),
        ], ["doc_id", "src", "pair", "places", "others", "n"])

    coupled = saved(by_group(reduce(DataFrame.union, shared), ["doc_id"], couple, "doc_id long, src long, pair long, places array<int>, others array<int>, n array<int>"), "pairs")
    discard(*shared)
    matches = coupled.where("pair IS NULL").select("doc_id", "src", F.col("places").alias("p"), F.col("others").alias("q"), "n")
    paired = coupled.where("pair IS NOT NULL").drop("src")
    first = paired.groupBy("pair").agg(F.min("doc_id").alias("src"), F.min_by(F.get("places", F.lit(0)), "doc_id").alias("src_place"), F.min_by(F.get("others", F.lit(0)), "doc_id").alias("src_other"), F.max("doc_id").alias("last"))
    first = saved(first.where("src < last").drop("last"), "pair-sources")
    times = lambda there: F.array_repeat(there, F.size("n"))
    ends = [F.concat("places", "others").alias("p"), F.concat(times("src_place"), times("src_other")).alias("q"), F.concat("n", "n").alias("n")]
    matches = matches.union(paired.join(first, "pair").where("doc_id <> src").select("doc_id", "src", *ends))

    def chain(batch: pa.RecordBatch, bounds: np.ndarray) -> list[pa.RecordBatch]:
        p, q, n = (batch.column(c).values.to_numpy().astype(np.int64) for c in "pqn")
        edges = batch.column("p").offsets.to_numpy()
        p, q, n = (c[edges[0] : edges[-1]] for c in (p, q, n))
        edges = edges[bounds] - edges[0]
        # The runs of all groups are put in order, as one group's may come from several rows, and may overlap.
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(edges))
        x, y, owner = spread(p, n), spread(q, n), np.repeat(owner, n)
        order = np.lexsort((y, x, owner))
        x, y, owner = x[order], y[order], owner[order]
        step = [np.diff(c) for c in (owner, x, y)]
        once = np.append(True, (step[0] != 0) | (step[1] != 0) | (step[2] != 0))
        x, y, owner = x[once], y[once], owner[once]
        heads = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(x) != 1) | (np.diff(y) != 1)))
        p, q, n, owner = x[heads], y[heads], np.diff(np.append(heads, len(x))), owner[heads]
        edges = np.searchsorted(owner, np.arange(len(bounds)))
        one = np.diff(edges) == 1
        at, number = [np.flatnonzero(one)], [np.zeros(one.sum(), np.int64)]
        ps, qs, ns = ([c[edges[:-1][one]]] for c in (p, q, n))
        sizes = [np.ones(one.sum(), np.int64)]
        for g in np.flatnonzero(~one).tolist():
            found = chains_of_runs(*(c[edges[g] : edges[g + 1]] for c in (p, q, n)), gap_cost, max_gap)
            at.append(np.full(len(found), g)), number.append(np.arange(len(found))), sizes.append([len(c[0]) for c in found])
            for to, k in ((ps, 0), (qs, 1), (ns, 2)):
                to += [c[k] for c in found]
        at = pa.array(bounds[np.concatenate(at)], pa.int64())
        ends = pa.array(np.append(0, np.cumsum(np.concatenate(sizes))), pa.int32())
        listed = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c), pa.int32())) for c in (ps, qs, ns)]
        columns = [batch.column("doc_id").take(at), batch.column("src").take(at), pa.array(np.concatenate(number), pa.int32()), *listed]
        return [pa.RecordBatch.from_arrays(columns, ["doc_id", "src", "chain", "p", "q", "n"])]

    chained = saved(by_groups(matches, ["doc_id", "src"], chain, "doc_id long, src long, chain int, p array<int>, q array<int>, n array<int>"), "chains")
    discard(coupled, first)

    # Most chains are one short run that is no part of a passage. A byte of each word around it tells most of them,
    # as a passage along one diagonal has a stretch of equal words; of those that are not told, the words decide.
    least, K_1 = similarity * min_words, K - 1
    widest = int(least) + 1 + 2 * margin
    alone = (F.size("n") == 1) & (F.get("n", F.lit(0)) + K_1 < least)

    def to_bytes(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("words")
        before, flat = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy().astype(np.uint8)
        pieces = -(-np.diff(before) // LOOK)
        owner = np.repeat(np.arange(batch.num_rows), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = before[owner] + number * LOOK
        sizes = np.minimum(start + LOOK + widest, before[owner + 1]) - start
        data = flat[np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        seen = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(edges), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([pa.array(batch.column("doc").to_numpy()[owner]), pa.array(number, pa.int32()), seen], ["id", "piece", "bytes"])

    def seen(rows: DataFrame, ident: str, place: str, out: str) -> DataFrame:
        start = F.col(place) - F.col("back")
        rows = rows.withColumn("id", F.col(ident)).withColumn("piece", F.floor(start / LOOK).cast("int"))
        rows = rows.join(map_arrow(worded, to_bytes, "id long, piece int, bytes binary", 1 << 19), ["id", "piece"])
        return rows.withColumn(out, F.substring("bytes", start - F.col("piece") * LOOK + 1, F.col("back") + F.col("n") + K_1 + margin)).drop("id", "piece", "bytes")

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.select(["doc_id", "src", "chain", "p", "q", "n"]).filter(pa.array(holds_dense(equal_bytes(batch.column("a"), batch.column("b")), min_words, similarity)))

    short = chained.where(alone).select("doc_id", "src", "chain", *[F.get(c, F.lit(0)).alias(c) for c in "pqn"])
    short = short.withColumn("back", F.least("p", "q", F.lit(margin)))
    short = map_arrow(seen(seen(short, "doc_id", "p", "a"), "src", "q", "b"), look, "doc_id long, src long, chain int, p int, q int, n int")
    worth = saved(chained.where(~alone).union(short.select("doc_id", "src", "chain", *[F.array(c).alias(c) for c in "pqn"])), "worth")
    discard(chained)

    def cut_words(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("words")
        before, words = column.offsets.to_numpy(), column.values
        pieces = -(-np.diff(before) // PIECE)
        owner = np.repeat(np.arange(batch.num_rows), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.append(before[owner] + number * PIECE, before[-1])
        return pa.RecordBatch.from_arrays([pa.array(batch.column("doc").to_numpy()[owner]), pa.array(number, pa.int32()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words)], ["id", "piece", "words"])

    def around(side: str, ident: str, places: str) -> DataFrame:
        low, high = F.greatest(F.element_at(places, 1) - margin, F.lit(0)), F.element_at(places, -1) + F.element_at("n", -1) - 1 + K + margin
        wide = worth.select("doc_id", "src", "chain", F.lit(side).alias("side"), F.col(ident).alias("id"), low.alias("low"), high.alias("high"), "p", "q", "n")
        first, last = F.expr(f"low div {PIECE}").cast("int"), F.expr(f"(high - 1) div {PIECE}").cast("int")
        wide = wide.withColumn("piece", F.explode(F.sequence(first, last)))
        here = F.lit(side == "a") & (F.col("piece") == first)  # the chain itself goes once
        return wide.select("doc_id", "src", "chain", "side", "id", "piece", "low", "high", *[F.when(here, F.col(c)).alias(c) for c in "pqn"])

    # Either side's words around its chain are cut out piece by piece where the document is, so only they travel on.
    hashed = map_arrow(worded, cut_words, "id long, piece int, words array<int>", 1 << 19)
    cut = around("a", "doc_id", "p").union(around("b", "src", "q")).join(hashed, ["id", "piece"])
    begin = F.greatest(F.col("low") - F.col("piece") * PIECE, F.lit(0))
    cut = cut.select("doc_id", "src", "chain", "side", "piece", "low", "p", "q", "n", F.slice("words", begin + 1, F.least(F.col("high") - F.col("piece") * PIECE, F.lit(PIECE)) - begin).alias("words"))

    def verify(batch: pa.RecordBatch, bounds: np.ndarray) -> list[pa.RecordBatch]:
        # A chain's rows are in order of side and piece, so that each side's words stand in one stretch of the column.
        column = batch.column("words")
        words, edge = column.values.to_numpy(), column.offsets.to_numpy()
        piece, low = batch.column("piece").to_numpy(), batch.column("low").to_numpy()
        front = np.concatenate([[0], np.cumsum(batch.column("side").to_numpy(zero_copy_only=False) == "a")])
        middles = bounds[:-1] + front[bounds[1:]] - front[bounds[:-1]]
        ps, qs, ns = (rows_of(batch.column(c)) for c in "pqn")
        at, found, straight = [], [], []

        def side(a: int, b: int) -> np.ndarray:
            if piece[b - 1] - piece[a] == b - a - 1:
                return words[edge[a] : edge[b]]
            # A document that comes as several equal rows gives the same pieces several times.
            _, once = np.unique(piece[a:b], return_index=True)
            return np.concatenate([words[edge[k] : edge[k + 1]] for k in a + once])

        edges, pieces, lows = edge.tolist(), piece.tolist(), low.tolist()
        for a, m, b in zip(bounds[:-1].tolist(), middles.tolist(), bounds[1:].tolist()):
            if a == m or m == b:
                continue
            low_a, low_b = lows[a], lows[m]
            p, q, n = ps[a].astype(np.int64) - low_a, qs[a].astype(np.int64) - low_b, ns[a].astype(np.int64)
            shift = int(p[0] - q[0])
            one = len(p) == 1 or not (p - q != shift).any()
            if one and pieces[m - 1] - pieces[a] == m - a - 1 and pieces[b - 1] - pieces[m] == b - m - 1:
                x, y = max(shift, 0), max(-shift, 0)
                width = min(edges[m] - edges[a] - x, edges[b] - edges[m] - y)
                if width <= 4 * PIECE:
                    straight.append((edges[a] + x, edges[m] + y, width, int(p[0]) - x, int(p[-1] + n[-1]) - 1 + K - x, a, low_a + x, low_b + y))
                    continue
            here, there = side(a, m), side(m, b)
            if one and not holds_dense(on_diagonal(here, there, shift)[None], min_words, similarity)[0]:
                continue
            x, y = align(here, there, p, q, n, fall)
            for s in dense_stretches(x + low_a, y + low_b, min_words, similarity):
                at.append(a), found.append(s)
        for k in range(0, len(straight), 1 << 10):
            block = np.array(straight[k : k + (1 << 10)])
            rows, hits = along_diagonals(words, *block[:, :5].T, min_words, similarity, fall)
            if not len(rows):
                continue
            count, start, end = hits.sum(1), hits.argmax(1), hits.shape[1] - hits[:, ::-1].argmax(1)
            whole = (end - start >= min_words) & (count >= similarity * (end - start))
            row, here, there = block[rows, 5:].T
            at += row[whole].tolist()
            found += np.stack([here + start, here + end, there + start, there + end, count], 1)[whole].tolist()
            for r in np.flatnonzero(~whole & (count >= similarity * min_words)).tolist():
                x = np.flatnonzero(hits[r])
                for s in dense_stretches(x + here[r], x + there[r], min_words, similarity):
                    at.append(int(row[r])), found.append(s)
        at = pa.array(at, pa.int64())
        start, end, src_start, src_end, matched = (pa.array(c, pa.int64()) for c in np.array(found, np.int64).reshape(-1, 5).T)
        columns = [batch.column("doc_id").take(at), start, end, batch.column("src").take(at), src_start, src_end, matched]
        return [pa.RecordBatch.from_arrays(columns, ["doc", "start", "end", "src", "src_start", "src_end", "matched"])]

    passages = by_groups(cut, ["doc_id", "src", "chain"], verify, "doc long, start long, end long, src long, src_start long, src_end long, matched long", then=("side", "piece"))
    # Of the passages of a document, one that lies within another says nothing new.
    before = W.partitionBy("doc").orderBy("start", F.desc("end"), "src", "src_start", "src_end", "matched").rowsBetween(W.unboundedPreceding, -1)
    return passages.withColumn("_reached", F.max("end").over(before)).where("_reached IS NULL OR end > _reached").drop("_reached")


def cut_passages(docs: DataFrame, min_words: int = 50, similarity: float = 0.8, **options) -> DataFrame:
    """``docs`` without the passages that an earlier document holds; documents of which no word is left by that go.

    A passage goes with the white space behind it. What is a document and which is earlier is as with
    ``repeated_passages``, so of rows that share an id only those with the same text lose the same words. All columns
    and all other rows stay as they are: null and empty texts, null ids, columns of any name. An empty table gives
    none; a long text is cut as a whole, in one row.
    """
    texts, names = keyed(docs)
    with temporary(docs.sparkSession):
        spans = materialise(named(find_passages(texts, min_words, similarity, **options), names))
    keys = ["_id"] if names is None else ["_id", "_text_id"]
    cut = spans.select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text_id"), "start", "end").groupBy(*keys).agg(F.array_distinct(F.collect_list(F.struct("start", "end"))).alias("_cut"))
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(F.lit(0).alias("c"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(others)])
    work = docs.select(row.alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text_id"), "text")
    work = work.join(cut, keys, "left").select("_row", "text", "_cut")

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, texts = [], batch.column("text").to_pylist()
        for i, spans in enumerate(batch.column("_cut").to_pylist()):
            if spans and texts[i] is not None:
                raw = texts[i].encode()
                _, starts, _, _ = word_spans(pa.array([texts[i]]))
                gone = np.zeros(len(starts) + 1, bool)
                for s in spans:
                    gone[s["start"] : s["end"]] = True
                if gone[: len(starts)].all():
                    continue
                edges = np.append(starts, len(raw))
                head = raw[: edges[0]]
                texts[i] = (head + b"".join([raw[edges[k] : edges[k + 1]] for k in np.flatnonzero(~gone[:-1])])).decode()
            keep.append(i)
        out = batch.take(pa.array(keep, pa.int32()))
        return pa.RecordBatch.from_arrays([out.column("_row"), pa.array([texts[i] for i in keep], pa.string())], ["_row", "text"])

    done = map_arrow(work, apply, f"_row {work.schema['_row'].dataType.simpleString()}, text string")
    return done.select(*[F.col("text") if c == "text" else F.col(f"_row.c{others.index(c)}").alias(c) for c in docs.columns])
