"""Language identification by a mixture: which languages a text is made of, and in which proportions.

1. Learning: letters are lower-cased and cut into words; the trigrams of each word with its borders are counted by
   language, in a hash table of fixed size, so that what reaches the driver and every task is bounded whatever the
   corpus holds.
2. A word's likelihood under a language is the product of its trigrams' shares there.
3. Expectation-maximisation: words are drawn from an unknown mixture of languages; expected words by language under
   the proportions so far become the next proportions.
4. Languages are taken in order of their proportions in the mixture of all, as long as the penalised likelihood (a
   penalty of half the logarithm of the words for every further language) rises. The largest proportion names the text.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mossveil.llm.common import map_arrow, quoted, slices

#: Places of the hash table, and its cells (places times languages) at most; beyond 64 languages places are halved.
PLACES, CELLS, LEAST_PLACES = 1 << 18, 1 << 24, 1 << 12
#: Added to each count, rounds of expectation-maximisation at most, and the change of a proportion that ends them.
SMOOTHING, ROUNDS, CHANGE = 0.25, 60, 1e-4
UNKNOWN = "und"


class Letters:
    """What each code point is read as: its lower case if it is a letter, itself if a mark within a word, else 0."""

    def __init__(self) -> None:
        self.read = np.full(0x110000, -1, np.int32)

    def of(self, codes: np.ndarray) -> np.ndarray:
        out = self.read[codes]
        if (out < 0).any():
            for c in np.unique(codes[out < 0]).tolist():
                kind, low = unicodedata.category(chr(c))[0], chr(c).lower()
                self.read[c] = ord(low) if kind == "L" and len(low) == 1 else c if kind in "LM" else 0
            out = self.read[codes]
        return out


LETTERS = Letters()


def words_of(texts: pa.Array, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the trigrams of all words, the first trigram of each word, and words before each text (one more).

    A word's trigrams include its borders: one of n letters has n of them. Words begin with a letter; marks belong to
    the word that they follow.
    """
    given = [t or "" for t in texts.to_pylist()]
    codes = np.frombuffer(("\0".join(given) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in given])
    read = np.concatenate([[0], LETTERS.of(codes)]).astype(np.int64)
    inside = read != 0
    first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    middle = np.flatnonzero(inside)
    with np.errstate(over="ignore"):
        key = (read[middle - 1].astype(np.uint64) * np.uint64(0x110000) + read[middle].astype(np.uint64)) * np.uint64(0x110000) + read[middle + 1].astype(np.uint64)
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    grams = (key >> np.uint64(64 - int(math.log2(places)))).astype(np.int64)
    starts = np.searchsorted(middle, first)
    return grams, starts, np.concatenate([[0], np.searchsorted(first, ends, "right")])


class Model:
    """Languages, and the logarithm of every trigram's share in each of them (places by languages, single precision)."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smoothed = counts.astype(np.float64) + SMOOTHING
        self.logs = np.log(smoothed / smoothed.sum(0)).astype(np.float32) if languages else np.empty((len(counts), 0), np.float32)


def learn(docs: DataFrame, lang: str = "lang") -> Model:
    """A model of the rows of ``docs`` (``text`` and ``lang``), which take part if neither is null.

    All rows count, repeated ones each time, and all languages that any row has, whatever its text. The driver gets
    one row for each language and place with a count: at most CELLS. Languages beyond CELLS / LEAST_PLACES (4,096)
    raise a ``ValueError``. No rows give a model without languages.
    """
    given = docs.select("text", F.col(lang).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    most = CELLS // LEAST_PLACES
    languages = sorted(r.lang for r in given.select("lang").distinct().limit(most + 1).collect())
    if len(languages) > most:
        raise ValueError(f"more than {most} languages")
    places = PLACES
    while places * len(languages) > CELLS:
        places //= 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), places), np.int64)
        for batch in batches:
            for part in slices(batch, 2 << 20):
                grams, starts, before = words_of(part.column("text"), places)
                of_text = np.append(starts, len(grams))[before]
                names = pc.index_in(part.column("lang"), pa.array(languages, pa.string())).to_numpy()
                for name in np.unique(names).tolist():
                    mine = np.flatnonzero(names == name)
                    total[name] += np.bincount(np.concatenate([grams[of_text[i] : of_text[i + 1]] for i in mine]), minlength=places)
        name, place = np.nonzero(total)
        for low in range(0, len(name), 50_000):
            part = slice(low, low + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(name[part], pa.int32()), pa.array(place[part], pa.int32()), pa.array(total[name[part], place[part]])], ["name", "place", "n"])

    counts = np.zeros((places, len(languages)), np.int64)
    if languages:
        found = given.mapInArrow(count, "name int, place int, n long").groupBy("name", "place").agg(F.sum("n").alias("n")).toArrow()
        counts[found.column("place").to_numpy(), found.column("name").to_numpy()] = found.column("n").to_numpy()
    return Model(languages, counts)


def proportions(chances: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation, and the logarithm of the likelihood; ``chances`` is words by languages."""
    k = chances.shape[1]
    now = np.full(k, 1 / k) if start is None else start / start.sum()
    for _ in range(ROUNDS if k > 1 else 0):
        total = chances @ now
        after = now * ((1 / total) @ chances) / len(chances)
        done = np.abs(after - now).max() < CHANGE
        now = after
        if done:
            break
    return now, float(np.log(chances @ now).sum())


def mixture(logs: np.ndarray) -> list[tuple[int, float]]:
    """Chosen languages and their proportions, largest first, from the logarithms of the words' likelihoods."""
    single, most = logs.sum(0), logs.max(1)
    best = int(single.argmax())
    penalty = 0.5 * math.log(len(logs))
    # No mixture is likelier than each word's own best language: if that is not worth the penalty, one is enough.
    if logs.shape[1] == 1 or most.sum() - single[best] <= penalty:
        return [(best, 1.0)]
    chances = np.exp(logs - most[:, None])  # a word's best language has 1, so no total is 0
    whole, _ = proportions(chances)
    order = np.argsort(-whole, kind="stable")
    chosen, value = [(best, 1.0)], float(single[best] - most.sum())
    for k in range(2, len(order) + 1):
        few = order[:k]
        with np.errstate(divide="ignore"):
            now, likelihood = proportions(np.maximum(chances[:, few], 1e-300), np.maximum(whole[few], 1e-6))
        if likelihood - (k - 1) * penalty <= value:
            break
        value = likelihood - (k - 1) * penalty
        chosen = sorted(zip(few.tolist(), now.tolist()), key=lambda x: (-x[1], x[0]))
    return chosen


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``languages`` added (columns of these names are replaced).

    ``lang_pred`` is the language of the largest proportion (of equal ones, the first in the model's order), ``score``
    that proportion, ``languages`` all chosen ones with theirs. A text that is null or has no letter, and every text
    under a model without languages, is ``und`` with a score of 0 and no languages. Only ``text`` is looked at, from
    its first word to its last; its words have to fit a task. Repeated rows get equal answers, an empty table no rows.
    """
    names, held = model.languages, docs.sparkSession.sparkContext.broadcast(model.logs)
    added = ("lang_pred", "score", "languages")

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        logs = held.value
        grams, starts, before = words_of(batch.column("text"), len(logs))
        found: list[list[tuple[int, float]]] = [[] for _ in range(batch.num_rows)]
        if len(starts) and names:
            # By texts, so that the table of words and languages stays small.
            ends = np.append(starts, len(grams))
            for i in range(batch.num_rows):
                a, b = before[i], before[i + 1]
                if b > a:
                    found[i] = mixture(np.add.reduceat(logs[grams[ends[a] : ends[b]]].astype(np.float64), starts[a:b] - starts[a]))
        pred = [names[f[0][0]] if f else UNKNOWN for f in found]
        score = [min(max(f[0][1], 0.0), 1.0) if f else 0.0 for f in found]
        parts = [[{"lang": names[k], "proportion": p} for k, p in f] for f in found]
        kind = pa.list_(pa.struct([("lang", pa.string()), ("proportion", pa.float64())]))
        return pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("text"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(parts, kind)], ["_row", "text", *added])

    rest = [c for c in docs.columns if c not in added]
    others = [F.lit(0).alias("_0"), *[quoted(c).alias(f"_{i + 1}") for i, c in enumerate(rest)]]
    work = docs.select(F.struct(*others).alias("_row"), F.col("text"))
    done = map_arrow(work, predict, f"_row {work.schema['_row'].dataType.simpleString()}, text string, lang_pred string, score double, languages array<struct<lang:string,proportion:double>>", 2 << 20)
    return done.select(*[F.col("text") if c == "text" else F.col(f"_row._{i + 1}").alias(c) for i, c in enumerate(rest)], *added)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2. A null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
