"""Hashes of words and of word n-grams of whole texts, for a batch of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finishing steps of a well-known public 64-bit mixer)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def repeated(*keys: np.ndarray) -> np.ndarray:
    """Whether an earlier row has the same keys."""
    order = np.lexsort(keys[::-1])  # stable: equal rows stay in order
    again = np.zeros(len(order), bool)
    again[order[1:]] = np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in keys])
    return again


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, nulls being empty, and the bytes before each text (one more than texts)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, start and end of each word (``[^\\x20\\x09-\\x0D]+``) in them, and words before each text."""
    data, offsets = text_bytes(texts)
    inside = (data != 32) & ((data < 9) | (data > 13))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    stops = np.append(~inside[1:], True)[: len(data)] & inside
    stops[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array, places: bool = False) -> tuple[np.ndarray, ...]:
    """A 64-bit hash of each word, and the number of words before each text (one more than texts).

    With ``places`` also the byte of all texts at which each word starts.
    """
    data, starts, ends, before = word_spans(texts)
    if not len(starts):
        return (np.empty(0, U64), before, starts)[: 2 + places]
    with np.errstate(over="ignore"):
        powers = np.full(len(data), BASE)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=U64)
        back = np.full(len(data), INVERSE)
        back[0] = 1
        back = np.cumprod(back, dtype=U64)
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * powers, dtype=U64, out=sums[1:])
        return (mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U64)), before, starts)[: 2 + places]


def ngram_hashes(words: np.ndarray, before: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word n-gram, and the number of n-grams before each text.

    A text of fewer than n words, but some, has one n-gram of all its words.
    """
    sizes = np.diff(before)
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(ends[-1], U64)
    with np.errstate(over="ignore"):
        if len(words) >= n:
            grams = np.zeros(len(words) - n + 1, U64)
            for j in range(n):
                grams = grams * BASE + words[j : len(words) - n + 1 + j]
            inside = np.ones(len(grams), bool)
            for k in range(1, n):  # windows that run over the end of a text
                at = before[1:-1] - k
                inside[at[(at >= 0) & (at < len(grams))]] = False
            out[np.repeat(sizes >= n, counts)] = grams[inside]
        for i in np.flatnonzero((sizes > 0) & (sizes < n)):
            h = U64(0)
            for w in words[before[i] : before[i + 1]]:
                h = h * BASE + w
            out[ends[i]] = h * BASE + U64(sizes[i])
    return mix(out), ends
