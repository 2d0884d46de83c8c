"""BPE encoding and decoding.

Encoding keeps the symbols of a word in a doubly linked list and the possible merges in a priority queue of
(rank, position); an entry whose two symbols have changed meanwhile is stale and skipped. So a word of n symbols
takes O(n log n), however long. Decoding looks every id up in the vocabulary and concatenates the strings.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mossveil.llm.common import lists, map_arrow, rows_of

#: Unicode white space as the tokenizer's pattern engine has it (Python adds U+001C to U+001F).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the split that a byte-level pre-tokenizer uses when its file names none.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered in one worker; beyond, the memory starts anew.
REMEMBERED = 400_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


class Bpe:
    """Encoder and decoder for one vocabulary file (JSON of the tokenizers library: BPE over bytes)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model = config["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.specials = {t["content"]: t["id"] for t in config.get("added_tokens", [])}
        top = max([*self.ids.values(), *self.specials.values()]) + 1
        self.strings = [""] * top
        for s, i in (self.ids | self.specials).items():
            self.strings[i] = s
        #: Left and right id in one integer, to rank (from 1) and resulting id in one.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[left] << 20 | self.ids[right]] = rank + 1 << 20 | self.ids[left + right]
        self.alphabet = byte_alphabet()
        self.starts = [self.ids.get(c, -1) for c in self.alphabet]
        self.ends = [self.ids.get(c + self.suffix, -1) for c in self.alphabet]
        steps = [config["normalizer"]] if config.get("normalizer") else []
        steps = [s for x in steps for s in x.get("normalizers", [x])]
        self.nfc = any(s["type"] == "NFC" for s in steps)
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        pre = config["pre_tokenizer"]
        split = next((p for p in pre.get("pretokenizers", []) if p["type"] == "Split"), None)
        pattern = split["pattern"]["Regex"] if split else BYTE_LEVEL
        pattern = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.pattern = regex.compile(pattern)
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        #: With a byte-level decoder strings are bytes to be joined; without one they are joined by spaces.
        self.byte_decoder = (config.get("decoder") or {}).get("type") == "ByteLevel"
        self.vocabulary = pa.array(self.strings, pa.string())
        self.words: dict[str, bytes] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge in order of rank, then place. A queue entry is rank, result and place in one integer."""
        n, merges, pop, push = len(symbols), self.merges, heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [found << 32 | i for i, pair in enumerate(zip(symbols, symbols[1:])) if (found := merges.get(pair[0] << 20 | pair[1]))]
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            left, j = symbols[i], after[i]
            if left < 0 or j >= n or merges.get(left << 20 | symbols[j]) != entry >> 32:
                continue  # stale: one of the two was merged meanwhile
            symbols[i] = merged = entry >> 32 & 0xFFFFF
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merges.get(merged << 20 | symbols[k]):
                    push(queue, found << 32 | i)
            if (h := before[i]) >= 0 and (found := merges.get(symbols[h] << 20 | merged)):
                push(queue, found << 32 | h)
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        symbols = [*map(self.starts.__getitem__, raw[:-1]), self.ends[raw[-1]]]
        found = array("i", self.merge([s for s in symbols if s >= 0] if min(symbols) < 0 else symbols)).tobytes()
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = found
        return found

    def plain(self, text: str) -> list[bytes]:
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # each character by itself: no final-sigma rule
        known = self.words
        return [known.get(w) or self.word(w) for w in self.pattern.findall(text)]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the whole text; null and empty texts have none. Special strings are single ids, as in the library."""
        text = text or ""
        if not self.special_pattern or not self.special_pattern.search(text):
            return np.frombuffer(b"".join(self.plain(text)), np.int32)
        parts, at = [], 0
        for m in self.special_pattern.finditer(text):
            parts += [*self.plain(text[at : m.start()]), np.int32(self.specials[m[0]]).tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*parts, *self.plain(text[at:])]), np.int32)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each row of ids."""
        strings = pa.ListArray.from_arrays(ids.offsets, self.vocabulary.take(ids.values))
        joined = pc.binary_join(strings, "" if self.byte_decoder else " ")
        if not self.byte_decoder:
            return joined
        back = {c: b for b, c in enumerate(self.alphabet)}
        return pa.array([bytes(back[c] for c in s).decode("utf-8", "replace") for s in joined.to_pylist()], pa.string())


@functools.lru_cache(maxsize=4)
def bpe(path: str) -> Bpe:
    """One per worker process and file."""
    return Bpe(path)


def with_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), column], [*keep, name])


def bpe_encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", digest: str | None = None) -> DataFrame:
    """Add ``ids`` (array of int), replacing a column of that name; all other columns pass through. Row-local.

    Null and empty texts have no ids. ``digest`` names a further column for the lowercase hex SHA-256 of the ids as
    little-endian unsigned 32-bit integers. A text of any length is encoded whole, word by word, in one task; repeated
    rows are encoded each for itself, with equal ids; an empty table gives no rows, with the columns added.
    """
    schema = T.StructType([f for f in df.schema if f.name not in (ids, digest)]).add(ids, T.ArrayType(T.IntegerType()))
    schema = schema.add(digest, T.StringType()) if digest else schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = bpe(path)
        encoded = [codec.encode(t) for t in batch.column(text).to_pylist()]
        batch = with_column(batch, ids, lists(encoded, pa.int32()))
        return with_column(batch, digest, pa.array([hashlib.sha256(e.astype("<u4").tobytes()).hexdigest() for e in encoded], pa.string())) if digest else batch

    return map_arrow(df, run, schema)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the text of ``ids`` (null and empty lists: empty), special tokens kept; a column of that name is
    replaced, all others pass through. Row-local.

    Ids that are not in the vocabulary fail the job. Long lists are decoded whole in one task; repeated rows give
    equal texts; an empty table gives no rows, with the column added.
    """
    schema = T.StructType([f for f in df.schema if f.name != out]).add(out, T.StringType())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return with_column(batch, out, bpe(path).decode(lists(rows_of(batch.column(ids)), pa.int32())))

    return map_arrow(df, run, schema)
