"""Ids of whole texts by the tokenizers library, each distinct stretch of text encoded once a worker.

A text is cut where the library's own pre-tokenizer always cuts: at single blanks, and between ASCII or Latin-1
letters and other signs. Arrow finds the distinct chunks between blanks of a whole batch; new ones are cut into
parts, new parts go to the library, and the ids of the batch are gathered from those of its chunks. Only plain
texts take this way; the others (special strings, apostrophes, signs beyond Latin-1, runs of blanks where they
count) are handed over whole.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The letters of ASCII and Latin-1, and their other signs but apostrophe, white space and controls.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
OTHERS = "!-&(-@\\[-`{-~\xa1-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\xd7\xf7"
PLAIN = re.compile(f"[ \n{LETTERS}{OTHERS}]*")
#: Parts of a chunk, with the blank or line ends before them.
PART = re.compile(f"[ \n]*[{LETTERS}]+|[ \n]*[{OTHERS}]+|[ \n]+")
#: Stretches remembered in one worker process; beyond, the memory starts anew. More costs memory, fewer CPU time.
REMEMBERED = 600_000
#: Signs beyond Latin-1, so in no part; one that has an id of its own stands between parts encoded together.
MARKS = "—…”•€αя"


class Tokens:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.remembered = remembered
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        ids = lambda s: self.library.encode(s, add_special_tokens=False).ids
        #: White space only separates words; upper and lower case are one; the mark is one id.
        self.free = ids("a \n\n b") == ids("a") + ids("b") and ids(" \n") == []
        self.caseless = ids("\xc0B") == ids("\xe0b") and ids("Ab") == ids("ab")
        self.sign = next((m for m in MARKS if self.free and len(ids(m)) == 1), None)
        self.mark = ids(self.sign)[0] if self.sign else None
        self.chunks: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def forget(self) -> None:
        """Give the memory of stretches back: workers outlive a stage, and hold what they hold beside the next one's."""
        self.chunks, self.parts = {}, {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.int32).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, which has neither special strings nor letters beyond Latin-1."""
        if self.mark is None:
            return self.whole(parts)
        joined = ["".join([f"{p}\n{self.sign}\n" for p in parts[i : i + 256]]) for i in range(0, len(parts), 256)]
        ids = np.frombuffer(b"".join(self.whole(joined)), np.int32)
        ends = np.flatnonzero(ids == self.mark) * 4
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(ends[:-1] + 4).tolist()], ends.tolist())]

    def learn(self, chunks: list[str]) -> None:
        cut = [PART.findall(c) for c in chunks]
        known = self.parts
        new = list({p for ps in cut for p in ps if p not in known})
        known.update(zip(new, self.apart(new)))
        self.chunks.update((c, b"".join([known[p] for p in ps])) for c, ps in zip(chunks, cut))

    def plain(self, text: str) -> bool:
        if not PLAIN.fullmatch(text) or any(s in text for s in self.specials):
            return False
        return self.free or not ("  " in text or text[:1] == " " or text[-1:] == " ")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each whole text, as ``encode(text, add_special_tokens=False)`` gives them; null: none."""
        texts = [t or "" for t in texts]
        plain = [i for i, t in enumerate(texts) if self.plain(t)]
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(texts)
        for i, ids in zip(plain, self.gather([texts[i] for i in plain])):
            out[i] = ids
        rest = sorted(set(range(len(texts))) - set(plain))
        for i, ids in zip(rest, self.whole([texts[i] for i in rest])):
            out[i] = np.frombuffer(ids, np.int32)
        return out

    def gather(self, texts: list[str]) -> list[np.ndarray]:
        column = pa.array(texts, pa.large_string())
        if self.caseless:
            column = pc.utf8_lower(column)
        if self.free:
            column = pc.replace_substring(column, "\n", " ")
        split = pc.split_pattern(column, " ")
        coded = split.values.dictionary_encode()
        chunks, index = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        ends = split.offsets.to_numpy()
        if not self.free:  # all but a text's first chunk have a blank before them
            firsts = index[ends[:-1]]
            index[ends[:-1]] = len(chunks) + np.arange(len(texts))
            chunks = [" " + c for c in chunks] + [chunks[i] for i in firsts]
        for memory in (self.chunks, self.parts):
            if len(memory) > self.remembered:
                memory.clear()
        known = self.chunks
        self.learn(list({c for c in chunks if c not in known}))
        found = [known[c] for c in chunks]
        for c in [c for c in chunks if len(c) > 64]:
            known.pop(c, None), self.parts.pop(c, None)
        flat = np.frombuffer(b"".join(found), np.int32)
        sizes = np.array([len(f) for f in found], np.int64) // 4
        starts = np.cumsum(sizes) - sizes
        each = sizes[index]
        after = np.cumsum(each)
        ids = flat[np.repeat(starts[index] - (after - each), each) + np.arange(after[-1] if len(after) else 0)]
        stops = np.concatenate([[0], after])[ends]
        return [ids[a:b] for a, b in zip(stops[:-1], stops[1:])]


@functools.lru_cache(maxsize=4)
def tokens(path: str, remembered: int = REMEMBERED) -> Tokens:
    """One per worker process and file."""
    return Tokens(path, remembered)
