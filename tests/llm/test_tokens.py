"""BPE, token files and packing against the tokenizers library and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mossveil.llm import bpe, packing, queries, tokenfile
from mossveil.llm.tokens import Tokens

POOL = ["a", "'s", "S", " ", " ", "\n", "  ", "é", "é", "Σ", "İ", "ß", "½", "٣", "<|endoftext|>", "<|startoftext|>", "😀", "\x1c", "\x85", "　", "漢", "the", "ing", "'", "ll", "!!", "%", "\x00", "ª", "12", "x" * 30, "̸", "<", "ﬁ", "\t", "\r\n", "÷"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 24))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_and_text_equal_the_library(name):
    path = public_tokenizers.path(name)
    library, own, cached = Tokenizer.from_file(path), bpe.Bpe(path), Tokens(path)
    texts = odd_texts(3000) + ["ab" * 4000]
    for text, ids in zip(texts, cached.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert own.encode(text).tolist() == want
        assert own.decode(pa.ListArray.from_arrays([0, len(want)], pa.array(want, pa.int32())))[0].as_py() == library.decode(want, skip_special_tokens=False)


def docs(spark):
    rows = [(i * 3, t) for i, t in enumerate(odd_texts(200, 2))] + [(7, None), (8, ""), (9, "x " * 9000), (None, "null id"), (9, "again")]
    random.Random(3).shuffle(rows)
    return rows, spark.createDataFrame([(d, t, 1, "y") for d, t in rows], "doc_id long, text string, ids int, start string").repartition(3)


def test_bpe_operator(spark):
    rows, df = docs(spark)
    path = queries.WORDS
    library = Tokenizer.from_file(path)
    back = bpe.bpe_decode(bpe.bpe_encode(df, path, digest="sha"), path)
    assert set(back.columns) == {*df.columns, "sha", "decoded"}
    got = sorted(((r.doc_id or -1, r.text or "", r.ids, r.decoded, r.sha) for r in back.collect()), key=repr)
    enc = lambda t: library.encode(t or "", add_special_tokens=False).ids
    want = sorted(((d or -1, t or "", enc(t), library.decode(enc(t), skip_special_tokens=False), hashlib.sha256(np.array(enc(t), "<u4").tobytes()).hexdigest()) for d, t in rows), key=repr)
    assert got == want
    assert bpe.bpe_encode(df.limit(0), path).collect() == []


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 500)
    rows, df = docs(spark)
    library = Tokenizer.from_file(queries.WORDS)
    tokenfile.write_tokens(df, queries.WORDS, str(tmp_path / "t"), end_id=2)
    got = sorted(tokenfile.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    key = lambda d: -1 if d is None else d
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=key)
    enc = lambda t: library.encode(t or "", add_special_tokens=False).ids + [2]
    assert sorted((key(r.doc_id), r.ids) for r in got) == sorted((key(d), enc(t)) for d, t in rows)
    assert np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist() == [r.start for r in got]
    crc = {(r.start, r.ids_crc32) for r in tokenfile.read_tokens(spark, str(tmp_path / "t"), digest=True).collect()}
    assert crc == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}
    tokenfile.write_tokens(df.limit(0), queries.WORDS, str(tmp_path / "e"))
    assert tokenfile.read_tokens(spark, str(tmp_path / "e")).collect() == []


def test_huffman_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50):
        counts = rng.integers(0, 1000, n) ** 3 + 1
        lengths = tokenfile.code_lengths(counts)
        assert n == 1 or np.isclose((0.5 ** lengths.astype(float)).sum(), 1)
        import heapq

        heap, total = counts.tolist(), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            heapq.heappush(heap, (x := heapq.heappop(heap) + heapq.heappop(heap)))
            total += x
        assert n == 1 or (counts * lengths).sum() == total
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    limited = tokenfile.code_lengths(np.array(fib), 10)
    assert limited.max() == 10 and (0.5 ** limited.astype(float)).sum() <= 1


def test_packing(spark):
    rows, df = docs(spark)
    library = Tokenizer.from_file(queries.BYTES)
    got = packing.pack(packing.cut_pieces(df, queries.BYTES, size=64, end_id=1)).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    assert [r.length for r in sorted(got, key=lambda r: r.sequence_id)] == sorted(r.length for r in got)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 64 for r in got)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length for r in got)
    whole = {}
    for d in {r.doc_id for r in got if r.doc_id != 9}:
        mine = sorted((r for r in got if r.doc_id == d), key=lambda r: r.start)
        whole[d] = [i for r in mine for i in r.ids]
        assert [r.start for r in mine] == np.cumsum([0, *(r.length for r in mine)])[:-1].tolist() and mine[0].doc_tokens == len(whole[d])
    for d, t in rows:
        assert d == 9 or whole[d] == library.encode(t or "", add_special_tokens=False).ids + [1]
    with pytest.raises(ValueError):
        packing.cut_pieces(df, queries.BYTES, size=100)
