"""N-gram Jaccard join and embedding near-dedup against brute force."""

import random
import re

import numpy as np
import pyarrow as pa

from mossveil.llm import ngrams, vectors
from mossveil.llm.components import components


def brute_groups(ids, linked):
    root = dict(zip(ids, ids))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in ids}


def brute_docs(rows):
    def grams(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [(d, grams(t)) for d, t in rows]
    links, pairs = {d: 0 for d, _ in sets}, []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                pairs.append((a, b))
    groups = brute_groups([d for d, _ in sets], pairs)
    return {(d, links[d], groups[d], groups[d] == d) for d, _ in sets}


def test_ngram_join_equals_brute_force_on_a_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {tuple(r) for r in ngrams.near_duplicates(docs).collect()}
    assert got == brute_docs([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_ngram_join_large_groups_in_blocks(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choices(words, k=120)
    rows = [(i, " ".join(w if rng.random() > 0.012 else "x" for w in base)) for i in range(60)]
    rows += [(100 + i, " ".join(rng.choices(words, k=30))) for i in range(20)] + [(200, rows[0][1]), (201, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {tuple(r) for r in ngrams.near_duplicates(df, block=8).collect()}
    assert got == brute_docs(rows)


def test_ngram_join_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "a b", 0), (5, "a b", 1), (5, "a b", 1), (None, "a b", 2), (7, "a  b c", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int")
    got = sorted((tuple(r) for r in ngrams.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 2, 4, True), (5, 2, 4, False), (5, 2, 4, False), (None, 0, None, True), (7, 0, 7, True)], key=repr)
    assert ngrams.near_duplicates(df.limit(0)).collect() == []
    assert sorted(r.doc_id or 0 for r in ngrams.keep_one(df).collect()) == [0, 1, 2, 3, 4, 7]
    assert ngrams.keep_one(df).columns == df.columns


def test_bands_reach_the_target_recall():
    for threshold in (0.5, 0.7, 0.8, 0.95):
        for recall in (0.9, 0.999):
            bands, rows = ngrams.choose_bands(threshold, recall)
            assert 1 - (1 - threshold**rows) ** bands >= recall
            assert 1 - (1 - (threshold / 2) ** rows) ** bands <= 0.2


def test_the_pairs_compared_are_those_that_share_a_band_however_the_work_is_dealt(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for g in range(40):
        base = rng.choices(words, k=100)
        for k in range(4):
            rows.append((10 * g + k, " ".join(rng.choice(words) if rng.random() < 0.03 else w for w in base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # At a target recall of one half, many links share no band; the operator's are exactly those that do.
    bands, width = ngrams.choose_bands(0.8, 0.5)
    sets = ngrams.text_sets(pa.array([t for _, t in rows]), 5)
    signed = np.stack(ngrams.signatures(sets, bands, width)[0])
    links, all_links = {d: 0 for d, _ in rows}, 0
    for i in range(len(rows)):
        for j in range(len(rows)):
            common = len(np.intersect1d(sets[i], sets[j]))
            near = i != j and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common)
            all_links += near
            links[rows[i][0]] += bool(near and (signed[i] == signed[j]).any())
    got = {r.doc_id: r.n_links for r in ngrams.near_duplicates(df, recall=0.5, block=2).collect()}
    assert got == links and 0 < sum(links.values()) < all_links
    assert got == {r.doc_id: r.n_links for r in ngrams.near_duplicates(df, recall=0.5).collect()}


def brute_vectors(rows, threshold=0.9):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    x = np.stack([v / np.linalg.norm(v) for _, v in ok])
    ids = [i for i, _ in ok]
    hit = x @ x.T >= threshold
    np.fill_diagonal(hit, False)
    links = dict(zip(ids, hit.sum(1).tolist()))
    groups = brute_groups([i for i, _ in rows], [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(hit)))])
    return {i: (links.get(i, 0), groups[i]) for i, _ in rows}


def test_vectors_equal_brute_force_on_a_table(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    assert got == brute_vectors([(r.vec_id, r.embedding) for r in df.collect()])


def test_vectors_recall_near_the_threshold_and_precision(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((400, 32))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cos = rng.uniform(0.88, 0.95, (400, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * y]))]
    want = brute_vectors(rows)
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] <= want[i][0] for i in got)
    assert sum(got.values()) >= 0.97 * sum(n for n, _ in want.values())


def test_vectors_recall_holds_at_several_counts(spark):
    rng = np.random.default_rng(6)
    for count in (500, 4000):
        x = rng.standard_normal((count, 16))
        y = x + 0.45 * rng.standard_normal((count, 16)) * np.linalg.norm(x, axis=1, keepdims=True) / 4
        rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
        want = brute_vectors(rows)
        got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
        total = sum(n for n, _ in want.values())
        print(f"{count} pairs: recall {sum(got.values()) / total} of {total} links, tables {vectors.tables(2 * count, 0.9, 0.995)}")
        assert total > count / 2 and all(got[i] <= want[i][0] for i in got) and sum(got.values()) >= 0.98 * total


def test_a_recall_of_one_finds_every_link(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((150, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, x + 0.13 * rng.standard_normal((150, 12)), x[:5]]))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=1, block=64).collect()}
    assert got == brute_vectors(rows)
    words = [f"w{k}" for k in range(60)]
    texts = [(i, " ".join(words[: 60 - i % 12] + [f"x{i}"] * (i % 3))) for i in range(90)] + [(200, ""), (201, None)]
    assert {tuple(r) for r in ngrams.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), recall=1, block=16).collect()} == brute_docs(texts)


def test_an_id_with_two_vectors_is_two_rows(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.1, 1.0]
    rows = [(1, a), (1, b), (2, a), (3, b), (3, c), (4, c), (4, c)]
    got = sorted(tuple(r) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (3, 2, 3, True), (4, 2, 3, False), (4, 2, 3, False)])


def test_vectors_blocks_copies_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(8)
    rows = [(i, (base + 0.02 * rng.standard_normal(8)).tolist()) for i in range(40)] + [(50 + i, base.tolist()) for i in range(5)]
    rows += [(60, None), (61, []), (62, [0.0] * 8), (63, [1.0, None] + [0.0] * 6), (64, [float("nan")] * 8), (65, (3 * base).tolist()), (66, [1e300] * 8), (67, [1e300] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as key", "2 as rep")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df, block=6).collect()}
    assert got == {**brute_vectors(rows), 66: (1, 66), 67: (1, 66)}
    assert vectors.near_vectors(df.limit(0)).collect() == []


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}
