"""Language mixtures, the divergence audit and hard negatives: accuracy, SQL, brute force and odd rows."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mossveil.llm import divergence, languages, negatives, queries

SYLLABLES = {"xx": "ba be bi bo bu da de di".split(), "yy": "kra kre kri stro stru pla ple pli".split(), "zz": "öö üü äß ßö äü öä üß ßü".split()}


def text_in(lang, words, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(text_in(lang, 50, rng), lang) for lang in SYLLABLES for _ in range(20)] + [(None, "xx"), ("ba be", None), ("", "yy")]
    return languages.learn(spark.createDataFrame(rows, "text string, lang string"))


def test_languages_of_mixed_and_odd_texts(spark, model):
    assert model.languages == ["xx", "yy", "zz"]
    rng = random.Random(2)
    mixed = text_in("xx", 140, rng) + ". " + text_in("zz", 60, rng)
    three = " ".join(text_in(lang, n, rng) for lang, n in (("xx", 40), ("yy", 100), ("zz", 60)))
    texts = [text_in("yy", 40, rng).upper(), mixed, three, None, "", "12 34 !?", "q", text_in("zz", 30_000, rng), "ba" * 40_000]
    rows = [(i, t, "a", 1) for i, t in enumerate(texts)] + [(1, mixed, "a", 1), (None, texts[0], None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, `_row` int").selectExpr("*", "3 as `a.b`", "4 as `c``d`", "text as _text")
    got = languages.identify(df, model)
    assert got.columns == ["doc_id", "text", "_row", "a.b", "c`d", "_text", "lang_pred", "score", "languages"]
    got = got.collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 11 and [by[i].lang_pred for i in range(9)] == ["yy", "xx", "yy", "und", "und", "und", by[6].lang_pred, "zz", "xx"]
    assert by[6].lang_pred in model.languages and [by[i].score for i in (0, 3, 4, 5, 7)] == [1.0, 0.0, 0.0, 0.0, 1.0]
    parts = {x.lang: x.proportion for x in by[1].languages}
    assert set(parts) == {"xx", "zz"} and abs(parts["xx"] - 0.7) < 0.05 and by[1].score == parts["xx"]
    assert {x.lang for x in by[2].languages} == set(SYLLABLES) and abs(by[2].score - 0.5) < 0.05
    assert by[0].languages[0].lang == "yy" and len(by[0].languages) == 1 and by[None].lang_pred == "yy" and by[0]["a.b"] == 3
    assert languages.identify(df.limit(0), model).collect() == []
    nothing = languages.learn(df.limit(0).withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in languages.identify(df, nothing).collect()} == {("und", 0.0)}


def test_a_mixture_is_likelier_than_any_grid_point():
    rng = np.random.default_rng(3)
    chances = rng.random((300, 2)) ** 3 + 1e-9
    now, likelihood = languages.proportions(chances)
    grid = [np.log(chances @ np.array([p, 1 - p])).sum() for p in np.linspace(0.001, 0.999, 999)]
    assert abs(now.sum() - 1) < 1e-9 and likelihood >= max(grid) - 1e-2


def test_words_are_the_same_however_texts_are_cut_into_batches():
    texts = ["Été, d'où? naïve", None, "", "x1y ẞß İi", "नमस्ते दुनिया", "\U0001f600a"]
    whole = languages.words_of(pa.array(texts), 1 << 18)
    grams = [languages.words_of(pa.array([t], pa.string()), 1 << 18) for t in texts]
    assert whole[0].tolist() == [g for x in grams for g in x[0].tolist()] and np.diff(whole[2]).tolist() == [len(x[1]) for x in grams] == [4, 0, 0, 4, 2, 1]


def test_languages_of_held_out_documents(spark, small):
    got = queries.op11_languages(spark, small).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    asked = [r for r in got if r.held_out and docs[r.doc_id].text and docs[r.doc_id].lang]
    assert len(asked) > 30 and np.mean([r.lang_pred == docs[r.doc_id].lang for r in asked]) >= 0.97


def test_divergence_of_odd_rows_equals_sql(spark, tmp_path):
    rng = random.Random(4)
    words = ["Zß", "zß", "aB", "AB", "é1é", "x" * 300, "a_b", "\x00n", "日本 語"] + [f"w{i}" for i in range(40)]
    rows = []
    for i in range(400):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "a", "a", "b", "ß", None, ""])
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 5, 60]))), lang, source))
    rows += [(7, "same same text", "en", "a")] * 40 + [(8, None, "fr", "a"), (9, "rare", "fr", "b"), (9, "rare", "fr", None), (10, "123 ...", "it", "only"), (None, "ab " * 50_000, "en", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as n", "2 as shard", "3 as value").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(divergence.ORACLE).fetchall()
    got = queries.op12_divergence(spark, str(tmp_path))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and {("fr", "a", "pair", "", 0, 1), ("fr", "a", "pair", "b", 0, 2)} <= set(want)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, divergence.divergence(docs, shards=3).collect())) == sorted(want)
    assert divergence.divergence(docs.limit(0)).collect() == []


def test_divergence_passes_counts_on_before_it_holds_too_many(spark, small, monkeypatch):
    from mossveil.llm.divergence import count_terms, with_duckdb

    monkeypatch.setattr(divergence, "HELD", 10)
    batch = pa.RecordBatch.from_pydict({"lang": ["a"] * 4, "source": ["s"] * 4, "text": ["x y x", "", "x", "Z z Y"]})
    out = pa.Table.from_batches(list(with_duckdb(count_terms)(iter([batch] * 9)))).to_pylist()
    total = {}
    for r in out:
        total[r["term"]] = total.get(r["term"], 0) + np.array([r["n"], r["docs"]])
    assert len(out) > 3 and {k: v.tolist() for k, v in total.items()} == {"x": [27, 18], "y": [18, 18], "z": [18, 9]}


def brute_negatives(rows, every=50, positives=5, negatives=3):
    good = [(i, int(lab), [int(np.clip(np.floor(256.0 * x), -(1 << 26), 1 << 26)) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, lab, v in sorted(good):
        if i % every == 0:
            anchors.setdefault(i, (lab, v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))

    def first(pairs, k):
        most = {}
        for s, i in pairs:
            most[i] = max(s, most.get(i, s))
        return sorted(((-s, i) for i, s in most.items()))[:k]

    out = []
    for a, (lab, v) in anchors.items():
        scored = [(dot(v, w), i, other) for i, other, w in good if i != a]
        for p, pid in first([(s, i) for s, i, other in scored if other == lab], positives):
            p = -p
            chosen = first([(s, i) for s, i, other in scored if other != lab and 50 * p <= 100 * s <= 95 * p], negatives)
            out += [(a, pid, r + 1, i, p, -s) for r, (s, i) in enumerate(chosen)]
    return sorted(out)


def odd_vectors(seed=5, count=600, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    rows = [(i, (centres[rng.integers(8)] + 0.3 * rng.normal(size=dim)).tolist(), int(rng.integers(4))) for i in range(count)]
    rows += [(1000 + i, rows[0][1], int(rng.integers(4))) for i in range(200)]  # copies, among them anchors
    rows += [(2000, [0.0] * dim, 1), (2050, [], 1), (2100, [1.0, float("nan")], 1), (2150, None, 1), (2200, [1.0] * dim, None), (None, [1.0] * dim, 2), (2250, [0.5, None], 0), (2300, [2.0, 1.0], 3), (2350, [float("inf")], 0)]
    rows += [(50, rows[3][1], 1), (7, rows[3][1], 2), (7, rows[3][1], 2), (2400, [-1.0] * dim, 9), (2450, [1e30, -1e30], 2), (2500, [0.25] * dim, 17)]
    return rows


@pytest.mark.parametrize("options", [{}, {"block": 40, "anchors": 3, "lanes": 3, "pivots": 4, "sample": 20}, {"pivots": 1, "sample": 1, "lanes": 1}])
def test_hard_negatives_equal_brute_force(spark, options):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as x", "2 as block", "3 as far", "'s' as a_block").repartition(4)
    got = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want
    if not options:
        assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
        assert negatives.hard_negatives(df, F.lit(None).cast("boolean")).collect() == []


def test_hard_negatives_of_the_table(spark, small):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.label is not None and r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op13_negatives(spark, small).collect())) == brute_negatives(rows)


def test_brackets_hold_every_distance():
    rng = np.random.default_rng(6)
    x = rng.integers(-300, 300, size=(400, 8))
    table = negatives.Pivots(x[:50], int((x * x).sum(1).max()), 7)
    far, q = table.distances(table.lifted(x.astype(float))), np.hstack([x[:40].astype(float), np.zeros((40, 1))])
    asked = table.distances(q)
    gap, reach = np.abs(asked[:, None] - far[None]).max(2), (asked[:, None] + far[None]).min(2)
    score, square = x[:40] @ x.T, (x[:40] ** 2).sum(1)[:, None]
    assert ((square + table.square - reach**2) / 2 - 1e-3 <= score).all() and (score <= (square + table.square - gap**2) / 2 + 1e-3).all()
