"""Quality rules, chat windows, archives and the pipeline: SQL, round trips and odd rows."""

import base64
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mossveil.llm import chat, ngrams, passages, quality, queries, warc


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = queries.QUERIES[name](spark, small)
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_quality_odd_rows(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(1, good, "a", -5, "t1", 0), (2, None, "a", 2, "t2", 0), (3, "", None, 3, "t3", 0), (4, "x y z " * 30, "b", 4, "t4", 0), (5, good, None, 5, "t5", 0), (5, good, None, 5, "t5", 0), (6, "\x0b", "b", 6, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, _t string, base_failed int").selectExpr("*", "1 as _row", "text as _text", "2 as kept", "source as host", "3 as `a.b`")
    got = {(r.doc_id): (r.n_words, r.n_repeat_words, r.base_failed) for r in quality.with_base_rules(df).collect()}
    assert got == {1: (60, 0, False), 2: (0, 0, True), 3: (0, 0, True), 4: (90, 90, True), 5: (60, 0, False), 6: (0, 0, True)}
    fewer = quality.with_base_rules(df.drop("base_failed"), figures=("n_dup_lines",))
    assert fewer.columns == [c for c in df.columns if c != "base_failed"] + ["n_dup_lines", "base_failed"]
    assert {r.doc_id: r.base_failed for r in fewer.collect()} == {d: v[2] for d, v in got.items()}
    same = [tuple(r) for r in df.collect() if r.doc_id in (1, 5)]
    assert sorted(map(tuple, quality.keep_good(df).collect())) == sorted(same)
    assert quality.keep_good(df).dtypes == df.dtypes
    judged = quality.judge(quality.with_base_rules(df).cache())
    assert {(r.doc_id, r.kept, r._t, r["a.b"], r._row, r.host) for r in judged.collect()} == {(d, d in (1, 5), t, 3, 1, s) for d, _, s, _, t, _ in rows}
    assert quality.keep_good(df.limit(0)).collect() == []


def test_host_verdicts_remove_rows_of_a_planted_table(spark, tmp_path):
    """By construction: two of 22 hosts fail much more often than the rest, one small host has bad luck, one is hot."""
    rng = random.Random(1)
    rows = []
    for host in range(22):
        rate, n = {3: (0.5, 300), 4: (0.7, 60), 5: (1.0, 2), 0: (0.1, 2000)}.get(host, (rng.uniform(0.05, 0.15), 150))
        for k in range(n):
            size = 20 if k < rate * n else 60
            rows.append((len(rows), " ".join(f"w{rng.randrange(10**6)}" for _ in range(size)), f"h{host}" if host != 4 else None))
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute("SELECT doc_id, length(text) - length(replace(text, ' ', '')) + 1 >= 50 AND source <> 'h3' AND source IS NOT NULL FROM documents").fetchall()
    want = {d: bool(k) for d, k in want}
    removed = sum(len(t.split()) >= 50 and not want[d] for d, t, _ in rows)
    assert removed > 150
    got = {r.doc_id: r.kept for r in queries.QUERIES["op4_quality"](spark, str(tmp_path)).collect()}
    assert got == want
    assert {d: k for d, *_, k in con.execute(queries.ORACLES["op4_quality"]).fetchall()} == want
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {d for d, k in want.items() if k}


def test_a_host_that_fails_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 10 == 0 else "short", "bad") for i in range(100)] + [(100 + i, good, f"s{i % 20}") for i in range(400)] + [(999, "short", "once")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.keep_good(df).collect()}
    assert kept == set(range(100, 500))
    rates = {r.host: r.host_rate for r in quality.host_verdicts(quality.with_base_rules(df)).collect()}
    assert 0.8 < rates["bad"] < 0.9 and rates["once"] < 1


def conversation(spark):
    long = "word " * 400
    rows = [(1, 0, "system", "be # <kind>"), *[(1, i, "user" if i % 2 else "assistant", long + str(i)) for i in range(1, 21)]]
    rows += [(2, 0, "assistant", "### Assistant: </turn>\n\\b\\h \\"), (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (None, None, None, None), (3, 5, "a: b", "x" * 3000)]
    return rows, spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, window string")


def test_chat_reads_back_what_went_in(spark):
    rows, df = conversation(spark)
    windows = chat.chat_windows(df, budget=1800, history=550)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for c in (1, 2, 3, None):
        mine = sorted(((t if t is not None else -1, r or "", x or "") for k, t, r, x in rows if k == c), key=lambda m: (m[0], m[1], hashlib.md5(m[2].encode()).hexdigest()))
        whole = "".join(f"{r}\n{x}\n" for _, r, x in mine)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    first = sorted((w for w in windows.collect() if w.conv_id == 1), key=lambda w: w.window)
    assert len(first) > 3 and all(w.n_tokens <= 1800 for w in first)
    assert all(w.text.startswith("### system: be \\h \\lkind>") for w in first)
    assert [w.n_repeated for w in first][0] == 0 and all(w.n_repeated == 2 for w in first[1:])
    assert chat.read_back(chat.chat_windows(df.limit(0))).collect() == []


def test_warc_round_trip(spark, tmp_path):
    html = "<p>a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n</p>é"
    rows = [(3, "http://a.example/x?y#z", html), (1, "http://b.example", html), (2, None, None), (9, "", ""), (9, "", ""), (None, "http://c\r\nEvil: 1", "only"), (7, "u", "x" * 300_000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, kind string").repartition(3)
    warc.write_warc(df, str(tmp_path / "w"))
    captures = warc.assemble(warc.read_records(spark, str(tmp_path / "w"))).collect()
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    got = sorted((int(c.metadata.fields.get("pageId", -1)), c.capture.kind, c.capture.digest, bytes(c.capture.payload or b"").decode(), c.metadata.fields.get("refersToPage")) for c in captures)
    want = [(-1, "response", digest("only"), "only", None), (1, "response", digest(html), html, None), (2, "response", digest(""), "", None), (3, "revisit", digest(html), "", "1"), (7, "response", digest("x" * 300_000), "x" * 300_000, None)]
    assert got == sorted(want + [(9, "revisit", digest(""), "", "2")] * 2)
    assert all(c.request.kind == "request" for c in captures)
    warc.write_warc(df.limit(0), str(tmp_path / "e"))
    assert warc.assemble(warc.read_records(spark, str(tmp_path / "e"))).collect() == []


def test_pipeline_stages_on_planted_documents(spark, tmp_path):
    import random

    rng = random.Random(1)
    some = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    clean = {i: " ".join(some(100)) for i in range(20)}
    near = clean[0].split()
    near[50] = "changed"
    passage = some(70)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in clean.items()]
    rows += [(30, "too short", "en", "s0", 9), (31, clean[1], "en", "s1", 1), (32, "\n".join(" ".join(near[k : k + 25]) for k in range(0, 100, 25)), "en", "s2", 1)]
    rows += [(33, " ".join(some(60) + passage), "en", "s0", 1), (34, " ".join(passage + some(60)), "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    ids = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if i == 3:
            cut = {r.doc_id: r.text.split() for r in docs.collect()}
    assert 30 not in ids[0] and 31 in ids[0]
    assert 31 not in ids[1] and 32 in ids[1]
    assert 32 not in ids[2]
    assert ids[2] == ids[3] == ids[4] == set(range(20)) | {33, 34}
    assert all(cut[i] == clean[i].split() for i in range(20)) and len(cut[33]) == 130 and len(cut[34]) == 60
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "substring_dedup", "packing"]


def test_stages_take_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert out.count() == 0
    assert ngrams.near_duplicates(docs).count() == passages.repeated_passages(docs).count() == 0
    assert docs.select(F.count("*")).first()[0] == 0


def test_chat_windows_count_texts_without_blanks_and_given_tokens(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", "漢" * 900, 100) for k in range(12)] + [(2, None, "user", f"turn {k}", 100) for k in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int")
    estimated = {c: sum(r.conv_id == c for r in chat.chat_windows(df, budget=2048).select("conv_id").collect()) for c in (1, 2)}
    assert estimated[1] >= 6  # by bytes a turn has 677 tokens, by words 3
    given = chat.chat_windows(df, budget=2048, tokens="n").select("conv_id", "n_tokens", "n_repeated").collect()
    assert all(r.n_tokens <= 2048 for r in given)
    assert sum(r.n_tokens - 100 * r.n_repeated for r in given if r.conv_id == 2) == 70_000
    assert sum(r.conv_id == 1 for r in given) < 4


def test_scratch_is_one_folder_that_can_be_cleared(spark):
    from pathlib import Path

    from mossveil.llm import common

    kept = common.saved(spark.range(5), "five")
    assert kept.count() == 5
    folder = Path(common.scratch_dir(spark).removeprefix("file:"))
    assert any(folder.glob("five-*"))
    common.clear_scratch(spark)
    assert not folder.exists()


def test_archives_of_others_and_damaged_ones(spark, tmp_path):
    import gzip

    record = lambda kind, i, body, length=None: (f"WARC/1.1\r\n{kind}WARC-Record-ID: <{i}>\r\n" + (f"Content-Length: {len(body) if length is None else length}\r\n" if length != "" else "") + f"\r\n{body}\r\n\r\n").encode()
    good = "HTTP/1.1 200 OK\r\n\r\n"
    whole = record("WARC-Type: response\r\n", 1, good + "a") + record("WARC-Type: response\r\n", 2, good + "b", "") + record("WARC-Type: response\r\n", 3, good + "c", "x") + record("", 4, "d") + record("WARC-Type: response\r\n", 5, good + "e") + record("WARC-Type: response\r\n", 6, "cut", 999)
    (tmp_path / "a.warc").write_bytes(b"noise\r\n" + whole)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record("WARC-Type: response\r\n", 7, good + "f")) + gzip.compress(record("WARC-Type: response\r\n", 8, good + "g")))
    damaged = gzip.compress(record("WARC-Type: response\r\n", 9, good + "h") + random.Random(1).randbytes(200_000))
    (tmp_path / "c.warc.gz").write_bytes(damaged[:100_000] + b"\xff" * 50 + damaged[100_050:])
    (tmp_path / "d.warc.gz").write_bytes(b"")
    got = warc.read_records(spark, str(tmp_path), files="*.warc*").collect()
    assert {(r.kind, r.record_id, bytes(r.payload).decode() if r.payload else None) for r in got} == {("response", "<1>", "a"), (None, "<4>", None), ("response", "<5>", "e"), ("response", "<7>", "f"), ("response", "<8>", "g"), ("response", "<9>", "h")}


def test_turns_without_tokens_do_not_all_fit_one_window(spark):
    rows = [(1, i, "user", f"t{i}", None if i % 2 else 0) for i in range(6000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int")
    got = chat.chat_windows(df, tokens="n").collect()
    assert len(got) >= 3 and all(r.n_tokens <= 2048 for r in got) and sum(r.text.count("</turn>") - r.n_repeated for r in got) == 6000


def test_stages_take_nulls_repeats_and_clashing_columns(spark, small):
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b = text(90), text(300)
    rows = [(1, a, "en", "s"), (1, a, "en", "s"), (1, text(70), "en", "s"), (2, None, None, None), (3, "", "en", "s"), (None, text(80), "en", None), (4, f"{text(10)} {a}", "en", "s"), (5, b, "en", "s"), (6, " ".join(b.split()[:299]) + " x", "en", "s"), (7, text(50_000), "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) as n_chars", "1 as kept", "2 as _row", "3 as start", "4 as `q``q`", "5 as `d.d`")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, df, small)
        assert got.columns == df.columns, name
        rows_got = got.collect()
        kept = {r.doc_id for r in rows_got}
        assert {1, 5, 7, None} <= kept and all((r.kept, r._row, r.start, r["q`q"], r["d.d"]) == (1, 2, 3, 4, 5) for r in rows_got)
        assert (2 in kept and 3 in kept) == (name != "quality_rules")
        if name == "ngram_join":
            assert 6 not in kept and sum(r.doc_id == 1 for r in rows_got) == 3
        if name == "substring_dedup":
            assert len(next(r.text for r in rows_got if r.doc_id == 4).split()) == 10
    pieces = corpus_pipeline.pack(spark, df, small).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3, 4, 5, 6, 7, None} and len({r.sequence_id for r in pieces}) == len(pieces)


def test_hosts_that_differ_by_chance_are_not_condemned():
    import numpy as np

    def condemned(rates, rng):
        n = np.minimum(rng.zipf(1.5, len(rates)), 5000).astype(float)
        k = rng.binomial(n.astype(int), rates).astype(float)
        a, b = quality.beta_prior(k.sum(), n.sum(), (k * k / n).sum(), len(n))
        rate, weight = (k + a) / (n + a + b), n + a + b
        lower = rate - 3 * np.sqrt(rate * (1 - rate) / (weight + 1))
        return (lower * b >= 3 * a * (1 - lower)).sum()

    rng = np.random.default_rng(1)
    assert sum(condemned(np.full(1000, p), rng) for p in (0.02, 0.1, 0.3, 0.5) for _ in range(100)) == 0
    assert 0 < sum(condemned(rng.beta(1, 9, 1000), rng) for _ in range(100)) < 1000
