"""Sources, jobs and user extensions: faults on the way, restarts, many spans, and names that clash."""

import os
import time

import pytest
from pyspark.sql import functions as F

from mossveil.functions import detectors as rules
from mossveil.functions import resolve as res
from mossveil.functions.spans import SPANS, near_digits
from mossveil.operators import custom, limits, scan
from mossveil.operators import evaluate as ev
from mossveil.sources import files, synthetic
from mossveil.streaming import jobs


def test_a_broken_line_fails(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"text": "a", "labels": []}\n\n{"doc_id": 3, "text": "b", "difficulty": "easy"}\n')
    got = {(r.text, r.difficulty, r.doc_id == 3) for r in files.read_labelled(spark, str(tmp_path / "good.jsonl")).collect()}
    assert got == {("a", "unknown", False), ("b", "easy", True)}
    (tmp_path / "bad.jsonl").write_text('{"doc_id": 1, "text": "a"}\n{broken\n')
    with pytest.raises(Exception):
        files.read_labelled(spark, str(tmp_path / "bad.jsonl")).collect()


def test_guards_come_in_order(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a.txt").write_text("가 b")
    (root / "big.txt").write_bytes(b"x" * 30)
    (root / "bytes.txt").write_bytes(b"\xff\xfe")
    (root / "folder.txt").mkdir()
    (tmp_path / "secret.txt").write_bytes(b"\xff" * 99)
    (root / "link.txt").symlink_to(tmp_path / "secret.txt")
    (root / "up").symlink_to(tmp_path)
    names = ["a.txt", "big.txt", "bytes.txt", "folder.txt", "link.txt", "none.txt", "../secret.txt", "up/secret.txt", "../nowhere.txt", None]
    df = spark.createDataFrame([(f"{root}/{n}" if n else None,) for n in names], "path string")
    got = [(r.status, r.text) for r in files.read_guarded(df, str(root), max_bytes=20).collect()]
    assert got == [("ok", "가 b"), *[(s, None) for s in ("too large", "not UTF-8", "missing", "link", "missing", "outside", "outside", "outside", "missing")]]


def test_a_lost_writer_leaves_no_copy(spark, tmp_path, monkeypatch):
    target = tmp_path / "a_masked.txt"
    real = os.link
    monkeypatch.setattr(os, "link", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        files.put(str(target), "half", False)
    assert not target.exists() and list(tmp_path.iterdir()) == []
    monkeypatch.setattr(os, "link", real)
    assert files.put(str(target), "whole", False) == "written" and files.put(str(target), "other", False) == "exists" and target.read_text() == "whole"
    assert files.put(str(target), "new", True) == "written" and target.read_text() == "new" and files.put(str(tmp_path / "none" / "x"), "t", False).startswith("failed")
    assert [p.name for p in tmp_path.iterdir()] == ["a_masked.txt"]
    inside = tmp_path / "in"
    inside.mkdir()
    df = spark.createDataFrame([(f"{inside}/x.txt", "t"), (f"{tmp_path}/y.txt", "t"), (f"{inside}/../z.txt", "t"), (f"{inside}/n.txt", None)], "path string, anonymized string")
    assert [r.status for r in files.write_masked_copies(df, root=str(inside)).collect()] == ["written", "outside", "outside", "no text"]


def test_the_stream_limits_by_the_time_of_the_data(spark, tmp_path):
    """Files come one by one, with pauses longer than the window between them, as a slow or replayed stream has them."""
    batches = [[("a", 0.0), ("a", 0.5), ("b", 0.2), (None, 0.1)], [("a", 1.0), ("a", 3.2), ("b", None)], [("a", 3.4), ("b", 9.0), (None, 9.5)], [("a", 9.6), ("a", 9.7), ("a", 9.8), ("c", 30.0)], [("a", 31.0)]]
    batches = [[(c, t if t is None else 1000 + t) for c, t in rows] for rows in batches]
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema("client string, at double").json(str(source))
    seen = []
    query = jobs.rate_limit_stream(stream, 2, 3.0, delay="5 seconds").writeStream.outputMode("append").foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, "client string, at double").coalesce(1).write.json(str(tmp_path / f"out{i}"))
            for f in (tmp_path / f"out{i}").glob("part-*.json"):
                f.rename(source / f"{i}.json")
            query.processAllAvailable()
            time.sleep(3.5 if i == 0 else 0.1)
    finally:
        query.stop()
    want = limits.rate_limit(spark.createDataFrame([r for b in batches for r in b], "client string, at double"), 2, 3.0).collect()
    assert sorted(map(repr, seen)) == sorted(repr(tuple(r)) for r in want)
    assert {(c, t): ok for c, t, ok, _ in seen}[("a", 1001.0)] is False


def test_a_folder_is_worked_off_and_a_marker_stops_it(spark, tmp_path):
    folder, state, stop = tmp_path / "docs", str(tmp_path / "state"), tmp_path / "stop"
    folder.mkdir()
    for i in range(4):
        (folder / f"{i}.txt").write_text(f"mail a{i}@b.co")
    (folder / "bad.txt").write_bytes(b"a\0b")
    (folder / "skip.exe").write_bytes(b"x")
    (folder / "2_masked.txt").write_text("mine")
    names = lambda rows: {os.path.basename(r.path): (r.status, r.reason) for r in rows}
    stop.touch()
    got = names(jobs.file_job(spark, str(folder), state, str(stop), files_per_batch=2, strategy="mask").collect())
    assert got == {f"{n}.txt": ("waiting", None) for n in (0, 1, 2, 3, "bad")} and not (folder / "0_masked.txt").exists()
    stop.unlink()
    got = names(jobs.file_job(spark, str(folder), state, str(stop), files_per_batch=2, strategy="mask").collect())
    assert got == {**{f"{n}.txt": ("done", None) for n in (0, 1, 3)}, "2.txt": ("failed", "exists"), "bad.txt": ("failed", "binary")}
    assert (folder / "1_masked.txt").read_text() == "mail *******" and (folder / "2_masked.txt").read_text() == "mine"
    (folder / "new.txt").write_text("x@y.zz")
    before = (folder / "1_masked.txt").stat().st_mtime_ns
    got = names(jobs.file_job(spark, str(folder), state, str(stop), strategy="mask").collect())
    assert got["new.txt"] == ("done", None) and len(got) == 6 and (folder / "1_masked.txt").stat().st_mtime_ns == before


def test_a_table_function_equals_the_operator(spark):
    find = lambda t: [(i, i + 2, 0.5) for i in range(len(t) - 1) if t[i : i + 2] == "ab"]
    df = spark.createDataFrame([(1, "ab xab"), (2, None), (3, ""), (4, "none")], "doc_id long, text string")
    df.createOrReplaceTempView("docs_of_test")
    custom.register_detector(spark, "find_ab", "ab", find)
    got = spark.sql("SELECT d.doc_id, s.kind, s.start, s.end, s.text, s.confidence FROM docs_of_test d, LATERAL find_ab(d.text) s").collect()
    want = scan.explode_spans(custom.detect_with(df, "ab", "X", find), "doc_id", spans="custom_spans", with_text=True).drop("detector").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) == [(1, "ab", 0, 2, "ab", 0.5), (1, "ab", 4, 6, "ab", 0.5)]
    with pytest.raises(Exception, match="find_ab takes one text"):
        spark.sql("SELECT * FROM find_ab(1)").collect()


def test_each_text_is_asked_once(spark):
    rows = [(i, "고객 강하늘님이 왔다", "x") for i in range(1000)] + [(2000, "12345", "y"), (2001, None, None), (2002, "박바다님 방문", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _may string").withColumn("_key", F.lit(1)).repartition(5)
    calls = spark.sparkContext.accumulator(0)
    done = custom.detect_names_with(df, lambda t: ["강하늘", "박바다"], calls=calls)
    assert done.columns == ["doc_id", "text", "_may", "_key", "name_spans"]
    got = {r.doc_id: (r._may, sorted({(s.start, s.end) for s in r.name_spans})) for r in done.collect()}
    assert calls.value == 2 and len(got) == 1003
    assert got[5] == ("x", [(3, 6)]) and got[2000] == ("y", []) and got[2001] == (None, []) and got[2002] == ("z", [(0, 3)])


def test_the_corpus_source(spark):
    synthetic.register(spark)
    read = lambda **o: spark.read.format("mossveil_corpus").options(**o).load()
    docs = read(count=600, seed=7, partitions=4).cache()
    rows = sorted(docs.collect())
    assert [r.doc_id for r in rows] == list(range(600)) and rows == sorted(read(count=600, seed=7).collect())
    assert rows != sorted(read(count=600, seed=8).collect()) and read(count=0).collect() == []
    share = {d: sum(r.difficulty == d for r in rows) / 600 for d in ("negative", "easy", "hard")}
    assert abs(share["negative"] - 0.25) < 0.07 and share["easy"] > 0.25 and share["hard"] > 0.25
    assert all(r.text[x.start : x.end].strip() == r.text[x.start : x.end] != "" for r in rows for x in r.labels)
    assert all(not r.labels for r in rows if r.difficulty == "negative") and {x.kind for r in rows for x in r.labels} == set(rules.DEFAULT)
    assert {r.difficulty for r in read(count=50, negative=1.0).collect()} == {"negative"}
    several = read(count=80, negative=0.0, multi=1.0).collect()
    assert all(len(r.labels) >= 2 for r in several)
    found = {(r.section, r.name): (r.tp, r.fp, r.fn) for r in ev.report(scan.scan(docs)).collect()}
    assert found[("overall", "__overall__")] == (sum(len(r.labels) for r in rows), 0, 0)
    with pytest.raises(Exception):
        read(count=1, negative=2.0).collect()


def test_the_report_equals_its_parts(spark, tmp_path):
    docs = synthetic.for_keys(spark.range(300), "id", seed=3)
    # Some findings are moved or dropped, so that there are misses and false ones at several confidences.
    moved = F.transform(F.filter("spans", lambda s: s["start"] % 5 != 0), lambda s: s.withField("end", s["end"] + F.when(s["start"] % 3 == 0, 1).otherwise(0)))
    both = scan.scan(docs).withColumn("spans", moved).withColumn("difficulty", F.expr("nullif(difficulty, 'hard')")).cache()
    gold = both.select("doc_id", F.explode("labels").alias("l")).select("doc_id", "l.*")
    found = scan.explode_spans(both, "doc_id")
    reported = ev.report(both)
    got = {(r.section, r.name): (r.tp, r.fp, r.fn, round(r.f1, 9)) for r in reported.collect()}
    row = lambda r: (r.tp, r.fp, r.fn, round(r.f1, 9))
    want = {("overall" if r.kind == "__overall__" else "kind", r.kind): row(r) for r in ev.evaluate(gold, found).collect()}
    want |= {("difficulty", r.difficulty): row(r) for r in ev.evaluate_by_difficulty(gold, found, both).collect()}
    want |= {("threshold", str(r.threshold)): row(r) for r in ev.threshold_sweep(gold, found).collect()}
    assert got == want and want[("overall", "__overall__")][1] > 0 and ("difficulty", "unknown") in got
    text = ev.full_report(reported, 300, "made", str(tmp_path / "new" / "report.md"))
    assert (tmp_path / "new" / "report.md").read_text() == text and "(300 documents)" in text
    assert [x for x in text.splitlines() if x.startswith("## ")] == ["## By kind", "## By difficulty", "## By least confidence"] and text.count("**overall**") == 2
    assert {r.section for r in ev.report(both.limit(0)).collect()} <= {"overall", "threshold"}


def test_columns_of_the_caller_stay(spark):
    df = spark.createDataFrame([("a@b.co", 1, 2, 3, 4, 5)], "text string, _raw int, _near int, _shown int, `x``y` int, `a.b` int")
    done = scan.display(scan.scan(scan.detect(df)), out="anonymized")
    assert done.columns == ["text", "_raw", "_near", "_shown", "x`y", "a.b", "raw_spans", "spans", "anonymized"]
    assert tuple(done.first())[1:6] == (1, 2, 3, 4, 5) and done.first().anonymized == "******"
    with pytest.raises(ValueError):
        scan.explode_spans(done.withColumn("kind", F.lit(1)), "kind")
    assert scan.explode_spans(done, "x`y", "a.b").columns[:2] == ["x`y", "a.b"]


def test_twenty_thousand_spans(spark):
    n = 20_000
    text = " ".join(f"u{i % 500}@m{i % 7}.co😀" for i in range(n))
    df = spark.createDataFrame([(text,)], "text string")
    scan.anonymize(scan.scan(df.limit(0), detectors={"email": rules.email}), strategy="label", numbered=True).collect()
    start = time.time()
    found = scan.scan(df, detectors={"email": rules.email})
    got = scan.anonymize(found, strategy="label", numbered=True).first().anonymized
    assert time.time() - start < 20
    seen = {}
    assert got == " ".join(f"[이메일{seen.setdefault((i % 500, i % 7), len(seen) + 1)}]😀" for i in range(n))
    start = time.time()
    masked = scan.display(scan.detect(df, detectors={"email": rules.email})).first().anonymized
    assert time.time() - start < 20 and masked == " ".join("*" * len(f"u{i % 500}@m{i % 7}.co") + "😀" for i in range(n))


def merge(spans):
    """The overlap rule, one span after the other."""
    out = []
    for k, s, e, t, c, d in sorted(spans, key=lambda x: (x[1], x[1] - x[2], -x[4])):
        if out and s < out[-1][2]:
            last = out[-1]
            surer = c > last[4]
            out[-1] = [k if surer else last[0], last[1], max(e, last[2]), None, max(c, last[4]), d if surer and e > last[2] else last[5]]
        else:
            out.append([k, s, e, t, c, d])
    return [tuple(x[:3] + x[4:]) for x in out]


def test_rules_of_overlap_over_random_spans(spark):
    import random

    rng = random.Random(5)
    rows = []
    for i in range(60):
        size = rng.choice([0, 1, 5, 40, 250])
        spans = []
        for j in range(size):
            start = rng.randrange(3000)
            end = start + rng.randint(1, rng.choice([3, 30]))
            spans.append((f"k{rng.randrange(3)}", start, end, "x" * (end - start), rng.randrange(1, 5) / 4, f"D{j}"))
        rows.append((i, "x" * 4000, spans))
    df = spark.createDataFrame(rows, f"i int, text string, raw {SPANS}")
    got = {r.i: r for r in df.select("i", res.resolve(F.col("text"), F.col("raw")).alias("merged"), res.first_only(F.col("raw")).alias("shown")).collect()}
    for i, _, spans in rows:
        assert [(s.kind, s.start, s.end, s.confidence, s.detector) for s in got[i].merged] == merge(spans)
        assert all(len(s.text) == s.end - s.start for s in got[i].merged)
        end, shown = -1, []
        for s in sorted(enumerate(spans), key=lambda x: (x[1][1], -x[1][2], x[0])):
            if s[1][1] >= end:
                end = s[1][2]
                shown.append(s[1])
        assert [tuple(s) for s in got[i].shown] == shown


def test_windows_hold_every_number(spark):
    gap = "a" * 60
    texts = ["주민번호 900101-1234568" + gap + "여권 M12345678 끝", gap + "고객 010-1234-5678", f"{gap}생년월일은   1999-01-02", "1" + gap + "2" + gap + "345678 9", f"x{'가' * 31}4242 4242 4242 4242{'나' * 31}02-123-4567", None, "", gap]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    rows = df.select("n", "text", near_digits(F.col("text")).alias("w")).orderBy("n").collect()
    assert [len(r.w) for r in rows] == [2, 1, 1, 1, 2, 0, 0, 0]
    assert all(r.text[w.start : w.start + len(w.text)] == w.text for r in rows for w in r.w)
    found = {r.n: [(s.kind, r.text[s.start : s.end]) for s in r.spans] for r in scan.scan(df).collect()}
    assert found[0] == [("rrn", "900101-1234568"), ("passport", "M12345678")] and found[1] == [("phone", "010-1234-5678")] and found[2] == [("birth_date", "1999-01-02")]
    assert found[4] == [("card", "4242 4242 4242 4242"), ("phone", "02-123-4567")]
