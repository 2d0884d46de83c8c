"""The engine's operators: edge cases by hand, and every registered query against its SQL."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from mossveil.functions import detectors as rules
from mossveil.functions import resolve as res
from mossveil.functions.spans import SPANS
from mossveil.operators import custom, limits, scan
from mossveil.operators import evaluate as ev
from mossveil.plans import registry
from mossveil.sources import files
from mossveil.streaming import jobs

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def found(spark, kind, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    rows = scan.detect(df, detectors={kind: rules.DEFAULT[kind]}, out="spans").orderBy("n").collect()
    return [[(s.start, s.end, s.confidence) for s in r.spans] for r in rows]


def test_places_are_code_points_and_digits_are_unicode(spark):
    text = "😀 " + "８００１０１-1２３４５６０"
    assert found(spark, "rrn", text, "800101-1234567", "990230-1234567", None, "") == [[(2, 16, 1.0)], [(0, 14, 0.85)], [], [], []]
    assert found(spark, "email", "x a@b.co y", "a@b", "@") == [[(2, 8, 1.0)], [], []]


def test_context_and_boundaries(spark):
    assert found(spark, "passport", "여권번호 M12345678", "M12345678", "XM12345678", "여권 M1234567") == [[(5, 14, 0.9)], [(0, 9, 0.6)], [], []]
    assert found(spark, "account", "국민은행 123-456789-01-011", "코드 123-456789-01-011") == [[(5, 22, 0.6)], []]
    assert found(spark, "card", "4242-4242-4242-4242", "4242-4242 4242-4242", "4242424242424243") == [[(0, 19, 0.95)], [], []]
    assert found(spark, "birth_date", "생일: 1999.2.28", "생일: 1999.2.30", "1999.2.28") == [[(4, 13, 0.9)], [], []]


def test_names_and_addresses(spark):
    assert found(spark, "name", "고객 박하늘님 방문", "대표 구매가 참석", "구매 부장", "이유님") == [[(3, 6, 0.75)], [], [], []]
    assert found(spark, "address", "경기도 성남시 분당구 판교로 45-6", "경기도청", "성남시 분당구 정자동") == [[(0, 20, 1.0)], [], [(0, 11, 0.7)]]


def spans(*items):
    return [("k" + str(i) if len(x) < 4 else x[3], x[0], x[1], "x" * (x[1] - x[0]), float(x[2]), f"D{i}") for i, x in enumerate(items)]


@pytest.mark.parametrize(
    "given, want",
    [
        ([(0, 13, 0.8), (10, 24, 1.0)], [("k1", 0, 24, 1.0, "D1")]),
        ([(10, 24, 1.0), (0, 13, 0.8)], [("k0", 0, 24, 1.0, "D0")]),
        ([(0, 24, 0.9), (10, 24, 1.0)], [("k1", 0, 24, 1.0, "D0")]),
        ([(0, 5, 0.5), (5, 9, 0.5)], [("k0", 0, 5, 0.5, "D0"), ("k1", 5, 9, 0.5, "D1")]),
        ([(0, 5, 0.5), (0, 5, 0.5)], [("k0", 0, 5, 0.5, "D0")]),
        ([], []),
    ],
)
def test_overlaps(spark, given, want):
    df = spark.createDataFrame([("x" * 30, spans(*given))], f"text string, raw {SPANS}")
    got = df.select(res.resolve(F.col("text"), F.col("raw")).alias("s")).first().s
    assert [(s.kind, s.start, s.end, s.confidence, s.detector) for s in got] == want
    assert all(len(s.text) == s.end - s.start for s in got)


def test_rewrites(spark):
    df = spark.createDataFrame([("A a@b.co B c@d.co A a@b.co",), (None,)], "text string")
    done = scan.scan(df, detectors={"email": rules.email})
    out = lambda **o: [r.anonymized for r in scan.anonymize(done, **o).collect()]
    assert out(strategy="mask", keep_head=2) == ["A a@**** B c@**** A a@****", None]
    assert out(strategy="label", numbered=True) == ["A [이메일1] B [이메일2] A [이메일1]", None]
    fake = out(strategy="pseudonym", salt="s")[0].split(" ")
    assert fake[1] == fake[5] != fake[3] and "a@b.co" not in fake and fake[1].endswith("@example.com")
    assert out(strategy="pseudonym", salt="s")[0] == " ".join(fake) != out(strategy="pseudonym")[0]
    with pytest.raises(ValueError):
        scan.anonymize(done, strategy="other")
    none = scan.scan(df, detectors={})
    assert scan.anonymize(none).first().anonymized == df.first().text


def test_display_rule_skips_what_begins_inside(spark):
    df = spark.createDataFrame([(spans((0, 5, 1), (3, 9, 1), (5, 6, 1)),)], f"raw {SPANS}")
    assert [(s.start, s.end) for s in df.select(res.first_only(F.col("raw")).alias("s")).first().s] == [(0, 5), (5, 6)]


HOSTILE = {
    "rrn": "1" * 400_000, "passport": "M123" * 100_000, "driver_license": "12-34-" * 66_000, "phone": "010-" * 100_000, "email": "a@" * 200_000,
    "address": "성남시 분당구 정자동 " * 33_000, "card": "4242 " * 80_000, "account": "계좌" + "12-" * 133_000, "biz_reg": "123-45-" * 57_000, "name": "고객 김" * 100_000, "birth_date": "생일" + " " * 400_000,
}
#: Texts in which very many values are found.
HOSTILE |= {"account+": "계좌 123-456789-01-011 " * 18_000, "passport+": "여권M12345678 " * 28_000, "phone+": "010-1234-5678 " * 28_000, "birth_date+": "생일 1999-01-02 " * 28_000}


@pytest.mark.parametrize("kind", sorted(HOSTILE))
def test_each_detector_takes_a_hostile_text_in_time(spark, kind):
    df = spark.createDataFrame([("warm up 010-1234-5678",)], "text string")
    one = {kind: rules.DEFAULT[kind.rstrip("+")]}
    scan.detect(df, detectors=one).select(F.sum(F.size("raw_spans"))).collect()
    df = spark.createDataFrame([(HOSTILE[kind],)], "text string")
    start = time.time()
    scan.detect(df, detectors=one).select(F.sum(F.size("raw_spans"))).collect()
    assert time.time() - start < 5


def test_files(spark, tmp_path):
    for name, raw in {"a.txt": "연락처".encode(), "b.txt": "연락처".encode("cp949"), "c_masked.txt": b"x", "d.exe": b"x", "e.txt": b"", "f.txt": b"a\0b", "g.txt": b"\xef\xbb\xbfx", "h.txt": b"123456", "i.txt": b"P\nabc\0def", "j.txt": b"P\nabc\x0f"}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path.split("/")[-1]: (r.status, r.text) for r in files.read_texts(spark, str(tmp_path), max_bytes=20).collect()}
    assert got.pop("e.txt", ("empty", None)) == ("empty", None)  # Spark's reader may pass over empty files
    assert got == {"a.txt": ("ok", "연락처"), "b.txt": ("ok", "연락처"), "c_masked.txt": ("masked copy", None), "d.exe": ("unsupported", None), "f.txt": ("binary", None), "g.txt": ("ok", "x"), "h.txt": ("ok", "123456"), "i.txt": ("binary", None), "j.txt": ("ok", "P\nabc\x0f")}
    paths = spark.createDataFrame([("/a.b/c.txt",), ("/a.b/c",)], "p string").select(files.masked_path(F.col("p")).alias("m")).collect()
    assert [r.m for r in paths] == ["/a.b/c_masked.txt", "/a.b/c_masked"]
    (tmp_path / "link.txt").symlink_to(tmp_path / "a.txt")
    for bad in (tmp_path / "link.txt", tmp_path / "none.txt", tmp_path.parent):
        with pytest.raises(ValueError):
            files.guard_path(str(bad), str(tmp_path))
    assert files.guard_path(str(tmp_path / "a.txt"), str(tmp_path)).endswith("a.txt")


def test_rate_limit(spark):
    rows = [("a", t) for t in (0.0, 1.0, 2.0, 9.0, 10.5, 11.5)] + [(None, 3.0), ("b", None)]
    got = {(r.client, r.at): (r.allowed, r.retry_after) for r in limits.rate_limit(spark.createDataFrame(rows, "client string, at double"), 2, 10.0).collect()}
    assert got == {("a", 0.0): (True, 0), ("a", 1.0): (True, 0), ("a", 2.0): (False, 8), ("a", 9.0): (False, 1), ("a", 10.5): (True, 0), ("a", 11.5): (True, 0), (None, 3.0): (True, 0), ("b", None): (False, 0)}


def test_stream_masks_as_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a@b.co x"), (2, "010-1234-5678")], "doc_id long, text string")
    docs.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).json(str(tmp_path / "in"))
    query = jobs.mask_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = scan.anonymize(scan.scan(docs)).select("doc_id", "anonymized")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.columns == ["doc_id", "anonymized"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_custom_detectors_and_clients(spark):
    df = spark.createDataFrame([(1, "어제 강하늘이 왔다 강하늘"), (2, "12345"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end, s.detector) for s in r.name_spans] for r in custom.detect_names_with(df, lambda t: ["강하늘님", "없음", 3, ""]).collect()}
    assert got == {1: [(3, 6, "LLMNameDetector"), (11, 14, "LLMNameDetector")], 2: [], 3: []}
    digits = custom.detect_with(df, "num", "Mine", lambda t: [(0, len(t), 0.5)] if t.isdigit() else []).collect()
    assert [(s.kind, s.text) for r in digits for s in r.custom_spans] == [("num", "12345")]
    assert custom.require_local("http://localhost:11434") and custom.require_local("http://[::1]:1")
    for bad in ("http://example.com", "ftp://localhost", "http://localhost.example.com"):
        with pytest.raises(ValueError):
            custom.require_local(bad)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted(repr(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, small, name):
    got = registry.QUERIES[name](spark, small)
    want = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(map(tuple, got.collect()), got.columns, sorted(columns)) == plain(want.fetchall(), columns, sorted(columns))


def test_all_spans_equal_brute_force(spark, tmp_path):
    import re

    texts = ["4111-1111-1111-1111 and 4242 4242 4242 4242, 4242424242424242 or 4242.4242.4242.4242", "a@b.co then c@d.org, a@b.co", "4111-1111-1111-1112, 378282246310005 3782 822463 10005", "고객 박하늘님 M12345678 900101-1234567", "none", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    luhn = lambda s: sum(d if i % 2 == 0 else d * 2 // 10 + d * 2 % 10 for i, d in enumerate(int(c) for c in reversed(s) if c.isdigit())) % 10 == 0
    number = r"(?<!\d)(?:\d{4}([ .-]{1,3})\d{4}\1\d{4}\1\d{1,4}|\d{4}([ .-]{1,3})\d{6}\2\d{5}|\d{13,19})(?!\d)"
    places = lambda pattern: [(d, *m.span(), m[0]) for d, t in enumerate(texts) for m in re.finditer(pattern, t or "")]
    cards = [x for x in places(number) if luhn(x[3])]
    emails = [x[:3] for x in places(r"[a-z]+@[a-z]+\.[a-z]+")]
    run = lambda name: sorted(tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect())
    assert run("card_spans") == sorted(cards) and len(cards) == 6
    assert run("email_offsets") == sorted(emails) and len(emails) == 3
    counts = {k: n for k, n, _ in run("kind_counts")}
    assert counts["card"] == 6 and counts["email"] == 3 and counts["name"] == counts["passport"] == counts["rrn"] == 1


def test_strict_source_and_masked_copies(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("가 a@b.co".encode())
    (tmp_path / "b.txt").write_bytes(b"x a@b.co y")
    docs = files.read_strict(spark, str(tmp_path / "*.txt"))
    done = scan.anonymize(scan.scan(docs)).select("path", "anonymized")
    first = {r.path.split("/")[-1]: r.status for r in files.write_masked_copies(done).collect()}
    assert first == {"a.txt": "written", "b.txt": "written"} and (tmp_path / "a_masked.txt").read_text() == "가 ******"
    (tmp_path / "b_masked.txt").unlink()
    (tmp_path / "b_masked.txt").symlink_to(tmp_path / "b.txt")
    done = scan.anonymize(scan.scan(files.read_strict(spark, str(tmp_path / "[ab].txt")))).select("path", "anonymized")
    assert {r.status for r in files.write_masked_copies(done).collect()} == {"exists"}
    assert (tmp_path / "b.txt").read_bytes() == b"x a@b.co y"
    again = {r.path.split("/")[-1]: r.status for r in files.write_masked_copies(done, overwrite=True).collect()}
    assert again["a.txt"] == "written" and again["b.txt"].startswith("failed")
    (tmp_path / "c.txt").write_bytes("연락처".encode("cp949"))
    for path, limit in ((tmp_path / "c.txt", 100), (tmp_path / "a.txt", 3)):
        with pytest.raises(Exception):
            files.read_strict(spark, str(path), max_bytes=limit).collect()
    spark.createDataFrame([("한 글",)], "text string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "p"))
    files.write_jsonl(spark.read.parquet(str(tmp_path / "p")), str(tmp_path / "new" / "out"))
    assert "한 글" in next((tmp_path / "new" / "out").glob("part-*")).read_text()
    with pytest.raises(Exception):
        files.write_jsonl(docs, str(tmp_path / "new" / "out"))


def test_reports_counts_and_order(spark):
    gold = spark.createDataFrame([(1, "email", 0, 5), (2, "card", 0, 9)], "doc_id long, kind string, start int, end int")
    found = spark.createDataFrame([(1, "email", 0, 5), (2, "card", 0, 8)], "doc_id long, kind string, start int, end int")
    report = ev.markdown_report(ev.evaluate(gold, found))
    assert [x.split(" | ")[0] for x in report.splitlines()[4:]] == ["| card", "| email", "| __overall__"]
    assert "| email | 1.000 | 1.000 | 1.000 | 1 | 0 | 0 |" in report
    tasks = spark.createDataFrame([("done",), ("failed",), ("running",), ("waiting",)], "status string")
    assert tuple(ev.task_counts(tasks).first()) == (2, True) and tuple(ev.task_counts(tasks.limit(0)).first()) == (0, False)
    assert spark.range(1).select(ev.distinct_in_order(F.expr("array('b', 'a', 'b', 'c', 'a')"))).first()[0] == ["b", "a", "c"]
    counts = spark.createDataFrame([("zzz", 1, 0.5), ("card", 2, 0.9), ("rrn", 3, 1.0), ("aaa", 1, 0.5)], "kind string, n int, min_confidence double")
    assert [r.kind for r in scan.in_order(counts).orderBy("place").collect()] == ["rrn", "card", "aaa", "zzz"]
    assert tuple(ev.leak_totals(gold.limit(0).selectExpr("doc_id", "'' as text", "'' as anonymized", "array(struct(kind, start, end)) as labels")).first()) == (0, 0, 0, 0.0)
