"""Findings of round 3: work dealt over all cores, short texts in one window."""

import re

from pyspark.sql import functions as F

from mossveil.functions import detectors as rules
from mossveil.functions.spans import SHORT, find, near_digits
from mossveil.operators import evaluate as ev
from mossveil.operators import scan
from mossveil.plans import registry


def test_a_file_of_keys_is_dealt_over_all_cores(spark, small):
    cores = spark.sparkContext.defaultParallelism
    keys = scan.spread(registry.table(spark, small, "customer").select("c_custkey"))
    assert keys.rdd.getNumPartitions() == cores
    assert registry.label_numbered(spark, small).rdd.getNumPartitions() == cores
    assert sorted(keys.collect()) == sorted(registry.table(spark, small, "customer").select("c_custkey").collect())


def test_short_texts_give_what_long_ones_do(spark):
    texts = ["주민번호는 800101-1234567 입니다", "여권 M12345678 확인", "면허 11-22-333333-44 확인", "사무실 02-123-4567 그리고 010 1234 5678", "카드 4242-4242-4242-4242 승인"]
    texts += ["급여는 국민은행 123-456789-01-011로 지급", "생년월일은 1999.2.28이다", "고객 남궁민수님 방문", "고객: 김철 팀장", "이유님", "경기도 성남시 분당구 판교로 45-6", "값  02-123-4567 ", "", "12", "😀 ８００１０１-1２３４５６０"]
    filler = "x " * SHORT
    df = spark.createDataFrame([(i, n, t) for n, t in enumerate(texts) for i, t in ((0, t), (1, filler + t + filler))], "long int, n int, text string")
    got = {(r.long, r.n): [(s.kind, s.start - r.long * len(filler), s.end - r.long * len(filler), s.confidence) for s in r.spans] for r in scan.scan(df).collect()}
    assert all(got[0, n] == got[1, n] for n in range(len(texts)))
    assert sum(len(got[0, n]) for n in range(len(texts))) == 13


def test_no_match_gives_an_empty_array(spark):
    df = spark.createDataFrame([("abc",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(F.size(find(F.col("text"), "z"))).collect()] == [0, 0, 0]
    assert re.search(rules.CUE, "고객") and not re.search(rules.CUE, "abc")


def test_short_texts_know_their_digits(spark):
    df = spark.createDataFrame([("사무실 02-123-4567 로 문의",), ("８００101",)], "text string")
    assert [[w.digits for w in r[0]] for r in df.select(near_digits(F.col("text"))).collect()] == [[9], [6]]


def test_one_match_and_several_have_their_groups(spark):
    df = spark.createDataFrame([("😀 a1",), ("a1 b22 ",), ("none",)], "text string")
    rows = df.select(find(F.col("text"), r"(?<w>[a-z])(?<n>\d+)", ("w", "n")).alias("m"), find(F.col("text"), r"\d+").alias("d")).collect()
    assert [[(m.start, m.end, m.match, m.groups) for m in r.m] for r in rows] == [[(2, 4, "a1", ["a", "1"])], [(0, 2, "a1", ["a", "1"]), (3, 6, "b22", ["b", "22"])], []]
    assert [[(m.start, m.end, m.match, m.groups) for m in r.d] for r in rows] == [[(3, 4, "1", [])], [(1, 2, "1", []), (4, 6, "22", [])], []]


def test_the_whole_is_summed_from_kinds(spark):
    leaked = spark.createDataFrame([("a", 0.5), ("a", 0.0), ("b", 1.0), (None, 0.25)], "kind string, exposed double")
    done = ev.leak_rollup(leaked)
    got = {r.kind: (r.spans, r.leaks, r.full_leaks, r.partial_leaks, r.mean_exposed, r.leak_rate) for r in done.collect()}
    assert got["__overall__"] == (4, 3, 1, 2, 1.75 / 3, 0.75) and got["a"] == (2, 1, 0, 1, 0.5, 0.5) and got[None] == (1, 1, 0, 1, 0.25, 1.0)
    spans = spark.createDataFrame([(1, "a", 0, 1)], "doc_id long, kind string, start int, end int")
    for plan in (done, ev.evaluate(spans, spans)):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [kind" in text[text.index("Expand"):]


def test_islands_are_dealt_by_the_size_of_the_input(spark, small):
    spans = registry.made_spans(spark, small)
    merged = scan.merge_islands(spans.repartition(3), "doc_id")
    assert merged.rdd.getNumPartitions() == 3 * scan.PARTS
    columns = ["doc_id", "start", "end", "kind", "confidence", "detector"]
    assert sorted(merged.select(columns).collect()) == sorted(registry.overlap_merge(spark, small).select(columns).collect())
