"""Findings F13 to F20 of round 3: tests of a detector are compiled, sentences are made and scanned once."""

import re

from pyspark.sql import functions as F

from mossveil.functions import detectors as rules
from mossveil.functions import resolve as res
from mossveil.functions.spans import BLOCK, SPANS, ascii_digits
from mossveil.operators import scan
from mossveil.plans import registry


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_detectors_are_projected_once_and_not_by_a_generator(spark):
    docs = spark.createDataFrame([(1, "사무실 02-123-4567")], "doc_id long, text string")
    lines = plan_of(scan.scan(docs).where("size(spans) > 0")).split("\n")
    assert not [x for x in lines if "Generate" in x and ("RLIKE" in x or "transform" in x)]
    assert len([x for x in lines if "RLIKE" in x and r"[1-8]\d{6}" in x]) == 1


def test_counts_of_several_kinds_come_from_one_pass(spark, small):
    spans = spark.createDataFrame([("a", 0.5), ("a", 0.25), ("b", 1.0)], "kind string, confidence double")
    assert [tuple(r) for r in scan.counts_of(spans, "a", "none", "b").collect()] == [("a", 2, 0.25), ("none", 0, 0.0), ("b", 1, 1.0)]
    assert [tuple(r) for r in scan.counts_of(spans.where("false"), "a").collect()] == [("a", 0, 0.0)]
    assert plan_of(registry.counts_of_kind(spark, small)).count("[explode(array(_held") + plan_of(registry.counts_of_kind(spark, small)).count("Generate explode(array(_held") == 3


def test_evaluation_makes_its_sentences_once(spark, small):
    for query in (registry.prf_by_kind, registry.prf_by_difficulty, registry.threshold_sweep):
        assert "Join" not in plan_of(query(spark, small))


def test_single_spans_are_rewritten_as_several_are(spark):
    rows = [("😀 abc def", 2, 5), ("abc", 0, 3), ("x" * BLOCK + "abc", BLOCK, BLOCK + 3), ("ab" + "y" * BLOCK, 0, 2)]
    df = spark.createDataFrame(rows, "t string, a int, b int").withColumn("s", F.array(F.struct(F.lit("name").alias("kind"), F.col("a").alias("start"), F.col("b").alias("end"), F.expr("substring(t, a + 1, b - a)").alias("text"), F.lit(1.0).alias("confidence"), F.lit("D").alias("detector"))).cast(SPANS))
    value = lambda s: F.concat(F.lit("<"), s["text"], F.lit(">"))
    got = df.select("t", "a", "b", res.rewrite(F.col("t"), F.col("s"), value), res.rewrite(F.col("t"), F.col("s"), value, short=False)).collect()
    assert all(x == y == f"{t[:a]}<{t[a:b]}>{t[b:]}" for t, a, b, x, y in got)


def test_pseudonyms_draw_each_part_once(spark):
    docs = spark.createDataFrame([(1, "고객 김철수님")], "doc_id long, text string")
    found = docs.withColumn("spans", F.array().cast(SPANS))
    made = scan.anonymize(found, strategy="pseudonym", row_key="doc_id", salt="s")
    assert plan_of(made).count("xxhash64") < 30


def test_classes_of_many_signs_are_halved(spark):
    plain = "".join(dict.fromkeys(s[0] for s in rules.SURNAMES))
    assert rules.SURNAME_HEADS == rules.one_of(plain) and not re.search("[가-힣]{5}", rules.one_of(plain)) and rules.one_of("나가") == "[가나]"
    signs = spark.range(0xAC00, 0xD7A4).select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("s"))
    assert signs.where(F.col("s").rlike(rules.SURNAME_HEADS)).count() == len(plain) == signs.where(F.col("s").rlike(f"[{plain}]") & F.col("s").rlike(rules.SURNAME_HEADS)).count()


def test_accounts_need_a_cue(spark):
    rows = spark.createDataFrame([("계좌 110-234-567890",), ("번호 110-234-567890",), ("은행 ١١٠-234-567890",)], "t string")
    got = rows.select(F.size(rules.account(F.col("t"))), ascii_digits(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(1, "110234567890"), (0, "110234567890"), (1, "110234567890")]
