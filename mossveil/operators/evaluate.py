"""Measuring findings against gold spans."""

from __future__ import annotations

import os
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mossveil.functions.detectors import Detector
from mossveil.functions.spans import let
from mossveil.operators import scan

#: The thresholds of a sweep.
THRESHOLDS = (0.0, 0.5, 0.7, 0.8, 0.85, 0.9, 0.95, 1.0)


def ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def scores(counted: DataFrame) -> DataFrame:
    """Precision, recall and F1 of ``tp, fp, fn``; 0.0 where a denominator is 0."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counted.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def matched(gold: DataFrame, found: DataFrame, *extra: str) -> DataFrame:
    """Distinct spans of either side, with ``g`` and ``p`` where gold and found: one full outer join."""
    on = ["doc_id", "kind", "start", "end", *extra]
    return gold.select(*on).distinct().withColumn("g", F.lit(True)).join(found.select(*on).distinct().withColumn("p", F.lit(True)), on, "full_outer")



def counts() -> list:
    return [F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn")]


def evaluate(gold: DataFrame, found: DataFrame) -> DataFrame:
    """By kind, and ``__overall__``, for exact matches of (document, kind, start, end)."""
    return by_kind(matched(gold, found))


def by_kind(met: DataFrame) -> DataFrame:
    """The scores of ``evaluate`` for spans of either side that have met (``matched`` or ``judged``)."""
    by_kind = met.groupBy("kind").agg(*counts())  # the whole is summed from a dozen rows
    rolled = by_kind.rollup("kind").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.grouping("kind").alias("_all"))
    return scores(rolled.select(F.when(F.col("_all") == 1, "__overall__").otherwise(F.col("kind")).alias("kind"), "tp", "fp", "fn"))


def evaluate_by_difficulty(gold: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """As ``evaluate``, by the difficulty of documents (missing: ``unknown``)."""
    level = docs.select("doc_id", F.coalesce("difficulty", F.lit("unknown")).alias("difficulty"))
    return by_difficulty(matched(gold, found).join(level, "doc_id"))


def by_difficulty(met: DataFrame) -> DataFrame:
    return scores(met.groupBy("difficulty").agg(*counts()))


def threshold_sweep(gold: DataFrame, found: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Overall counts at each least confidence, from one scan and one join: see ``swept``."""
    on = ["doc_id", "kind", "start", "end"]
    surest = found.groupBy(*on).agg(F.max("confidence").alias("confidence")).withColumn("p", F.lit(True))
    return by_threshold(gold.select(*on).distinct().withColumn("g", F.lit(True)).join(surest, on, "full_outer"), thresholds)


def by_threshold(met: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    levels = sorted(float(t) for t in thresholds)
    bins = met.groupBy(bin_of(levels).alias("bin")).agg(*counts(), F.count_if("g").alias("golds"))
    bins = bins.withColumn("section", F.lit("bin")).withColumn("name", F.lit(None).cast("string"))
    return scores(swept(bins, levels).select(F.col("name").cast("double").alias("threshold"), "tp", "fp", "fn"))


def bin_of(levels: list[float]) -> Column:
    """How many thresholds a found span reaches; 0 where nothing was found."""
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in levels]), lambda t: F.col("confidence") >= t))
    return F.when(F.col("p"), reached).otherwise(0)


def swept(tallied: DataFrame, levels: list[float]) -> DataFrame:
    """``section, name, tp, fp, fn`` from counts by ``section, name, bin`` with ``tp, fp, golds``.

    Each row of section ``bin``, of which there are a dozen, counts at every threshold that it reaches, and its gold
    spans at all of them, found or not; other rows stay as they are. No join, no second look at the rows below.
    """
    kind = "array<struct<section:string,name:string,tp:bigint,fp:bigint,golds:bigint>>"
    there = lambda c, i: F.when(F.col("bin") > i, F.col(c)).otherwise(0)
    at = F.array(*[F.struct(F.lit("threshold").alias("section"), F.lit(str(t)).alias("name"), there("tp", i).alias("tp"), there("fp", i).alias("fp"), F.col("golds")) for i, t in enumerate(levels)]).cast(kind)
    row = F.array(F.struct("section", "name", "tp", "fp", "golds")).cast(kind)
    each = tallied.select(F.explode(F.when(F.col("section") == "bin", at).otherwise(row)).alias("t"))
    summed = each.groupBy("t.section", "t.name").agg(*[F.sum(f"t.{c}").alias(c) for c in ("tp", "fp", "golds")])
    return summed.select("section", "name", "tp", "fp", (F.col("golds") - F.col("tp")).alias("fn"))


def leaks(docs: DataFrame, gold: str = "labels", text: str = "text", rewritten: str = "anonymized", strategy: str = "mask", keep_head: int = 0) -> DataFrame:
    """One row per gold span with ``exposed``: the share of its characters that the rewritten text still shows.

    Where lengths are equal and the strategy is mask, places are compared beyond the kept head; else a span counts
    as wholly exposed if its value occurs anywhere.
    """
    g = docs.select("doc_id", F.col(text).alias("_a"), F.col(rewritten).alias("_b"), F.explode(gold).alias("g")).select("doc_id", "_a", "_b", "g.kind", "g.start", "g.end")
    exposed = exposure(F.col("_a"), F.col("_b"), F.col("start"), F.col("end"), strategy, keep_head)
    return g.select("doc_id", "kind", "start", "end", exposed.cast("double").alias("exposed"), (F.length("_a") == F.length("_b")).alias("same_length"))


def exposure(text: Column, rewritten: Column, start: Column, end: Column, strategy: str = "mask", keep_head: int = 0) -> Column:
    """The share of a span's characters that a rewritten text still shows."""
    size = end - start
    head = F.least(F.lit(keep_head), size)
    # Only the span's own characters are taken apart, so that a place far into a text costs one look at it.
    tail = lambda c: F.split(F.substring(c, start + head + 1, size - head), "")
    places = F.when(size > head, F.arrays_zip(tail(text).alias("a"), tail(rewritten).alias("b"))).otherwise(F.array().cast("array<struct<a:string,b:string>>"))
    shown = let(places, lambda ps: ratio(F.size(F.filter(ps, lambda x: x["a"] == x["b"])), F.size(ps)))
    placed = F.lit(strategy == "mask") & (F.length(text) == F.length(rewritten))
    return F.when(size < 1, 0.0).when(placed, shown).otherwise(F.when(F.contains(rewritten, F.substring(text, start + 1, size)), 1.0).otherwise(0.0))


def leak_rollup(leaked: DataFrame) -> DataFrame:
    """Spans, leaks (full and partial), their rate and mean exposure by kind and overall."""
    leak = F.col("exposed") > 0
    by_kind = leaked.groupBy("kind").agg(F.count("*").alias("spans"), F.count_if(leak).alias("leaks"), F.count_if(F.col("exposed") >= 1).alias("full_leaks"), F.count_if(leak & (F.col("exposed") < 1)).alias("partial_leaks"), F.sum(F.when(leak, F.col("exposed"))).alias("_total"))
    rolled = by_kind.rollup("kind").agg(*[F.sum(c).alias(c) for c in ("spans", "leaks", "full_leaks", "partial_leaks", "_total")], F.grouping("kind").alias("_all"))
    mean = ratio(F.col("_total"), F.col("leaks"))
    return rolled.select(F.when(F.col("_all") == 1, "__overall__").otherwise(F.col("kind")).alias("kind"), "spans", "leaks", "full_leaks", "partial_leaks", mean.alias("mean_exposed"), ratio(F.col("leaks"), F.col("spans")).alias("leak_rate"))


def leak_totals(docs: DataFrame, text: str = "text", rewritten: str = "anonymized", gold: str = "labels", **options) -> DataFrame:
    """One row: documents, gold spans, leaks, and the share of documents whose length is kept (0.0 without any)."""
    same = (F.length(text) == F.length(rewritten)).cast("int")
    # One pass: a document's first row, that without a span too, stands for the document.
    rows = docs.select(F.col(text).alias("_a"), F.col(rewritten).alias("_b"), same.alias("_same"), F.posexplode_outer(gold).alias("_at", "g"))
    first = F.coalesce(F.col("_at"), F.lit(0)) == 0
    exposed = exposure(F.col("_a"), F.col("_b"), F.col("g.start"), F.col("g.end"), **options)
    out = rows.select(first.alias("_first"), "_same", F.col("g").isNotNull().alias("_span"), exposed.alias("_exposed"))
    return out.agg(F.count_if("_first").alias("docs"), F.count_if("_span").alias("spans"), F.count_if(F.col("_span") & (F.col("_exposed") > 0)).alias("leaks"), F.coalesce(F.avg(F.when(F.col("_first"), F.col("_same"))), F.lit(0.0)).alias("length_preserved_rate"))


def compare(gold: DataFrame, docs: DataFrame, detectors: Mapping[str, Detector], kind: str, key: str = "doc_id") -> DataFrame:
    """Scores of several detectors of one kind over the same documents, one row each; a detector that is not
    available is simply not given."""
    each = []
    for name, detector in detectors.items():
        found = scan.explode_spans(scan.scan(docs, detectors={kind: detector}), key)
        each.append(scores(matched(gold, found).agg(*counts()).select(F.lit(name).alias("detector"), "tp", "fp", "fn")))
    return reduce(DataFrame.unionByName, each)


def in_report_order(scored: DataFrame, key: str = "kind") -> DataFrame:
    """By name, the overall row last."""
    return scored.orderBy(F.col(key) == "__overall__", key)


def judged(docs: DataFrame, key: str = "doc_id", labels: str = "labels", spans: str = "spans", difficulty: str | None = "difficulty") -> DataFrame:
    """Distinct gold and found spans of documents that have both, with ``g``, ``p``, ``confidence`` and ``difficulty``.

    Gold and findings stand in one row, so they are taken apart together, and met by one grouping of slim rows rather
    than by a join of two scans. A missing difficulty is ``unknown``.
    """
    side = "array<struct<kind:string,start:int,end:int,found:boolean,confidence:double>>"
    gold = F.transform(labels, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(False).alias("found"), F.lit(None).cast("double").alias("confidence"))).cast(side)
    found = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(True).alias("found"), s["confidence"].alias("confidence"))).cast(side)
    none = F.array().cast(side)
    level = F.coalesce(F.col(difficulty), F.lit("unknown")) if difficulty else F.lit("unknown")
    rows = docs.select(F.col(key).alias("doc_id"), level.alias("difficulty"), F.explode(F.concat(F.coalesce(gold, none), F.coalesce(found, none))).alias("s"))
    met = rows.groupBy("doc_id", "difficulty", "s.kind", "s.start", "s.end").agg(F.bool_or(~F.col("s.found")).alias("_g"), F.bool_or("s.found").alias("_p"), F.max("s.confidence").alias("confidence"))
    return met.withColumn("g", F.when(F.col("_g"), True)).withColumn("p", F.when(F.col("_p"), True)).drop("_g", "_p")


def report(docs: DataFrame, thresholds=THRESHOLDS, **columns) -> DataFrame:
    """``section, name`` and the scores by kind, by difficulty, overall, and at each least confidence, from one scan.

    Kinds, difficulties and the whole come of grouping sets, and so do the counts by the highest threshold reached,
    of which the sweep is made.
    """
    levels = sorted(float(t) for t in thresholds)
    met = judged(docs, **columns).withColumn("bin", bin_of(levels))
    sets = [[F.col("kind")], [F.col("difficulty")], [F.col("bin")], []]
    tallied = met.groupingSets(sets, "kind", "difficulty", "bin").agg(*counts(), F.count_if("g").alias("golds"), F.grouping_id().alias("_set"))
    tallied = tallied.select(F.element_at(F.create_map(*[x for k, v in ((3, "kind"), (5, "difficulty"), (6, "bin"), (7, "overall")) for x in (F.lit(k), F.lit(v))]), F.col("_set").cast("int")).alias("section"), F.coalesce("kind", "difficulty", F.lit("__overall__")).alias("name"), "bin", "tp", "fp", "golds")
    return scores(swept(tallied, levels))


def markdown_table(rows: list, key: str) -> list[str]:
    lines = [f"| {key} | precision | recall | f1 | tp | fp | fn |", "|---|---|---|---|---|---|---|"]
    return lines + [f"| {name} | {r.precision:.3f} | {r.recall:.3f} | {r.f1:.3f} | {r.tp} | {r.fp} | {r.fn} |" for name, r in rows]


def markdown_report(scored: DataFrame, key: str = "kind", title: str = "Evaluation") -> str:
    """The table of some dozen groups as text; an aggregate of fixed size is all that reaches the driver."""
    return "\n".join([f"# {title}", "", *markdown_table([(r[key], r) for r in in_report_order(scored, key).collect()], key)]) + "\n"


def full_report(reported: DataFrame, docs: int, dataset: str, path: str | None = None) -> str:
    """The text of a ``report`` with a section each for kinds, difficulties and thresholds; also written to ``path``."""
    rows = reported.collect()  # kinds, difficulties and thresholds: some dozen
    overall = [("**overall**", r) for r in rows if r.section == "overall"]
    lines = ["# Evaluation", "", f"- data: `{dataset}` ({docs} documents)", "- a span counts if its kind, start and end are right", ""]
    for section, title in (("kind", "By kind"), ("difficulty", "By difficulty"), ("threshold", "By least confidence")):
        part = sorted(((r.name, r) for r in rows if r.section == section), key=lambda x: float(x[0]) if section == "threshold" else x[0])
        lines += [f"## {title}", "", *markdown_table(part + (overall if section != "threshold" else []), section), ""]
    text = "\n".join(lines)
    if path:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text


def task_counts(tasks: DataFrame, status: str = "status") -> DataFrame:
    """One row: finished tasks (done or failed) and whether any is waiting."""
    return tasks.agg(F.count_if(F.col(status).isin("done", "failed")).alias("finished"), F.coalesce(F.bool_or(F.col(status) == "waiting"), F.lit(False)).alias("has_waiting"))


def distinct_in_order(values: Column) -> Column:
    """Distinct items of an array in order of their first place."""
    return F.array_distinct(values)
