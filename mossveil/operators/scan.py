"""DataFrame operators: finding, resolving and rewriting personal information in a text column."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mossveil.functions import detectors as rules
from mossveil.functions import resolve as res
from mossveil.functions.spans import SPANS, near_digits


def fixed(df: DataFrame, name: str, value) -> DataFrame:
    """Add a column that is evaluated once per row.

    It is projected and then generated: a filter or another expression over it would else be merged with it, and then
    evaluate it anew for every use and every element of an array. The projection is compiled, with all its tests and
    branches that no function of higher order holds; a generator would interpret them.
    """
    kept, held = [quoted(c) for c in df.columns if c != name], unused(df, "_held")
    return df.select(*kept, value.alias(held)).select(*kept, F.explode(F.array(F.col(held))).alias(name))


def quoted(name: str) -> Column:
    """A column by its name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """A name that no column of the caller has."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def spread(keys: DataFrame) -> DataFrame:
    """The same rows on all cores: a small file of keys is one task's input, however much is made of every key."""
    return keys.repartition(keys.sparkSession.sparkContext.defaultParallelism)


def detect(df: DataFrame, text: str = "text", detectors: Mapping[str, rules.Detector] | None = None, out: str = "raw_spans") -> DataFrame:
    """Add all spans of all detectors, in their order, overlaps included. ``None`` means the default set, an empty
    mapping no detector. Row-local: one narrow stage, whatever follows."""
    chosen = tuple((rules.DEFAULT if detectors is None else detectors).values())
    near = unused(df, "_near")
    if any(takes_windows(d) for d in chosen):
        df = fixed(df, near, built(windows_of, text))  # once for all detectors of numbers
    return fixed(df, out, built(spans_of, text, near, chosen)).drop(near)


def takes_windows(detector: rules.Detector) -> bool:
    return getattr(detector, "takes_windows", False)


def windows_of(text: str) -> Column:
    return near_digits(F.col(text))


def spans_of(text: str, near: str, detectors: tuple[rules.Detector, ...]) -> Column:
    arrays = [d(F.col(text), F.col(near)) if takes_windows(d) else d(F.col(text)) for d in detectors]
    return F.concat(*arrays) if arrays else F.array().cast(SPANS)


def resolved_of(text: str, raw: str) -> Column:
    return res.resolve(F.col(text), F.col(raw))


def built(make: Callable[..., Column], *names) -> Column:
    """An expression over columns of these names, put together once: each takes thousands of calls to the JVM."""
    return _built(SparkContext._gateway, make, *names)


@functools.lru_cache(maxsize=256)
def _built(gateway, make: Callable[..., Column], *names) -> Column:
    return make(*names)


def scan(df: DataFrame, text: str = "text", detectors: Mapping[str, rules.Detector] | None = None, out: str = "spans") -> DataFrame:
    """Add the resolved, disjoint spans of a text."""
    raw = unused(df, "_raw")
    return fixed(detect(df, text, detectors, raw), out, built(resolved_of, text, raw)).drop(raw)


def anonymize(df: DataFrame, text: str = "text", strategy: str | Callable[[Column], Column] = "mask", spans: str = "spans", out: str = "anonymized", row_key: str | None = None, **options) -> DataFrame:
    """Add the rewritten text by ``mask`` (char, keep_head), ``label`` (labels, numbered) or ``pseudonym`` (salt), or
    by a function of one's own from a span to what stands in its place."""
    t, s = F.col(text), F.col(spans)
    if callable(strategy):
        value = res.rewrite(t, s, strategy)
    elif strategy == "mask":
        value = res.mask(t, s, **options)
    elif strategy == "label":
        value = res.label(t, s, **options)
    elif strategy == "pseudonym":
        value = res.pseudonym(t, s, F.col(row_key) if row_key else F.xxhash64(t), **options)
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    return fixed(df, out, value)


def explode_spans(df: DataFrame, *keys: str, spans: str = "spans", with_text: bool = False) -> DataFrame:
    """One row per span. The found text is left out unless asked for, so that reports carry no personal data."""
    fields = ["kind", "start", "end", *(["text"] if with_text else []), "confidence", "detector"]
    if clash := [k for k in keys if k in fields]:
        raise ValueError(f"keys named as fields of spans: {clash}")
    row = F.struct(*[quoted(k).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.lit(0)
    both = df.select(row.alias("_row"), F.explode(spans).alias("_span"))
    return both.select(*[F.col(f"_row.k{i}").alias(k) for i, k in enumerate(keys)], *[F.col(f"_span.{f}").alias(f) for f in fields])


def report_json(df: DataFrame, spans: str = "spans", out: str = "report", with_text: bool = True) -> DataFrame:
    fields = ["kind", "start", "end", *(["text"] if with_text else []), "confidence", "detector"]
    return df.withColumn(out, F.to_json(F.transform(spans, lambda s: F.struct(*[s[f].alias(f) for f in fields]))))


def above(spans: str, threshold: float) -> Column:
    """Spans of at least that confidence; applied after resolution."""
    return F.filter(spans, lambda s: s["confidence"] >= threshold)


#: Parts that spans are dealt into, for each partition of their input (128 MB of a file at most).
PARTS = 16


def merge_islands(spans: DataFrame, key: str) -> DataFrame:
    """Overlap resolution of exploded spans (``key, kind, start, end, confidence, detector, ord``) by windows.

    The relational form of ``functions.resolve.resolve``, for spans that are rows already: islands of overlapping
    spans by a running maximum of ends. One shuffle by the document key, into a number of parts that follows from the
    input's: left to itself, Spark joins small parts again, and one task then sorts all of what they hold.
    """
    spans = spans.repartition(PARTS * spans.rdd.getNumPartitions(), key)
    order = [F.col("start"), F.col("start") - F.col("end"), -F.col("confidence"), F.col("ord")]
    before = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    marked = spans.withColumn("_end", F.max("end").over(before)).withColumn("_new", (F.col("_end").isNull() | (F.col("start") >= F.col("_end"))).cast("int"))
    marked = marked.withColumn("_island", F.sum("_new").over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy(key, "_island").orderBy(*order)
    marked = marked.withColumn("_top", F.max("confidence").over(inside.rowsBetween(W.unboundedPreceding, -1))).withColumn("_rank", F.row_number().over(inside))
    wins = F.col("_new").eqNullSafe(1) | ((F.col("end") > F.col("_end")) & (F.col("confidence") > F.col("_top")))
    return marked.groupBy(key, "_island").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min_by("kind", F.struct(-F.col("confidence"), F.col("_rank"))).alias("kind"),
        F.max("confidence").alias("confidence"),
        F.max_by(F.when(wins, F.col("detector")), F.when(wins, F.col("_rank"))).alias("detector"),
    ).drop("_island")


def kind_counts(spans: DataFrame) -> DataFrame:
    """Spans and smallest confidence by kind."""
    return spans.groupBy("kind").agg(F.count("*").alias("n"), F.min("confidence").alias("min_confidence"))


def summary_text(df: DataFrame, spans: str = "spans", out: str = "summary", none: str = "-") -> DataFrame:
    """``label n · label n`` in order of first appearance."""
    kinds = F.array_distinct(F.transform(spans, lambda s: s["kind"]))
    each = F.transform(kinds, lambda k: F.concat_ws(" ", res.label_of(k), F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("string")))
    return df.withColumn(out, F.when(F.size(spans) == 0, F.lit(none)).otherwise(F.array_join(each, " · ")))


def validate_input(df: DataFrame, text: str = "text", longest: int = 100_000, out: str = "status") -> DataFrame:
    """Status of a request: 200, 400 for an empty or missing text, 413 for one that is too long."""
    n = F.length(text)
    return df.withColumn(out, F.when(F.coalesce(n, F.lit(0)) < 1, 400).when(n > longest, 413).otherwise(200))


def display(df: DataFrame, text: str = "text", raw: str = "raw_spans", strategy: str = "mask", out: str = "anonymized", **options) -> DataFrame:
    """Rewrite by the display rule: of raw spans, those that begin within an earlier one are left out, not merged."""
    shown = unused(df, "_shown")
    return anonymize(fixed(df, shown, res.first_only(F.col(raw))), text, strategy, shown, out, **options).drop(shown)


def at_strength(df: DataFrame, strength: int, spans: str = "spans", out: str = "shown") -> DataFrame:
    """Add the spans that a masking strength of 0 to 100 shows (confidence in percent of at least 100 less it), and
    ``n_hidden``, the number of the others."""
    return df.withColumn(out, F.filter(spans, lambda s: s["confidence"] * 100 >= 100 - strength)).withColumn("n_hidden", F.size(spans) - F.size(out))


def flag_unsure(df: DataFrame, spans: str = "spans", out: str = "unsure") -> DataFrame:
    """Add an array that says of each span whether its confidence is below 1."""
    return df.withColumn(out, F.transform(spans, lambda s: s["confidence"] < 1))


def counts_of(spans: DataFrame, *kinds: str) -> DataFrame:
    """The counts of some kinds, a row each, of zeros for those that are not there; from one pass over the spans."""
    of = lambda k: F.col("kind") == k
    each = [F.struct(F.lit(k).alias("kind"), F.count_if(of(k)).alias("n"), F.coalesce(F.min(F.when(of(k), F.col("confidence"))), F.lit(0.0)).alias("min_confidence")) for k in kinds]
    return spans.agg(F.array(*each).alias("_each")).select(F.inline("_each"))


def in_order(counts: DataFrame) -> DataFrame:
    """Counts by kind (a dozen rows) with their ``place`` in the fixed order of kinds; unknown kinds follow by name."""
    at = F.array_position(F.array(*[F.lit(k) for k in res.LABELS]), F.col("kind"))
    place = F.row_number().over(W.orderBy(F.when(at > 0, at).otherwise(len(res.LABELS) + 1), "kind"))
    return counts.select(place.alias("place"), "kind", "n", "min_confidence")
