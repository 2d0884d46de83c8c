"""Quality rules with host-level verdicts, in DataFrame expressions only.

Each document gets the figures of the base rules from its whole text. Failures are then counted by host; a host's
failure rate is shrunk towards the corpus by a beta prior whose mean and strength are fitted to all hosts, so that
a host of few documents is not condemned by one of them. Documents of a host go as well if even the lower bound of
its rate stands clear of the corpus: if the odds of failing are ``lift`` times those of the prior's mean there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mossveil.llm.common import materialise

#: White space between words: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


#: Failing hosts are broadcast if there are no more than these, some 10 MB.
BROADCAST_HOSTS = 100_000


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def as_row(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """The caller's columns in one struct, where they clash with no working column."""
    return F.struct(*[column(c) for c in df.columns if c not in without])


def from_row(df: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    return [F.col("_row")[c].alias(c) for c in df.columns if c not in without]


def with_base_rules(df: DataFrame, text: str = "text", min_words: int = 50, max_repeat_percent: int = 50, figures: tuple[str, ...] = BASE) -> DataFrame:
    """Add the figures of BASE and ``base_failed``; other columns pass through (those of these names are replaced).

    Null and empty texts have no words, so they fail. Repeated 3-word windows are found by their 64-bit hashes; they
    are sorted within the row only where two are equal, so a very long text takes n log n; no shuffle takes place.
    Repeated rows are judged one by one, and an empty table gives no rows. ``figures`` names those to add, of BASE;
    the verdict is the same with any.
    """
    new = (*figures, "base_failed")
    words = df.select(as_row(df, new).alias("_row"), F.coalesce(column(text), F.lit("")).alias("_t")).withColumn("_w", F.filter(F.split("_t", "[ \t\n\x0b\x0c\r]+"), lambda w: w != ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.ltrim(x, F.lit(BLANKS)) != "")
    counted = words.select(
        "_row",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        F.expr("transform(sequence(0, greatest(size(_w) - 3, 0)), i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)))").alias("_h"),
    )
    # Most texts repeat no window; a set of hashes tells them at a fraction of the cost of sorting.
    ordered = counted.withColumn("_s", F.expr("if(size(array_distinct(_h)) < size(_h), sort_array(transform(_h, (h, i) -> named_struct('h', h, 'i', i))), CAST(array() AS ARRAY<STRUCT<h: BIGINT, i: INT>>))"))
    found = ordered.withColumn("_p", F.expr("sort_array(transform(filter(_s, (x, k) -> x.h = get(_s, k - 1).h OR x.h = get(_s, k + 1).h), x -> x.i))"))
    covered = F.expr("aggregate(_p, named_struct('e', 0, 'n', 0), (a, p) -> named_struct('e', p + 3, 'n', a.n + p + 3 - greatest(p, a.e)), a -> CAST(a.n AS BIGINT))")
    all_figures = {c: F.col(c) for c in ("n_words", "word_chars", "n_symbols")} | {"n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"), "n_repeat_words": covered}
    made = F.struct(*[all_figures[c].alias(c) for c in dict.fromkeys((*figures, "n_words", "n_repeat_words"))])
    # Generated rather than projected: a filter on the figures must not be pushed into the expressions above, which
    # would then be evaluated anew for every element of their arrays.
    out = found.select("_row", F.explode(F.array(made)).alias("_r"))
    failed = (F.col("_r.n_words") < min_words) | (100 * F.col("_r.n_repeat_words") > max_repeat_percent * F.col("_r.n_words"))
    return out.select(*from_row(df, new), *[F.col(f"_r.{c}").alias(c) for c in figures], failed.alias("base_failed"))


def host_verdicts(ruled: DataFrame, host: str = "source", lift: float = 3.0, errors: float = 3.0) -> DataFrame:
    """``host, host_docs, host_rate, host_failed`` from ``base_failed`` of all documents; a null host is one host.

    The prior's mean is the corpus rate, and its strength follows from how much more the hosts' rates differ than
    chance would make them (method of moments, between 1 and 1e6 documents). Two aggregates; four numbers of the
    second reach the driver. A host fails if its posterior rate less ``errors`` standard deviations has at least
    ``lift`` times the prior's odds: a rate of 0.27 where a tenth of all documents fail, of 0.75 where half do. Hosts
    that differ by no more than chance all have the corpus rate, and none fails: of 1,200,000 simulated hosts of 1 to
    5,000 documents with one rate of 0.02, 0.1, 0.3 or 0.5 none does (300 corpora each); where hosts' own rates vary
    as a beta of strength 10 around 0.1, 0.28 % do. Both numbers are parameters; these suit a rule that must not
    condemn by chance.
    """
    hosts = ruled.groupBy(column(host).alias("host")).agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("_k"))
    hosts = materialise(hosts)
    # Weighted moments of the hosts' rates: sums of k, n, k^2 / n and the number of hosts.
    k, n, square, h = hosts.agg(F.sum("_k"), F.sum("host_docs"), F.sum(F.col("_k") * F.col("_k") / F.col("host_docs")), F.count("*")).first()
    alpha, beta = beta_prior(k or 0, n or 0, square or 0.0, h)
    weight = F.col("host_docs") + F.lit(alpha + beta)
    rate = (F.col("_k") + F.lit(alpha)) / weight
    lower = rate - errors * F.sqrt(rate * (1 - rate) / (weight + 1))
    return hosts.select("host", "host_docs", rate.alias("host_rate"), (lower * F.lit(beta) >= lift * F.lit(alpha) * (1 - lower)).alias("host_failed"))


def beta_prior(k: float, n: float, square: float, hosts: int) -> tuple[float, float]:
    """Alpha and beta; without documents, or where all or none fail, the mean is kept just inside (0, 1)."""
    mean = min(max(k / n if n else 0.5, 1e-6), 1 - 1e-6)
    chance = mean * (1 - mean)
    between = (square / n - mean * mean if n else 0.0) - chance * hosts / max(n, 1)
    strength = min(max(chance / between - 1, 1.0), 1e6) if between > 0 else 1e6
    return mean * strength, (1 - mean) * strength


def judge(ruled: DataFrame, host: str = "source", **options) -> DataFrame:
    """Add ``host_rate`` and ``kept``; other columns pass through (those of these names are replaced).

    ``ruled`` should be materialised, as it is read for the hosts and again here. The hosts are joined back as Spark
    sees fit: broadcast if they prove small, else by a shuffle whose hot hosts the adaptive skew join splits.
    """
    new = ("host_rate", "kept")
    hosts = host_verdicts(ruled, host, **options).select("host", "host_rate", "host_failed")
    rows = ruled.select(as_row(ruled, new).alias("_row"), column(host).alias("_host"), F.col("base_failed").alias("_failed"))
    joined = rows.join(hosts, F.col("_host").eqNullSafe(F.col("host")), "left")
    return joined.select(*from_row(ruled, new), "host_rate", (~F.col("_failed") & ~F.col("host_failed")).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", **options) -> DataFrame:
    """The rows and columns of ``docs`` that pass, all as they were, whatever their names.

    The rules run twice, once for the counts of the hosts and once for the rows, which leaves no copy of the texts on
    disk and shuffles none. Rows are joined with the failing hosts only, broadcast up to BROADCAST_HOSTS of them;
    beyond, the skew join splits hot hosts. Null texts go, null hosts are one host, repeated rows stay or go together,
    and an empty table gives no rows.
    """
    rows = docs.select(as_row(docs).alias("_row"), column(text).alias("text"), column(host).alias("host"))
    slim = with_base_rules(rows.drop("_row"), figures=()).select("host", "base_failed")
    bad = materialise(host_verdicts(slim, "host", **options).where("host_failed").select(F.col("host").alias("_host")))
    good, many = with_base_rules(rows, figures=()).where("NOT base_failed"), bad.count()
    if many:
        good = good.join(F.broadcast(bad) if many <= BROADCAST_HOSTS else bad, F.col("host").eqNullSafe(F.col("_host")), "left_anti")
    return good.select(*from_row(docs))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS x FROM w),
g AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS tri FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, CASE WHEN tri IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, tri) > 1 THEN 1 ELSE 0 END AS f FROM g),
m AS (SELECT doc_id, max(f) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM c),
r AS (SELECT doc_id, sum(hit)::BIGINT AS n FROM m GROUP BY 1),
b AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS k FROM f GROUP BY 1),
a AS (SELECT least(greatest(sum(k) / sum(n), 1e-6), 1 - 1e-6) AS mean, sum(k * k / n) / sum(n) AS square, count(*) / sum(n) AS share FROM h),
s AS (SELECT mean, square - mean * mean - mean * (1 - mean) * share AS between_ FROM a),
q AS (SELECT mean, CASE WHEN between_ > 0 THEN least(greatest(mean * (1 - mean) / between_ - 1, 1), 1e6) ELSE 1e6 END AS strength FROM s),
u AS (SELECT source, mean, n + strength AS w, (k + mean * strength) / (n + strength) AS rate FROM h, q),
l AS (SELECT source, mean, rate - 3 * sqrt(rate * (1 - rate) / (w + 1)) AS low FROM u),
v AS (SELECT source, low / (1 - low) >= 3 * (mean / (1 - mean)) AS bad FROM l)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
