"""Source divergence audit: how the term frequencies of the sources of a language differ, summed in DuckDB by shard.

1. Where the documents are, DuckDB counts terms by (lang, source, term), so what is shuffled is counts and no text.
2. Counts are dealt to shards by a hash of lang and term. DuckDB adds up a shard and keeps the terms in enough
   documents; Spark sums what is kept to the totals of groups and languages.
3. The kept counts are dealt again, with the totals of all groups sent to every shard. DuckDB makes the smoothed
   integer shares and the partial sums of a shard's terms for every pair of sources, and its best terms of each group.
4. Spark adds up the partial sums and ranks them.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mossveil.llm.common import materialise, saved, slices

#: Terms are runs of code points other than these; A-Z alone are lower-cased.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Counts that a task holds before it passes them on, and DuckDB's memory; what is beyond it goes to a scratch folder.
HELD, MEMORY = 1_000_000, "400MB"


def share(n: str, total: str, kept: str) -> str:
    """SQL of a term's share in billionths, smoothed by 5 a term; whole numbers of 128 bits."""
    return f"1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5::HUGEINT * {kept})"


def with_duckdb(work: Callable[[duckdb.DuckDBPyConnection, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function of batches that has a connection of its own, with bounded memory, one thread and a scratch folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as scratch, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": scratch, "preserve_insertion_order": False}) as con:
            yield from work(con, batches)

    return run


def rows(con: duckdb.DuckDBPyConnection, sql: str) -> Iterator[pa.RecordBatch]:
    with con.cursor() as own:  # else the connection would be taken until the last row is read
        yield from own.sql(sql).to_arrow_reader(50_000)


def count_terms(con: duckdb.DuckDBPyConnection, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of a task's groups."""
    con.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
    out = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM counts GROUP BY ALL"
    for batch in batches:
        for part in slices(batch, 4 << 20):
            con.register("docs", pa.Table.from_batches([part]).append_column("row", pa.array(range(part.num_rows), pa.int64())))
            con.execute(f"""INSERT INTO counts SELECT lang, source, term, sum(n), count(*) FROM (
              SELECT row, lang, source, term, count(*) AS n FROM (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM docs) GROUP BY ALL) GROUP BY ALL""")
            con.unregister("docs")
            if con.execute("SELECT count(*) FROM counts").fetchall()[0][0] > HELD:
                yield from rows(con, out)
                con.execute("TRUNCATE counts")
    yield from rows(con, out)


def keep_terms(least: int) -> Callable:
    """The summed counts of a shard's terms in at least so many documents; ``lead`` is 1 once a term."""

    def work(con: duckdb.DuckDBPyConnection, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        for batch in batches:
            con.register("batch", batch)
            con.execute("INSERT INTO counts SELECT * FROM batch")
            con.unregister("batch")
        con.execute(f"CREATE TABLE kept AS SELECT lang, term, min(source) AS first FROM counts GROUP BY ALL HAVING sum(docs) >= {least}")
        yield from rows(con, "SELECT lang, source, term, sum(n)::BIGINT AS n, max((source = first)::BIGINT) AS lead FROM counts JOIN kept USING (lang, term) GROUP BY ALL")

    return with_duckdb(work)


def sum_shards(top: int) -> Callable:
    """Partial sums of the pairs of sources, and the best terms of each group, over a task's terms."""

    def work(con: duckdb.DuckDBPyConnection, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con.execute("CREATE TABLE given (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, total BIGINT, lang_total BIGINT, terms BIGINT)")
        for batch in batches:
            con.register("batch", batch)
            con.execute("INSERT INTO given SELECT lang, source, term, n, total, lang_total, terms FROM batch")
            con.unregister("batch")
        con.execute(f"""CREATE TABLE shares AS WITH g AS (SELECT DISTINCT lang, source, total, lang_total, terms FROM given WHERE term IS NULL),
          t AS (SELECT lang, term, sum(n) AS n FROM given WHERE term IS NOT NULL GROUP BY ALL)
          SELECT g.lang, g.source, t.term, coalesce(k.n, 0) AS n, ({share('coalesce(k.n, 0)', 'g.total', 'g.terms')})::BIGINT AS p, ({share('t.n', 'g.lang_total', 'g.terms')})::BIGINT AS q
          FROM t JOIN g ON g.lang = t.lang LEFT JOIN given k ON k.lang = g.lang AND k.source = g.source AND k.term = t.term""")
        yield from rows(con, """SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
          FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL""")
        yield from rows(con, f"""SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q
          QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {top}""")

    return with_duckdb(work)


def divergence(docs: DataFrame, least: int = 30, top: int = 50, shards: int | None = None) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every (lang, source) group of ``docs`` (``text, lang, source``).

    Nulls are read as empty strings. Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, of which A-Z are lower-cased;
    a language keeps the terms that at least ``least`` of its rows hold. A group or language with N occurrences of the
    V kept terms gives each of them the share 1 + floor(10^9 (count + 5) / (N + 5 V)). Part ``pair`` has each other
    source of the language with the sum of the absolute differences of all shares (0 where V is 0), at every rank;
    part ``term`` the ``top`` terms that occur in the group and have a larger share than in the language, by the
    difference. Ranks run from 1 by value descending, then by the item's UTF-8. All arithmetic is of whole numbers.

    Every row is a document: repeated rows count each time. A source without terms still has its pairs; a language of
    one source has no pairs, an empty table no rows. Texts are counted in slices of a few MB, a longer one by itself.
    Other columns play no part, whatever their names. The pairs of sources of a language are as many as the result
    has rows; they exist as sums alone, one row for each pair and task.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = given.mapInArrow(with_duckdb(count_terms), "lang string, source string, term string, n long, docs long")
    kept = saved(counted.repartition(shards, "lang", "term").mapInArrow(keep_terms(least), "lang string, source string, term string, n long, lead long"), "kept-terms")

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("lead").alias("terms"))
    languages = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("terms").alias("terms"))
    groups = given.select("lang", "source").distinct().join(totals.drop("terms"), ["lang", "source"], "left").join(languages, "lang", "left")
    groups = materialise(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_total", "terms")]))

    of_shard = "shard int, lang string, source string, term string, n long, total long, lang_total long, terms long"
    none = F.lit(None)
    dealt = kept.select(F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard"), "lang", "source", "term", "n", none.alias("total"), none.alias("lang_total"), none.alias("terms"))
    everywhere = groups.where("terms > 0").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "lang", "source", none.alias("term"), none.alias("n"), "total", "lang_total", "terms")
    work = dealt.union(everywhere).to(spark.createDataFrame([], of_shard).schema)
    found = saved(work.repartition(shards, "shard").mapInArrow(sum_shards(top), "lang string, source string, part string, item string, value long"), "partial-sums")

    summed = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    empty = groups.where("terms = 0").select("lang", "source")
    pairs = summed.union(summed.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = pairs.union(empty.join(empty.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value")))
    both = pairs.withColumn("part", F.lit("pair")).unionByName(found.where("part = 'term'"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return both.withColumn("rank", rank).where(f"part = 'pair' OR rank <= {int(top)}").select("lang", "source", "part", "item", "value", "rank")


ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '{TERM}')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY 1),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(v, 0) AS v, l.total AS lang_total, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN l USING (lang)),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share('coalesce(c.n, 0)', 'g.total', 'g.v')} AS p, {share('k.n', 'g.lang_total', 'g.v')} AS q
      FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce((SELECT sum(abs(i.p - j.p)) FROM s i JOIN s j ON i.lang = j.lang AND i.term = j.term WHERE i.lang = x.lang AND i.source = x.source AND j.source = y.source), 0) AS value
      FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM a)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50"""
