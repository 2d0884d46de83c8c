"""Chat formatting in budgeted windows, in DataFrame expressions only.

Prefix sums of turn tokens place every turn in one window as a new turn. A window begins with the conversation's
system turn and as much repeated history as ``history`` allows; both are left out of its loss mask, so each
assistant text is a target exactly once. Turns are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mossveil.llm.common import materialise, numbered, saved

#: The template: HEAD role SEP text END for each turn. Escaped texts hold no "#" and no "<".
HEAD, SEP, END = "### ", ": ", "</turn>\n"
#: Turns, by their places in order, whose prefix sums are taken together; sums of the blocks follow in a second step.
BLOCK = 256


def escape(text: Column) -> Column:
    """Every backslash of the result begins one of the escapes, so replacing them in reverse order gives the text."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def turn_tokens(text: Column) -> Column:
    """An estimate: words of the text, or a quarter of its bytes if that is more (texts without blanks are not one
    token), and two for the marks of its turn."""
    words = F.size(F.filter(F.split(text, "[ \t\n\x0b\x0c\r]+"), lambda w: w != "")).cast("long")
    return F.greatest(words, F.ceil(F.octet_length(text) / 4)) + 2


def chat_windows(df: DataFrame, budget: int = 2048, history: int = 256, tokens: str | None = None) -> DataFrame:
    """``conv_id, window, n_repeated, text, loss`` (array of start and end, code points from 0), ``n_tokens``.

    ``df`` has ``conv_id, turn, role, text``, and a column of token counts if ``tokens`` names one (at least one a turn,
    whatever it says, so that no number of turns fits a window), else they are estimated; other columns play no part. Turns are in order of ``turn`` (nulls first), then role and MD5
    of the text; repeated rows are turns of their own. Null roles and texts are empty; a null ``conv_id`` is a
    conversation; an empty table gives no rows. A window holds at most ``budget`` tokens unless a single turn, or the
    system turn, is longer than its share; a very long turn is a window by itself, never cut. Windows are planned on
    ids and counts alone, by blocks of turns and never in one task, and texts are joined once to the finished plan.
    """
    count = turn_tokens(F.coalesce("text", F.lit(""))) if tokens is None else F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(1)), F.lit(1))
    texts = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), count.alias("tokens"))
    texts = saved(texts.withColumn("tie", F.md5("text")).withColumn("row_id", F.monotonically_increasing_id()), "turns")
    same = lambda a, b, *on: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in on]
    turns = numbered(texts.drop("text"), ["conv_id", "turn", "role", "tie", "row_id"], "place")
    turns = turns.select("conv_id", "row_id", "tokens", (F.col("role") == "system").alias("system"), "place", F.floor(F.col("place") / BLOCK).alias("block"))
    blocks = turns.groupBy("conv_id", "block").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("conv_id", "block", before.alias("before"))
    within = W.partitionBy("conv_id", "block").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    turns = turns.withColumn("within", F.sum("tokens").over(within) - F.col("tokens"))
    turns = turns.alias("t").join(blocks.alias("b"), same("t", "b", "conv_id", "block")).select("t.conv_id", "row_id", "tokens", "system", (F.col("within") + F.col("before")).alias("start"))
    turns = materialise(turns)

    system = turns.where("system").groupBy("conv_id").agg(F.min("start").alias("s_start"), F.min_by("tokens", "start").alias("s_tokens"), F.min_by("row_id", "start").alias("s_row"))
    turns = turns.alias("t").join(system.alias("s"), same("t", "s", "conv_id"), "left").select("t.*", "s_start", "s_row", F.coalesce("s_tokens", F.lit(0)).alias("s_tokens"))
    # A turn belongs where it ends; as it is at most as long as a stride, a window has less than two strides.
    stride = F.greatest((budget - history - F.col("s_tokens")) / 2, F.lit(budget / 8)).cast("long")
    turns = materialise(turns.withColumn("window", F.floor((F.col("start") + F.col("tokens") - 1) / stride)).drop("s_tokens"))

    # The system turn leads every window after its own; s_window is set in its own row alone.
    own = F.max(F.when(F.col("row_id") == F.col("s_row"), F.col("window")))
    windows = turns.groupBy("conv_id", "window").agg(F.min("start").alias("first"), F.min("s_row").alias("s_row"), own.alias("s_window"))
    along = W.partitionBy("conv_id").orderBy("window")
    windows = windows.withColumn("next", F.lead("window").over(along)).withColumn("next_first", F.lead("first").over(along))
    windows = windows.withColumn("led", F.max("s_window").over(along.rowsBetween(W.unboundedPreceding, -1)).isNotNull())
    windows = materialise(windows.drop("s_window"))
    placed = turns.alias("t").join(windows.alias("w"), same("t", "w", "conv_id", "window"))
    again = F.col("next").isNotNull() & (F.col("next_first") - F.col("start") <= history) & ~F.col("start").eqNullSafe(F.col("s_start"))
    where = F.array_compact(F.array(F.struct(F.col("t.window").alias("window"), F.lit(False).alias("again")), F.when(again, F.struct(F.col("next").alias("window"), F.lit(True).alias("again")))))
    placed = placed.select("t.conv_id", "row_id", "start", F.explode(where).alias("at")).select("conv_id", "at.window", "at.again", "start", "row_id")
    lead = windows.where("led").select("conv_id", "window", F.lit(True).alias("again"), F.lit(-1).cast("long").alias("start"), F.col("s_row").alias("row_id"))
    rows = placed.unionByName(lead).join(texts.select("row_id", "role", "text", "tokens"), "row_id")
    rows = rows.select("conv_id", "window", F.struct("start", "again", "role", F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(SEP)).alias("head"), escape(F.col("text")).alias("body"), "tokens").alias("turn"))
    grouped = rows.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    length = F.expr(f"transform(turns, x -> length(x.head) + length(x.body) + {len(END)})")
    ends = grouped.withColumn("_n", length).withColumn("_at", F.expr("transform(sequence(1, size(_n)), i -> aggregate(slice(_n, 1, i - 1), 0, (a, x) -> a + x))"))
    return ends.select(
        "conv_id",
        "window",
        F.size(F.filter("turns", lambda x: x["again"])).alias("n_repeated"),
        F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("text"),
        F.expr("transform(filter(arrays_zip(turns, _at), x -> x.turns.role = 'assistant' AND NOT x.turns.again), x -> named_struct('start', x._at + length(x.turns.head), 'end', x._at + length(x.turns.head) + length(x.turns.body)))").alias("loss"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_tokens"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """From formatted windows: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    Null roles and texts come back as empty ones, a null ``conv_id`` as itself, repeated turns each time. The digest of
    a conversation is that of its whole text, so its windows meet in one row; no windows give no rows.
    """
    segments = F.filter(F.split("text", "</turn>\n", -1), lambda s: s != "")
    new = windows.withColumn("_s", segments).withColumn("_s", F.expr("slice(_s, n_repeated + 1, size(_s))"))
    parsed = new.select(
        "conv_id",
        "window",
        F.size("_s").cast("long").alias("n"),
        F.array_join(F.transform("_s", lambda s: F.concat(unescape_role(F.substr(s, F.lit(len(HEAD) + 1), F.instr(s, F.lit(SEP)) - len(HEAD) - 1)), F.lit("\n"), unescape(F.substr(s, F.instr(s, F.lit(SEP)) + len(SEP))), F.lit("\n"))), "").alias("turns"),
        F.array_join(F.transform("loss", lambda m: unescape(F.substring("text", m["start"] + 1, m["end"] - m["start"]))), "").alias("loss"),
        F.length("text").cast("long").alias("chars"),
    )
    whole = parsed.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("_w"), F.sum("chars").alias("formatted_chars"))
    text = lambda c: F.array_join(F.transform("_w", lambda w: w[c]), "")
    return whole.select("conv_id", "n_turns", F.sha2(text("turns"), 256).alias("turns_sha256"), F.length(text("loss")).cast("long").alias("loss_chars"), F.sha2(text("loss"), 256).alias("loss_sha256"), "formatted_chars")


ORACLE = r"""
WITH t0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
t1 AS (SELECT *, greatest(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), (strlen(text) + 3) // 4) + 2 AS tokens FROM t0),
t2 AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text) ROWS UNBOUNDED PRECEDING) - tokens AS start,
              4 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + 2 + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + 8 AS chars FROM t1),
sys AS (SELECT conv_id, min(start) AS s_start, arg_min(tokens, start) AS s_tokens, arg_min(chars, start) AS s_chars FROM t2 WHERE role = 'system' GROUP BY 1),
t3 AS (SELECT t2.*, s_start, floor((start + tokens - 1) / floor(greatest((2048 - 256 - coalesce(s_tokens, 0)) / 2, 256))) AS win
       FROM t2 LEFT JOIN sys ON t2.conv_id IS NOT DISTINCT FROM sys.conv_id),
w0 AS (SELECT conv_id, win, min(start) AS first FROM t3 GROUP BY 1, 2),
w1 AS (SELECT *, lead(first) OVER (PARTITION BY conv_id ORDER BY win) AS next_first FROM w0),
own AS (SELECT conv_id, win AS s_win FROM t3 WHERE start = s_start),
led AS (SELECT w0.conv_id, sum(s_chars) AS chars FROM w0 JOIN own ON w0.conv_id IS NOT DISTINCT FROM own.conv_id AND win > s_win
        JOIN sys ON sys.conv_id IS NOT DISTINCT FROM w0.conv_id GROUP BY 1),
app AS (SELECT t3.*, chars * CASE WHEN next_first - start <= 256 AND start IS DISTINCT FROM s_start THEN 2 ELSE 1 END AS all_chars
        FROM t3 JOIN w1 ON t3.conv_id IS NOT DISTINCT FROM w1.conv_id AND t3.win = w1.win),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY start)) AS turns_sha256,
             coalesce(string_agg(text, '' ORDER BY start) FILTER (WHERE role = 'assistant'), '') AS loss, sum(all_chars) AS chars FROM app GROUP BY 1)
SELECT g.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, (g.chars + coalesce(led.chars, 0))::BIGINT AS formatted_chars
FROM g LEFT JOIN led ON g.conv_id IS NOT DISTINCT FROM led.conv_id
"""
