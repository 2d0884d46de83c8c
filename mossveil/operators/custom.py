"""User-defined detectors, and names by an injected (local) language model client."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from mossveil.functions import detectors as rules
from mossveil.functions.spans import SPANS
from mossveil.operators import scan

LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1")


def require_local(url: str) -> str:
    """Texts with personal data are only sent to this host itself."""
    parts = urlparse(url)
    if parts.scheme not in ("http", "https") or parts.hostname not in LOCAL_HOSTS:
        raise ValueError("only a local model host is allowed")
    return url


def _spans_column(df: DataFrame, column: str, found: Callable[[str], list[tuple[str, int, int, float, str]]], out: str) -> DataFrame:
    """Add spans that a Python function finds; it runs in Arrow batches next to the rows."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("confidence", pa.float64()), ("detector", pa.string())]))
    schema = T.StructType([f for f in df.schema if f.name != out]).add(out, T._parse_datatype_string(SPANS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"kind": k, "start": s, "end": e, "text": t[s:e], "confidence": c, "detector": d} for k, s, e, c, d in found(t)] if t else [] for t in batch.column(column).to_pylist()]
            names = [n for n in batch.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(rows, kind)], [*names, out])

    return df.mapInArrow(run, schema)


def detect_with(df: DataFrame, kind: str, detector: str, function: Callable[[str], list[tuple[int, int, float]]], text: str = "text", out: str = "custom_spans") -> DataFrame:
    """Add the spans of a user's function from a text to (start, end, confidence) tuples."""
    return _spans_column(df, text, lambda t: [(kind, s, e, float(c), detector) for s, e, c in function(t)], out)


def occurrences(text: str, names: list) -> list[tuple[str, int, int, float, str]]:
    """Every occurrence of each name without its honorific; what the text does not hold is dropped."""
    out = []
    for name in dict.fromkeys(n for n in names if isinstance(n, str) and n.strip()):
        name = name.strip()
        if len(name) > 2 and name[-1] in "님씨":
            name = name[:-1]
        at = text.find(name)
        while at >= 0:
            out.append(("name", at, at + len(name), 0.9, "LLMNameDetector"))
            at = text.find(name, at + len(name))
    return sorted(out, key=lambda s: s[1])


def detect_names_with(df: DataFrame, client: Callable[[str], list], text: str = "text", out: str = "name_spans", calls: Accumulator | None = None) -> DataFrame:
    """Add names that ``client`` finds, with the sure ones of the rules as a safety net.

    Only texts that may hold a name reach the client, and each distinct one once, however many rows have it: they are
    split off before the Python stage, and the answers are joined back by the text's digest. ``calls`` (of
    ``spark.sparkContext.accumulator(0)``) counts the calls made; a task that runs again counts anew. A failing client
    fails the job. All columns of ``df`` pass through but for ``out``, which is replaced.
    """
    may, key, answer = scan.unused(df, "_may"), scan.unused(df, "_key"), scan.unused(df, "_answer")
    marked = scan.fixed(df, may, rules.name_candidate(F.col(text)))
    digest = F.when(F.col(may), F.sha2(F.col(text), 256))
    asked = marked.where(F.col(may)).select(digest.alias(key), F.col(text).alias("text")).dropDuplicates([key])

    def ask(value: str) -> list:
        if calls is not None:
            calls.add(1)
        return occurrences(value, client(value))

    answers = _spans_column(asked, "text", ask, answer).select(key, answer)
    joined = marked.withColumn(key, digest).join(answers, key, "left")
    found = F.concat(F.coalesce(F.col(answer), F.array().cast(SPANS)), rules.name(F.col(text), 0.75))
    rest = [scan.quoted(c) for c in df.columns if c != out]
    return joined.select(*rest, found.alias(out))


def names_of_reply(reply: Column) -> Column:
    """``struct(status, names)`` of a model's reply: JSON whose field ``response`` is again JSON, with a list ``names``.

    ``ok`` has the names that are non-empty strings (entries of other types are left out, a missing list is an empty
    one); ``unreadable`` is a reply that is not JSON, or whose response is missing or is not JSON; ``no list`` is a
    response that is no object, or whose names are no list. Neither of these says what the reply held, which may be
    personal data. A null reply is unreadable.
    """
    inner = F.try_parse_json(F.try_variant_get(F.try_parse_json(reply), "$.response", "string"))
    kind = F.schema_of_variant(inner)
    names = F.try_variant_get(inner, "$.names", "variant")
    missing = names.isNull()
    is_list = F.coalesce(F.startswith(F.schema_of_variant(names), F.lit("ARRAY")), F.lit(False))
    status = F.when(inner.isNull(), "unreadable").when(~F.startswith(kind, F.lit("OBJECT")) | ~(missing | is_list), "no list").otherwise("ok")
    items = F.when(is_list, F.try_variant_get(inner, "$.names", "array<variant>"))
    texts = F.filter(F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))), lambda t: t.isNotNull() & (t != ""))
    return F.struct(status.alias("status"), F.when(status == "ok", F.coalesce(texts, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("names"))


def register_detector(spark: SparkSession, name: str, kind: str, function: Callable[[str], list[tuple[int, int, float]]]) -> None:
    """Make a user's function from a text to (start, end, confidence) tuples a table function of SQL.

    ``SELECT d.*, s.* FROM docs d, LATERAL name(d.text) s`` gives ``kind, start, end, text, confidence`` of each span;
    null and empty texts have none. Its argument is one string column, which is checked when the query is analysed.
    """
    fields = T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()).add("text", T.StringType()).add("confidence", T.DoubleType())

    class Detector:
        @staticmethod
        def analyze(*args: AnalyzeArgument, **named: AnalyzeArgument) -> AnalyzeResult:
            if named or len(args) != 1 or args[0].isTable or not isinstance(args[0].dataType, (T.StringType, T.NullType)):
                raise ValueError(f"{name} takes one text")
            return AnalyzeResult(schema=fields)

        def eval(self, text: str) -> Iterator[tuple]:
            for start, end, confidence in function(text) if text else []:
                yield kind, start, end, text[start:end], float(confidence)

    spark.udtf.register(name, udtf(Detector))
