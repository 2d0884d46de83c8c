"""Text files as documents, labelled JSON lines, and masked copies."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BYTES = 10 * 1024 * 1024
EXTENSIONS = ("txt", "csv", "tsv", "md", "json", "log")
LABELLED = "doc_id long, text string, labels array<struct<kind:string,start:int,end:int>>, difficulty string"


def guard_path(path: str, root: str) -> str:
    """A local path that is no link, lies under ``root`` and is a file; raises otherwise, in that order."""
    if os.path.islink(path):
        raise ValueError("links are not read")
    real = os.path.realpath(path)
    if os.path.commonpath([real, os.path.realpath(root)]) != os.path.realpath(root):
        raise ValueError("outside the allowed folder")
    if not os.path.isfile(real):
        raise ValueError("not a file")
    return real


def read_guarded(paths: DataFrame, root: str, max_bytes: int = MAX_BYTES, path: str = "path") -> DataFrame:
    """``path, status, text`` of local files by their paths, for callers that cannot be trusted.

    The checks come in this order, and the first that fails is the status: ``link``, ``outside`` (of the folder
    ``root``, once all links and dots are followed), ``missing`` (no such file, or no plain one), ``too large``,
    ``not UTF-8``; else ``ok``. What is opened is the file that was checked: a link put in its place meanwhile is not
    followed. Files that cannot be read for another reason are ``failed: `` and the reason; a null path is ``missing``.
    """
    base = os.path.realpath(root)

    def one(name: str | None) -> tuple[str, str | None]:
        if not name:
            return "missing", None
        if os.path.islink(name):
            return "link", None
        real = os.path.realpath(name)
        if os.path.commonpath([real, base]) != base:
            return "outside", None
        if not os.path.isfile(real):
            return "missing", None
        try:
            with os.fdopen(os.open(real, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0)), "rb") as f:
                raw = f.read(max_bytes + 1)
            return ("too large", None) if len(raw) > max_bytes else ("ok", raw.decode("utf-8"))
        except UnicodeDecodeError:
            return "not UTF-8", None
        except OSError as e:
            return f"failed: {e.strerror}", None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():  # one at a time, as each may be large
                status, text = one(name)
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([status]), pa.array([text], pa.string())], ["path", "status", "text"])

    return paths.select(F.col(path).cast("string").alias("path")).mapInArrow(run, "path string, status string, text string")


def read_texts(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """``path, status, text`` of each file: one that cannot be read gets a status instead of failing the job.

    Masked copies, other extensions, too large and binary files (a zero byte in the first 8192) are skipped with a
    reason, and so are empty ones where the reader shows them (Spark's passes over them, so they have no row); texts are UTF-8 without its mark, else taken for the Korean Windows code page.
    """
    return texts_of(spark.read.format("binaryFile").load(path), max_bytes, extensions)


def texts_of(files: DataFrame, max_bytes: int = MAX_BYTES, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """``read_texts`` for rows of Spark's binary reader, also those of a stream's batch."""
    files = files.select("path", "length", "content")
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    status = (
        F.when(F.regexp_replace(name, r"\.[^.]*$", "").endswith("_masked"), "masked copy")
        .when(~extension.isin(*extensions), "unsupported")
        .when(F.col("length") == 0, "empty")
        .when(F.col("length") > max_bytes, "too large")
        .when(F.contains(F.substring("content", 1, 8192), F.lit(b"\0")), "binary")
        .otherwise("ok")
    )
    utf8 = F.call_function("is_valid_utf8", F.col("content").cast("string"))
    decoded = files.withColumn("status", status).withColumn("_utf8", utf8)
    text = F.when((F.col("status") == "ok") & F.col("_utf8"), F.regexp_replace(F.col("content").cast("string"), "^﻿", ""))
    done = decoded.withColumn("text", text)
    other = cp949(F.when((F.col("status") == "ok") & ~F.col("_utf8"), F.col("content")))
    return done.withColumn("text", F.coalesce("text", other)).withColumn("status", F.when((F.col("status") == "ok") & F.col("text").isNull(), "undecodable").otherwise(F.col("status"))).select("path", "status", "text")


def cp949(content: Column) -> Column:
    """Text of bytes in the Korean Windows code page; null where they are not."""
    @F.arrow_udf(T.StringType())
    def decode(column: pa.Array) -> pa.Array:
        def one(raw):
            try:
                return None if raw is None else raw.decode("cp949")
            except UnicodeDecodeError:
                return None

        return pa.array([one(r) for r in column.to_pylist()], pa.string())

    return decode(content)


def masked_path(path: Column) -> Column:
    """``folder/name.ext`` to ``folder/name_masked.ext``; a dot in a folder's name begins no extension."""
    return F.when(path.rlike(r"[^/\\]\.[^./\\]*$"), F.regexp_replace(path, r"(\.[^./\\]*)$", "_masked$1")).otherwise(F.concat(path, F.lit("_masked")))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled documents in JSON lines; blank lines are skipped and a missing difficulty is ``unknown``.

    A line that is no JSON object of these fields fails the job, wherever it is read.
    """
    rows = spark.read.schema(LABELLED).option("mode", "FAILFAST").json(path)
    # Missing ids are negative, so that they equal none of a data set's own.
    return rows.withColumn("difficulty", F.coalesce("difficulty", F.lit("unknown"))).withColumn("doc_id", F.coalesce("doc_id", -1 - F.monotonically_increasing_id()))


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines in UTF-8, not escaped; folders are made, and existing output is never overwritten."""
    df.write.mode("errorifexists").json(path)


def read_strict(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``path, text`` of UTF-8 files; one that is too large or not UTF-8 fails the job before anything is written
    for it, and there is no other code page to fall back on."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    raw = F.col("content").cast("string")
    text = F.when(F.col("length") > max_bytes, F.raise_error(F.concat(F.lit("too large: "), "path"))).when(~F.call_function("is_valid_utf8", raw), F.raise_error(F.concat(F.lit("not UTF-8: "), "path"))).otherwise(raw)
    return files.select("path", text.cast("string").alias("text"))


def put(target: str, text: str, overwrite: bool) -> str:
    """Write a file whole or not at all, in two steps: aside, then into place; its status."""
    aside = os.path.join(os.path.dirname(target) or ".", f".{os.path.basename(target)}.{uuid.uuid4().hex}.part")
    if os.path.islink(target):
        return "exists" if not overwrite else "failed: it is a link"
    try:
        with os.fdopen(os.open(aside, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o644), "w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        if overwrite:
            os.replace(aside, target)
        else:
            os.link(aside, target)  # fails if anything is there
    except FileExistsError:
        return "exists"
    except (OSError, UnicodeEncodeError) as e:
        return f"failed: {getattr(e, 'strerror', None) or 'not UTF-8'}"
    finally:
        if os.path.lexists(aside):
            os.unlink(aside)
    return "written"


def write_masked_copies(df: DataFrame, overwrite: bool = False, root: str | None = None) -> DataFrame:
    """Write ``anonymized`` beside each local ``path`` as its masked copy; ``path, copy, status`` of each.

    A copy is there whole or not at all: a task that is lost half-way leaves none, and the next one writes it. Without
    ``overwrite`` one that is there, a link too, is left alone and reported as ``exists`` (so does a task that runs
    again after its copy was made). With ``root``, copies that would lie outside of that folder are ``outside``.
    Rows are handled one by one, so one failure does not stop the rest.
    """
    base = os.path.realpath(root) if root else None

    def one(copy: str, text: str | None) -> str:
        local = copy.removeprefix("file:").replace("//", "/")
        folder = os.path.realpath(os.path.dirname(local) or ".")
        if base and os.path.commonpath([folder, base]) != base:
            return "outside"
        return "no text" if text is None else put(local, text, overwrite)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [one(copy, text) for copy, text in zip(batch.column("copy").to_pylist(), batch.column("anonymized").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("copy"), pa.array(out, pa.string())], ["path", "copy", "status"])

    rows = df.select("path", masked_path(F.col("path")).alias("copy"), "anonymized")
    return rows.mapInArrow(run, "path string, copy string, status string")


def write_masked(df: DataFrame, path: str) -> None:
    """Only the rewritten text leaves the engine; existing output is never overwritten."""
    df.select("doc_id", "anonymized").write.mode("errorifexists").json(path)
