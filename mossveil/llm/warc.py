"""WARC archives: writing captures as records, and assembling the records read back into one row per capture.

A capture is three records: a response (or a revisit of an equal payload), its request, and its metadata, of which
the latter two name the first in WARC-Concurrent-To. Spark's text writer puts the records into files, with the
empty lines that end a record as its separator, so gzipped files appear by Spark's commit protocol in any store.
The reader takes whole files and follows each record's Content-Length, whatever its payload holds; so the writer
deals pages to as many files as keep one at FILE_BYTES in the mean. A file is one gzip member, not one a record.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mossveil.llm.common import saved, slices

CRLF = "\r\n"
#: Digits of Spark's conv() in base 32 and the base-32 alphabet of RFC 4648.
CONV_DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Files are read whole, so they hold so many bytes in the mean, and so many records (three a capture) at most.
FILE_BYTES, FILE_RECORDS = 16 << 20, 30_000
#: Bytes of the headers of a page's three records, for that sum.
HEADERS = 1500


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1: 40 hex digits are four times 10, each of which gives 8 of base 32."""
    hexa = F.sha1(payload)
    eights = [F.lpad(F.conv(F.substring(hexa, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*eights)), CONV_DIGITS, BASE32)


def record(kind: str | Column, record_id: Column, headers: dict[str, Column], content_type: str, block: Column) -> Column:
    """One WARC record up to the end of its block; headers whose value is null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    fields = {"WARC-Type": kind, "WARC-Record-ID": F.concat(F.lit("<urn:uuid:"), record_id, F.lit(">")), **headers, "Content-Type": F.lit(content_type), "Content-Length": F.octet_length(block).cast("string")}
    # concat is null where the value is, and concat_ws leaves nulls out.
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields.items()]
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines), F.lit(CRLF * 2), block)


def uuid_of(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def write_warc(pages: DataFrame, folder: str, dedup_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``pages`` (``page_id, url, html``) to ``folder``; other columns play no part.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of at least ``dedup_bytes`` bytes that of the
    smallest ``page_id`` (nulls last) is a response and the others are revisits without payload, which name the
    response's URI; rows that repeat the smallest ``page_id`` are responses too. Payloads meet by their digests in
    rows without html: first pages are found by a grouped minimum, and joined back by a join of its own shuffles, so
    that the adaptive skew join can split a digest that very many pages share. The html is shuffled once, by page.
    An empty table writes no record; a single page has to fit a row.
    """
    spark = pages.sparkSession
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", base32_sha1(F.encode("html", "UTF-8"))).withColumn("bytes", F.octet_length("html").cast("long"))
    p = p.withColumn("row_key", F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "digest"))
    slim = saved(p.select("row_key", "page_id", "digest", "bytes", "url"), "digests")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("pages"))
    first = saved(first.where("pages > 1").drop("pages"), "firsts")
    later = F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull())
    revisits = slim.where(F.col("bytes") >= dedup_bytes).join(first, "digest").where(later).select("row_key", "first", "first_url", F.lit(True).alias("revisit")).distinct()
    total = slim.agg(F.sum("bytes"), F.count("*")).first()
    files = max(1, -(-((total[0] or 0) + HEADERS * total[1]) // FILE_BYTES), min(spark.sparkContext.defaultParallelism, total[1]))
    p = p.repartition(files, "row_key").join(revisits, "row_key", "left").withColumn("revisit", F.coalesce("revisit", F.lit(False)))
    # Drawn once a row and used by its three records, which are written in the same task.
    p = p.withColumn("salt", F.uuid())
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    clean = F.translate("url", "\r\n\t ", "")
    refers = F.when(F.col("revisit"), F.translate("first_url", "\r\n\t ", ""))
    common = {"WARC-Date": F.lit(date), "WARC-Target-URI": clean}
    rid = {k: uuid_of(F.lit(k), page, F.col("salt")) for k in ("capture", "request", "metadata")}
    link = {"WARC-Concurrent-To": F.concat(F.lit("<urn:uuid:"), rid["capture"], F.lit(">"))}
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    digest = F.concat(F.lit("sha1:"), "digest")
    capture = record(
        F.when(F.col("revisit"), "revisit").otherwise("response"),
        rid["capture"],
        {**common, "WARC-Payload-Digest": digest, "WARC-Refers-To-Target-URI": refers, "WARC-Refers-To-Date": F.when(F.col("revisit"), date), "WARC-Profile": F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")},
        "application/http; msgtype=response",
        F.concat(head, F.when(F.col("revisit"), "").otherwise(F.col("html"))),
    )
    host = F.regexp_extract(clean, "^[A-Za-z]+://([^/?#]*)", 1)
    path = F.concat(F.lit("/"), F.regexp_extract(clean, "^[A-Za-z]+://[^/?#]*/?([^#]*)", 1))
    request = record("request", rid["request"], {**common, **link}, "application/http; msgtype=request", F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2)))
    fields = F.concat_ws(CRLF, F.concat(F.lit("pageId: "), F.col("page_id").cast("string")), F.concat(F.lit("payloadBytes: "), F.col("bytes").cast("string")), F.concat(F.lit("refersToPage: "), F.when(F.col("revisit"), F.col("first").cast("string"))))
    metadata = record("metadata", rid["metadata"], {**common, **link}, "application/warc-fields", F.concat(fields, F.lit(CRLF)))
    files = p.select(F.explode(F.array(capture, request, metadata)).alias("value"))
    files.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(folder)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers (names in lower case) and block of each record.

    A record whose Content-Length is missing, no number, or beyond the end of the file is left out; reading goes on at
    the next line that begins a record.
    """
    view, at = memoryview(content), 0
    while (start := content.find(b"WARC/1.", at)) >= 0:
        end = content.find(b"\r\n\r\n", start)
        lines = content[start:end].decode("utf-8", "replace").split(CRLF)[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = headers.get("content-length", "")
        size = int(length) if length.isascii() and length.isdigit() else -1
        if end < 0 or size < 0 or end + 4 + size > len(content):
            following = content.find(b"\nWARC/1.", start + 1)
            if following < 0:
                return
            at = following + 1
            continue
        yield headers, view[end + 4 : end + 4 + size]
        at = end + 4 + size


def inflated(content: bytes) -> bytes:
    """The bytes of a file, of all gzip members if it is one; of a damaged one what comes before the damage."""
    out, rest = [], content
    while rest[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            for at in range(0, len(rest), 1 << 16):
                out.append(member.decompress(rest[at : at + (1 << 16)]))
                if member.eof:
                    rest = member.unused_data + rest[at + (1 << 16) :]
                    break
            else:
                break
        except zlib.error:
            break
    return b"".join(out) if content[:2] == b"\x1f\x8b" else content


RECORDS = "kind string, record_id string, concurrent_to string, uri string, date string, digest string, payload_bytes long, payload binary, fields map<string,string>"


def read_records(spark: SparkSession, folder: str, payload: bool = True, files: str = "part-*") -> DataFrame:
    """One row per record: RECORDS. The digest of a response is computed from the payload that is there.

    Archives of others can be read too (``files``: their names, e.g. ``*.warc.gz``). Records without a type have a
    null ``kind``, those without a readable length are left out, and a damaged gzip file gives what comes before the
    damage. A file has to fit a task; an empty folder or file gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))])
        for whole in batches:
            for batch in slices(whole):
                for content in batch.column("content"):
                    content, rows, held = content.as_py(), [], 0
                    for headers, block in parse_warc(inflated(content)):
                        kind, body, digest, size, fields = headers.get("warc-type"), None, None, None, None
                        if kind == "metadata":
                            fields = [tuple(s.strip() for s in x.split(":", 1)) for x in bytes(block).decode("utf-8", "replace").split(CRLF) if ":" in x]
                        elif kind == "response":
                            data = bytes(block)
                            data = data[data.find(b"\r\n\r\n") + 4 :]
                            digest, size, body = base64.b32encode(hashlib.sha1(data).digest()).decode(), len(data), data if payload else None
                        elif kind == "revisit":
                            digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                        rows.append({"kind": kind, "record_id": headers.get("warc-record-id"), "concurrent_to": headers.get("warc-concurrent-to"), "uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"), "digest": digest, "payload_bytes": size, "payload": body, "fields": fields})
                        held += 2000 + (len(block) if payload else 0)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    found = spark.read.format("binaryFile").option("pathGlobFilter", files).load(folder).select("content")
    return found.mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id`` and structs ``capture, request, metadata`` (null where missing).

    Requests and metadata meet their capture by its record id, in one shuffle of all records. Of several requests
    or metadata records of a capture the one with the smallest record id is taken; records that name no capture
    present are dropped, and so are those of another or no kind. Repeated records count once; no records give no rows.
    """
    cols = ["kind", "record_id", "uri", "date", "digest", "payload_bytes", "payload", "fields"]
    is_capture = F.col("kind").isin("response", "revisit")
    keyed = records.select(F.when(is_capture, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("capture_id"), F.struct(*cols).alias("r"), "kind", "record_id").where("capture_id IS NOT NULL")
    pick = lambda kinds: F.min_by(F.when(F.col("kind").isin(*kinds), F.col("r")), F.when(F.col("kind").isin(*kinds), F.col("record_id")))
    return keyed.groupBy("capture_id").agg(pick(["response", "revisit"]).alias("capture"), pick(["request"]).alias("request"), pick(["metadata"]).alias("metadata")).where("capture IS NOT NULL")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda k: list_reduce(list_transform(range(1, 6), lambda j: strpos('0123456789abcdef', substr(x, (5 * k + j)::INT, 1)) - 1), lambda a, b: a * 16 + b)) AS q FROM d),
e AS (SELECT page_id, payload_bytes, array_to_string(list_transform(q, lambda n: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> s) & 31)::INT + 1, 1)), '')), '') AS payload_digest FROM v),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM e)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
