"""WARC (8): archives are written and read, and transactions are assembled.

Each capture is a request, a response (or revisit) and a metadata record. Request and metadata name the response's record id as
WARC-Concurrent-To; reading joins the records on it into one nested row per capture. Archives are gzipped WARC/1.1 files that
Spark's text writer makes, with the two line ends after a record as its line separator, so that any file system will do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkwise.llm import common

#: Records of one archive at most, so that a reader holds a bounded file.
RECORDS_PER_FILE = 1500
EOL = "\r\n"
# The alphabet of base32.
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DATE = "2020-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a string's UTF-8 as upper-case base32: 20 bits, or 5 hex digits, give 4 characters."""
    digits = F.sha1(F.encode(payload, "UTF-8"))
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: F.conv(F.substring(digits, g * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    chars = F.transform(groups, lambda v: F.concat(*[F.substring(F.lit(_ALPHABET), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]))
    return F.array_join(chars, "")


def _uuid(kind: str, *of: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in of]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in headers]
    head = F.concat_ws(EOL, F.lit("WARC/1.1"), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head, F.lit(EOL * 2), block)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with __html, __digest, __id and __refers: the id of the response that a revisit repeats, else null.

    Of equal payloads of min_bytes at least, the one with the smallest page_id (then url) is the response; nulls come last.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("__html")).withColumn("__digest", base32_sha1(F.col("__html")))
    of = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    p = p.withColumn("__of", of)
    first = p.filter(F.octet_length("__html") >= min_bytes).groupBy("__digest").agg(F.min("__of").alias("__first"))
    p = p.join(first, "__digest", "left")
    p = p.withColumn("__refers", F.when(F.col("__first") != F.col("__of"), _uuid("response", F.col("__first.page_id"), F.col("__first.url"), F.col("__digest"))))
    return p.withColumn("__id", _uuid("response", F.col("page_id"), F.col("url"), F.col("__digest"))).drop("__of", "__first")


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One string column, `value`: the WARC records of all pages, three for each."""
    p = with_revisits(pages, min_bytes)
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    target, date, html = ("WARC-Target-URI", uri), ("WARC-Date", F.lit(_DATE)), F.col("__html")
    ident, refers = F.col("__id"), F.col("__refers")
    status = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.octet_length(html).cast("string"), F.lit(EOL * 2))
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("__digest")))
    main = F.when(refers.isNull(), _record([("WARC-Type", F.lit("response")), ("WARC-Record-ID", ident), date, target, digest, http], F.concat(status, html)))
    main = main.otherwise(_record([("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", ident), date, target, digest, ("WARC-Refers-To", refers), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), http], status))
    ask = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{EOL * 2}"))
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", _uuid("request", ident)), date, target, ("WARC-Concurrent-To", ident), ("Content-Type", F.lit("application/http; msgtype=request"))], ask)
    fields = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(EOL))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _uuid("metadata", ident)), date, target, ("WARC-Concurrent-To", ident), ("Content-Type", F.lit("application/warc-fields"))], fields)
    return p.select(F.explode(F.array(request, main, metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """A null html counts as empty, a null url gives no target header; repeated rows are written as often; other columns are left out."""
    out = records(pages, min_bytes).write.option("lineSep", EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE)
    out.text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record; stops at what isn't a record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            return
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers.get("content-length", 0)))


RECORD = common.fields("type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes bigint, sound boolean, fields string, payload string")


def read_records(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of all archives of a folder. payload_bytes counts the HTTP body; sound: it has the digest that its header names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(RECORD)
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for batch in batches:
            for content in batch.column(0):
                rows = []
                with io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer()))) as stream:
                    for h, block in parse(stream):
                        kind, body = h.get("warc-type"), block
                        if "application/http" in h.get("content-type", ""):
                            body = block.partition(b"\r\n\r\n")[2]
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        sound = base64.b32encode(hashlib.sha1(body).digest()).decode() == digest if kind == "response" else None
                        rows.append((kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), digest, len(body), sound,
                                     block.decode("utf-8", "replace") if kind == "metadata" else None, body.decode("utf-8", "replace") if payload and kind == "response" else None))
                        if len(rows) == 512:
                            yield make(rows)
                            rows = []
                if rows:
                    yield make(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, copies, response, request, metadata.

    Records meet by concurrent-to identifiers (a response or revisit by its own id). Of several requests or metadata records of
    one capture, the one with the smallest id stays, and `copies` counts how often the capture itself was written. Records that
    are concurrent to none that was found give no capture.
    """
    main = F.col("type").isin("response", "revisit")
    whole = F.struct("record_id", "type", "refers_to", "target_uri", "payload_digest", "payload_bytes", "sound", "fields", "payload")
    out = found.withColumn("__capture", F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to"))).groupBy("__capture")
    pick = lambda kind: F.min(F.when(kind, whole))
    out = out.agg(F.count(F.when(main, 1)).alias("copies"), pick(main).alias("response"), pick(F.col("type") == "request").alias("request"), pick(F.col("type") == "metadata").alias("metadata"))
    return out.filter("copies > 0").withColumnRenamed("__capture", "record_id")


def captures(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    return assemble(read_records(spark, path, payload))


def page_id_of(metadata: Column) -> Column:
    return F.regexp_extract(metadata, r"page_id: (-?[0-9]+)", 1).try_cast("bigint")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "warc")
    write_archives(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"), path, min_bytes=0)
    read = captures(spark, path)
    read = read.select("record_id", "copies", page_id_of(F.col("metadata.fields")).alias("page_id"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("refers"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.sound").alias("sound"))
    read = common.stored(read, "captures")
    first = read.filter("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("whole"))
    out = read.join(first, "refers", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return out.select("page_id", F.coalesce("whole", "payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", F.coalesce("sound", F.lit(True)).alias("sound"))


def _sql_base32(digits: str) -> str:
    bits = lambda g, s: f"substr('{_ALPHABET}', 1 + ((('0x' || substr({digits}, {5 * g + 1}, 5))::BIGINT >> {s}) & 31)::INTEGER, 1)"
    return " || ".join(bits(g, s) for g in range(8) for s in (15, 10, 5, 0))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_sql_base32("x")} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS sound
FROM f
"""
