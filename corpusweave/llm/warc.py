"""WARC archives: writing them, reading them back, and assembling transactions.

Every page becomes three records of one capture: the response (or a revisit,
if another page carries the same payload and is the one stored), the request
and a metadata record. Request and metadata name the response or revisit in
WARC-Concurrent-To; the reader joins the three on that identifier and emits
one nested row per capture. Of equal payloads the page with the largest id is
stored as the response; the others are revisits that name its digest.

Digests are aggregated before anything is joined (one narrow row per digest),
and the pages join that table once; a digest with a third of all pages is
split by the adaptive skew join, since no window or group ever holds its rows.
The archives are written by Spark's text writer, whose line separator is the
record separator of the format, at most ``FILE_RECORDS`` captures a file, so
lost executors leave no half-written files; a file is gzip-compressed.

Defined results: a null html is an empty payload; a null url is written as
"unknown:"; a null id stays null; rows with the same id and payload are
captures of their own (all responses if the id is the largest). Empty tables
give no captures. Extra columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import islice, starmap

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Captures in one archive file at most.
FILE_RECORDS = 1000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DATE = "2020-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: the 160 bits as 8 groups of 20, each 4 digits of 5 bits."""
    sha = F.sha1(payload)
    digits = []
    for i in range(8):
        group = F.conv(F.substring(sha, 5 * i + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(_BASE32), F.shiftright(group, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def _record_id(kind: str) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.col("id").cast("string"), F.col("_row").cast("string")))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"),
                    part(21, 12), F.lit(">"))


def _record(kind: Column | str, record_id: Column, block: Column, *headers: tuple[str, Column]) -> Column:
    """Header and block of a record, without the two line ends after it."""
    named = [("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(_DATE)), *headers,
             ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in named]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), block)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least_bytes: int = 0) -> None:
    """Write ``pages`` as archives below ``path``; payloads shorter than ``least_bytes`` never become revisits."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.regexp_replace(url_col, r"[\x00-\x20]", "%20"), F.lit("unknown:")).alias("url"),
                        html.alias("html"), base32_sha1(html).alias("digest"))
    stored = rows.groupBy("digest").agg(F.max(F.struct("id", "url")).alias("first"))
    rows = rows.join(stored, "digest").withColumn("_row", F.monotonically_increasing_id())
    revisit = (F.octet_length("html") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("first.id"))
    kind, main = F.when(revisit, "revisit").otherwise("response"), _record_id("capture")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    only = lambda c: F.when(revisit, c)
    records = F.array(
        _record(kind, main, F.concat(http, F.when(revisit, "").otherwise(F.col("html"))),
                ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
                ("WARC-Profile", only(F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
                ("WARC-Refers-To-Target-URI", only(F.col("first.url"))), ("WARC-Refers-To-Date", only(F.lit(_DATE))),
                ("Content-Type", F.lit("application/http; msgtype=response"))),
        _record("request", _record_id("request"), F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n")),
                ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http; msgtype=request"))),
        _record("metadata", _record_id("metadata"), F.concat(F.lit("pageId: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\n")),
                ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))))
    (rows.select(F.explode(records).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 3 * FILE_RECORDS).text(path))


_RECORD = (
    "type string, record_id string, concurrent_to string, target_uri string, refers_to_uri string, payload_digest string, "
    "block_bytes long, payload_bytes long, payload binary, fields string")


def parse(archive: bytes):
    """The records of one archive, as (headers, block) pairs."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        at = start + int(headers["Content-Length"])
        yield headers, archive[start:at]
        if archive[at:at + 4] != b"\r\n\r\n":
            raise ValueError(f"no end of record at byte {at}")
        at += 4


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record below ``path``. Payloads of responses are checked against their digests."""
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(spark.createDataFrame([], _RECORD).schema)

    def row(headers, block):
        """The values of a record, in the schema's order."""
        kind, digest = headers["WARC-Type"], headers.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
        size = payload = fields = None
        if kind == "response":
            body = block[block.index(b"\r\n\r\n") + 4:]
            if base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                raise ValueError(f"{headers['WARC-Record-ID']}: the payload does not match its digest")
            size, payload = len(body), body if with_payload else None
        elif kind == "metadata":
            fields = block.decode()
        return (kind, headers["WARC-Record-ID"], headers.get("WARC-Concurrent-To"), headers.get("WARC-Target-URI"),
                headers.get("WARC-Refers-To-Target-URI"), digest, len(block), size, payload, fields)

    def run(batches):
        import zlib

        import pyarrow as pa
        for batch in batches:
            for content in batch.column(0):
                packed = content.as_buffer()
                if not len(packed):
                    continue
                records = starmap(row, parse(zlib.decompress(packed, 31)))
                while some := list(islice(records, 1000)):
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*some), schema)], schema=schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, _RECORD)


def assemble(records: DataFrame, id_type: str = "long") -> DataFrame:
    """One nested row per capture: page id, response or revisit, request, metadata, and what a revisit refers to."""
    main = records.where("type IN ('response', 'revisit')").select(
        F.col("record_id").alias("_id"), F.struct("type", "record_id", "target_uri", "refers_to_uri", "payload_digest", "payload_bytes", "payload").alias("response"))
    request = records.where("type = 'request'").select(F.col("concurrent_to").alias("_id"), F.struct(
        "record_id", "target_uri", "block_bytes").alias("request"))
    page = F.nullif(F.regexp_extract("fields", r"pageId: ([^\r\n]*)", 1), F.lit("")).cast(id_type)
    metadata = records.where("type = 'metadata'").select(F.col("concurrent_to").alias("_id"), page.alias("page_id"), F.struct(
        "record_id", "fields").alias("metadata"))
    captures = main.join(request, "_id", "left").join(metadata, "_id", "left").drop("_id")
    stored = captures.where("response.type = 'response'").groupBy(F.col("response.payload_digest").alias("_digest")).agg(
        F.max("page_id").alias("_page"), F.max("response.payload_bytes").alias("_bytes"))
    revisit = F.col("response.type") == "revisit"
    return captures.join(stored, F.col("response.payload_digest") == F.col("_digest"), "left").select(
        "page_id", "response", "request", "metadata",
        F.coalesce("response.payload_bytes", F.when(revisit, F.col("_bytes"))).alias("payload_bytes"),
        F.when(revisit, F.col("_page")).alias("refers_to"))
