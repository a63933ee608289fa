"""WARC archives with revisit resolution.

Headers (page, payload digest, payload length) are grouped by digest: of records with equal payloads
of at least MIN_BYTES bytes the one with the largest page_id keeps its response, the others become
revisit records that refer to it. Only headers are shuffled; which pages are revisits goes back to the
payloads by broadcast while that is at most a million rows, and by a join beyond. The archives are
written with fresh headers by Spark's own writer (each row one record, CRLF CRLF between records, gzip,
the file one gzip member), so any file system and committer serves and a lost executor's files are
written again. A file holds at most FILE_BYTES of payload, or one record: payloads above LARGE_BYTES get
files of their own kind, with fewer records. Reading parses by Content-Length, recomputes digests, and
joins revisit records to the responses they refer to.

A record's id is made of page_id and payload digest: pages that repeat an id with other payloads have ids of
their own, rows that repeat both are the same record twice.

A null html is an empty payload; empty and short payloads are always responses. All rows that bear
the largest page_id of their payload are responses, so repeated rows stay repeated; a null page_id
never is the largest. A null url becomes about:blank. Empty tables give empty archives. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, own_folder, sent, small_arrow_batches

MIN_BYTES, PER_FILE, LARGE_BYTES, FILE_BYTES = 1000, 2000, 1 << 18, 1 << 29
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = "page_id long, record_id string, record_type string, refers_to_record string, payload_bytes long, payload_digest string"


def resolve_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> tuple[DataFrame, int]:
    """(page_id, payload_digest, refers_to) for each page whose payload a page with a larger page_id keeps; the longest payload."""
    payload = F.coalesce("html", F.lit(""))
    headers = cut(pages.select("page_id", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(F.encode(payload, "UTF-8")).alias("payload_digest")), "headers")
    longest = headers.agg(F.max("payload_bytes").alias("n")).first()["n"] or 0
    headers = headers.where(F.col("payload_bytes") >= min_bytes)
    keepers = headers.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    # written before it is joined, so that a payload that very many pages share can be split
    revisits = headers.join(cut(keepers, "keepers"), "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return cut(revisits.select("page_id", "payload_digest", "refers_to").distinct(), "revisits"), longest


def record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = "2025-01-01T00:00:00Z", per_file: int = PER_FILE, large: int = LARGE_BYTES) -> None:
    """Write one record per row of pages(page_id, url, html) under path."""
    payload = F.coalesce("html", F.lit(""))
    revisits, longest = resolve_revisits(pages, min_bytes)
    revisits = revisits.select(F.col("page_id").alias("of"), F.col("payload_digest").alias("of_digest"), "refers_to")
    own = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    rows = own.join(sent(revisits), F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left")
    revisit = F.col("of_digest").isNotNull()
    body = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\r\n]+", " ")
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("digest"))),
        F.concat(F.lit("X-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to"), F.col("digest")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *head), F.lit("\r\n\r\n"), body)
    kinds = [(F.octet_length("payload") <= large, per_file)]
    if longest > large:
        kinds.append((F.octet_length("payload") > large, max(1, min(per_file, FILE_BYTES // longest))))
    for kind, most in kinds:
        rows.where(kind).select(record.alias("value")).write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


class _Inflated:
    """Buffered reads over gzip members held in memory; inflates as it goes."""

    def __init__(self, data: bytes):
        self.raw, self.at, self.z, self.buffer = memoryview(data), 0, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        while self.at < len(self.raw):
            if self.z.eof:
                self.at -= len(self.z.unused_data)
                self.z = zlib.decompressobj(31)
                continue
            piece = self.raw[self.at : self.at + 65536]
            self.at += len(piece)
            if got := self.z.decompress(piece):
                self.buffer += got
                return True
        return False

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        got = bytes(self.buffer[:n])
        del self.buffer[:n]
        return got

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (i := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark) + 1)
            if not self.more():
                return None
        got = self.take(i + len(mark))
        return got[:i]


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one gzipped archive."""
    f = _Inflated(data)
    while (head := f.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:60]!r}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = f.take(n := int(headers["Content-Length"]))
        if len(block) != n or f.take(4) != b"\r\n\r\n":
            raise ValueError(f"a record of {n} bytes ends early")
        yield headers, block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record under path."""
    small_arrow_batches(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in PARSED.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for h, block in records(data.as_py()):
                    told = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    page = int(h["X-Page-ID"]) if h["X-Page-ID"] else None
                    if h["WARC-Type"] == "revisit":
                        rows.append((page, h["WARC-Record-ID"], "revisit", h["WARC-Refers-To"], None, told))
                        continue
                    payload = block.partition(b"\r\n\r\n")[2]
                    if (digest := hashlib.sha1(payload).hexdigest()) != told:
                        raise ValueError(f"page {page}: payload digest {digest}, header {told}")
                    rows.append((page, h["WARC-Record-ID"], "response", None, len(payload), digest))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    found = cut(files.mapInArrow(parse, PARSED), "records")
    responses = found.where("record_type = 'response'")
    originals = responses.groupBy(F.col("record_id").alias("refers_to_record"), "payload_digest").agg(F.max("page_id").alias("original"), F.max("payload_bytes").alias("original_bytes"))
    revisits = found.where("record_type = 'revisit'").drop("payload_bytes").join(originals, ["refers_to_record", "payload_digest"], "left")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).union(
        revisits.select("page_id", F.col("original_bytes"), "payload_digest", "record_type", F.col("original"))
    )


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write pages to deduplicated archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = own_folder(spark, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(spark, path)


WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN keeper IS NULL OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper IS NULL OR page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM p LEFT JOIN k ON p.payload_digest = k.payload_digest AND p.payload_bytes >= 1000
"""
