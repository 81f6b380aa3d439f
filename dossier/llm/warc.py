"""WARC archives without repeated payloads: revisit resolution by payload digest.

Headers (page, length, digest) are grouped by digest with partial minima; the smallest page of each digest keeps its response
record, the others become revisit records that refer to it. Records are written with fresh headers to WARC/1.1 files in the
shared folder by Spark's text writer, whose line separator is the blank lines that end a record. Payloads are never shuffled.
Reading takes files as Spark's binary source gives them and cuts records by their Content-Length; revisits get the length of
their payload from the response by a join on the digest.

Null payloads are empty. Payloads of fewer than min_bytes are always responses. Every row with the smallest page_id of its digest
is a response; null page_ids are never the smallest, unless all are null. Repeated rows give repeated records. Payloads of any length
are written whole. An empty table gives empty archives. Other columns of the caller are not read, whatever their names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import materialize, new_path, utf8

#: Up to so many repeated digests are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 100_000
RECORDS_PER_FILE = 4000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve(pages: DataFrame, id_col: str, payload: Column, min_bytes: int) -> DataFrame:
    """pages with __digest, __bytes and __first, the page that keeps the payload; null where no other page has it."""
    headed = pages.withColumn("__digest", F.sha2(payload, 256)).withColumn("__bytes", F.octet_length(payload).cast("long"))
    first = headed.where(F.col("__bytes") >= min_bytes).groupBy("__digest").agg(F.min(F.col(id_col).cast("long")).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    first = materialize(first, "digests").withColumnRenamed("__digest", "__of")
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    return headed.join(first, F.col("__digest") == F.col("__of"), "left").drop("__of")


def name(id_: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit(">"))


def record(id_: Column, url: Column, payload_text: Column, date: str) -> Column:
    """The text of one record, without the blank lines at its end. Control characters and blanks in a URL are percent-coded."""
    revisit = F.col("__first").isNotNull() & ~F.coalesce(id_.cast("long") == F.col("__first"), F.lit(False))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    safe = F.replace(F.replace(F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20")), F.lit("\t"), F.lit("%09"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("__bytes").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("__bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(id_)),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", safe), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("__digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name(F.col("__first"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
    )
    return F.concat(head, F.when(revisit, "").otherwise(payload_text))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a WARC record for each row, under path."""
    text = F.coalesce(F.col(html_col), F.lit(""))
    out = resolve(pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), text.alias("__html")), "__id", utf8(F.col("__html")), min_bytes)
    rows = out.select(record(F.col("__id"), F.col("__url"), F.col("__html"), date).alias("value"))
    rows.write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def records(data: bytes | memoryview) -> Iterator[tuple[dict[str, str], memoryview]]:
    """The (headers, block) of each record of a WARC file."""
    data, at = memoryview(data), 0
    raw = bytes(data) if not isinstance(data.obj, bytes) else data.obj
    while at < len(data):
        end = raw.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in raw[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of all records under path; bytes and digest are of the full payload."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda s: None if s is None or s == "<urn:page:null>" else int(s[10:-1])
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for head, block in records(content.as_py()):
                    declared = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    revisit = head["WARC-Type"] == "revisit"
                    payload = block[bytes(block[:512]).index(b"\r\n\r\n") + 4 :]
                    rows.append((number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), None if revisit else len(payload), declared if revisit else hashlib.sha256(payload).hexdigest(), head["WARC-Type"], number(head.get("WARC-Refers-To"))))
                for i in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[i : i + 10_000], strict=True))
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").load(path).select("content")
    found = files.mapInArrow(parse, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
    found = materialize(found, "records")
    again = found.where("record_type = 'revisit'")
    lengths = found.where("record_type = 'response'").join(again.select("payload_digest").distinct(), "payload_digest", "left_semi").groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    resolved = again.drop("payload_bytes").join(lengths, "payload_digest", "left").select(*found.columns)
    return found.where("record_type = 'response'").unionByName(resolved)


def rewrite(pages: DataFrame, **options: int) -> DataFrame:
    """Writes the archives to the shared folder and reads them back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, **options)
    return read(spark, path)
