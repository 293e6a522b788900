"""WARC archives in which equal payloads are stored once.

Writing: headers (page, digest, length) without payloads are grouped by payload digest; in groups of long payloads the
record with the largest id stays a response, the others become revisit records that refer to it. The records, with fresh
headers, are written by Spark's text writer with the WARC record end as line end, so every part file is a plain WARC file
and lost tasks are written again under Spark's commit protocol. Reading: part files are read whole, one at a time, parsed
by Content-Length (payloads may hold anything, record ends included), responses are checked against their digests, and
revisits are joined to the responses they refer to.

Cases: a null payload counts as empty; payloads below ``least`` bytes are always responses; ids must be unique and not null
to be referred to (rows with a null id stay responses); repeated ids give repeated records. An empty table gives no
records. Other columns of the input are not read. Line ends in URLs are percent-encoded, a null URL is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import staged

LINE = "\r\n"
END = LINE + LINE
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def resolve(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``page_id, url, html`` with the payload's digest and length and ``refers_to``, the response of a revisit.

    Only headers of long payloads are grouped, with partial maxima before the shuffle; the few owners are staged, so both
    sides of the join come from an exchange and Spark can split a digest that very many pages share.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"),
        F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("n"),
    )
    long = rows.where((F.col("n") >= least) & F.col("page_id").isNotNull()).groupBy("digest", "n")
    owners = long.agg(F.max("page_id").alias("owner"), F.count("*").alias("copies")).where("copies > 1")
    joined = rows.join(staged(owners.drop("copies"), "owners"), ["digest", "n"], "left")
    revisit = F.col("owner").isNotNull() & (F.col("page_id") != F.col("owner"))
    return joined.select("page_id", "url", "html", "digest", "n", F.when(revisit, F.col("owner")).alias("refers_to"))


def _record_id(id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), id.cast("string"), F.lit(">"))


def records(resolved: DataFrame, date: str) -> DataFrame:
    """One string per WARC record, without the record end."""
    revisit = F.col("refers_to").isNotNull()
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat_ws(
        LINE,
        F.lit("WARC/1.1"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.coalesce(field("WARC-Record-ID", _record_id(F.col("page_id"))), F.lit("WARC-Record-ID: <urn:page:>")),
        F.lit(f"WARC-Date: {date}"),
        field("WARC-Target-URI", uri),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        field("WARC-Refers-To", _record_id(F.col("refers_to"))),
        F.lit("Content-Type: text/html"),
        field("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string")),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    return resolved.select(F.concat(head, F.lit(END), body).alias("value"))


def write_archives(pages: DataFrame, folder: str, least: int = 1000, date: str = "2024-01-01T00:00:00Z", per_file: int = 2000):
    """Write the archives below ``folder``; at most ``per_file`` records in a file, which bounds what a reader holds."""
    written = records(resolve(pages, least), date).write.option("lineSep", END).option("maxRecordsPerFile", per_file)
    written.text(folder)


def parse(content: bytes) -> Iterator[tuple]:
    """Records of one archive: page, type, digest, the page referred to, payload."""
    at, size = 0, len(content)
    while at < size:
        stop = content.index(END.encode(), at)
        lines = content[at:stop].decode().split(LINE)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        begin = stop + 4
        after = begin + int(head["Content-Length"])
        payload = content[begin:after]
        if content[after : after + 4] != END.encode():
            raise ValueError(f"the record at byte {at} has no end")
        at = after + 4
        page = lambda field: int(head[field][len("<urn:page:") : -1] or -1) if field in head else None
        id = page("WARC-Record-ID") if head["WARC-Record-ID"] != "<urn:page:>" else None
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"the payload of page {id} was damaged")
        yield id, head["WARC-Type"], digest, page("WARC-Refers-To"), payload


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records below ``folder``; a revisit's length is that of the response it refers to."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in READ_SCHEMA.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch[0]:
                rows, held = [], 0
                for id, kind, digest, owner, payload in parse(content.as_py()):
                    rows.append((id, kind, len(payload) if kind == "response" else None, digest, owner, payload))
                    held += len(payload)
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(task, READ_SCHEMA)


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """The records without payloads, each revisit with the length of its response's payload."""
    heads = staged(read_archives(spark, folder).drop("payload"), "headers")
    lengths = heads.where("record_type = 'response' and page_id is not null")
    lengths = lengths.select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("n")).distinct()
    revisits = heads.where("record_type = 'revisit'").join(lengths, ["refers_to", "payload_digest"], "left")
    responses = heads.where("record_type = 'response'")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(columns).unionByName(revisits.withColumn("payload_bytes", F.col("n")).select(columns))
