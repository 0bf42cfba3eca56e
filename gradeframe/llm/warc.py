"""WARC archives: writing, reading and revisit resolution.

``write_archives`` makes one response record per capture, ``resolve_revisits``
rewrites archives so that a payload is stored once, ``read_records`` reads them
back and ``resolved`` gives every record its full payload's size and digest.

Resolution shuffles only headers: per payload digest the record with the
smallest row id is the original, the others become revisit records that refer
to it, with fresh record headers. Payloads go straight from one archive to the
next; whether a record is a revisit is looked up by digest, and a digest that
most records have is split by adaptive execution.

Archives are gzip files of WARC/1.1 records, written by Spark's text writer (a
record ends in CR LF CR LF, of which the line separator is the last half) and
read as binary files, decompressed and parsed as a stream by record lengths.
So payloads may hold anything, separators and record headers too.

Cases: a NULL payload is empty. Payloads under ``least_bytes`` are always
responses. Of equal payloads all rows with the smallest id are responses. Rows
with a NULL id never are originals; without any other row they are all
responses. CR and LF in a URL are percent-encoded; a NULL URL is written as an
empty one. Archives without records read as an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeframe.llm.common import staged

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = ("record_type string, record_id string, row_id string, uri string, date string, digest string, "
           "payload_bytes long, refers_to_row string, refers_to string, payload binary")
_BATCH_BYTES = 8_000_000


def _record(rows: DataFrame) -> Column:
    """A record's bytes without the last CR LF.

    ``rows`` has row_id, uri, date, digest, payload, and of the record it
    repeats, if any: original_row, original_id, original_uri, original_date.
    """
    revisit = F.col("original_row").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.coalesce(F.col("payload").cast("string"), F.lit(""))))
    fields = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", F.col("record_id")),
        ("WARC-Target-URI", F.coalesce("uri", F.lit(""))),
        ("WARC-Date", F.col("date")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        ("WARC-Profile", F.when(revisit, PROFILE)),
        ("WARC-Refers-To", F.col("original_id")),
        ("WARC-Refers-To-Target-URI", F.col("original_uri")),
        ("WARC-Refers-To-Date", F.col("original_date")),
        ("X-Refers-To-Row-ID", F.col("original_row")),
        ("X-Row-ID", F.col("row_id")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length("block").cast("string")),
    ]
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in fields]
    return rows.withColumn("block", block).select(
        F.concat(F.lit(f"WARC/1.1{CRLF}"), *lines, F.lit(CRLF), F.col("block"), F.lit(CRLF)).alias("value"))


def _fresh_id(salt: str, prefix: str = "") -> Column:
    """A record id made from what the record holds, so that a repeated task writes the same one."""
    held = [f"{prefix}row" if prefix else "row_id", "digest", f"{prefix}uri", f"{prefix}date"]
    h = F.md5(F.concat_ws("\u0001", F.lit(salt), *held).cast("binary"))
    parts = [F.substring(h, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _written(rows: DataFrame, path: str, records_per_file: int) -> None:
    _record(rows).write.option("lineSep", CRLF).option("compression", "gzip") \
        .option("maxRecordsPerFile", records_per_file).text(path)


def write_archives(
    captures: DataFrame, path: str, id_col: str, url_col: str, payload_col: str, date: Column,
    records_per_file: int = 5000,
) -> None:
    """One response record per row."""
    url = F.replace(F.replace(F.col(url_col), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = captures.select(
        F.col(id_col).cast("string").alias("row_id"), url.alias("uri"),
        F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("record_id", _fresh_id("captured"))
    none = F.lit(None).cast("string")
    rows = rows.withColumns({f"original_{n}": none for n in ("row", "id", "uri", "date")})
    _written(rows, path, records_per_file)


def _records(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Header fields and block of each record of one archive, gzipped (in one or many members) or plain."""
    buffer, at = bytearray(), 0
    view = memoryview(data)
    pos = 0
    inflate = zlib.decompressobj(wbits=31) if data[:2] == b"\x1f\x8b" else None

    def more() -> bool:
        nonlocal pos, inflate, at, buffer
        if at:
            del buffer[:at]
            at = 0
        if inflate is None:
            chunk, pos = view[pos:pos + 1_000_000], pos + 1_000_000
            buffer += chunk
            return bool(len(chunk))
        while pos < len(view) or inflate.unconsumed_tail:
            if inflate.eof:
                inflate = zlib.decompressobj(wbits=31)
            source = inflate.unconsumed_tail or bytes(view[pos:pos + 262_144])
            if not inflate.unconsumed_tail:
                pos += len(source)
            out = inflate.decompress(source, 4_000_000)
            if inflate.eof and inflate.unused_data:
                pos -= len(inflate.unused_data)
            buffer += out
            if out:
                return True
        return False

    while True:
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if bytes(buffer[at:]).strip():
                    raise ValueError("an archive ends within a record header")
                return
        lines = bytes(buffer[at:end]).split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {}
        for line in lines[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields[b"content-length"])
        at = end + 4
        while len(buffer) - at < size + 4:
            if not more():
                raise ValueError("an archive ends within a record")
        block = bytes(buffer[at:at + size])
        at += size + 4
        yield fields, block


def _parsed(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _RECORD.split(", ")]
    types = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for fields, block in _records(content.as_py()):
                def text(name: bytes) -> str | None:
                    return fields[name].decode("utf-8", "surrogateescape") if name in fields else None

                kind = text(b"warc-type")
                payload = block
                if fields.get(b"content-type", b"").startswith(b"application/http"):
                    payload = block.partition(b"\r\n\r\n")[2]
                if kind == "revisit":
                    digest, length = (text(b"warc-payload-digest") or "").removeprefix("sha256:"), None
                else:
                    digest, length = hashlib.sha256(payload).hexdigest(), len(payload)
                rows.append((kind, text(b"warc-record-id"), text(b"x-row-id"), text(b"warc-target-uri"),
                             text(b"warc-date"), digest, length, text(b"x-refers-to-row-id"), text(b"warc-refers-to"),
                             payload if payloads else None))
                size += len(payload) if payloads else 200
                if size > _BATCH_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below a path. Digests of responses are those of the payloads as read."""
    def run(batches):
        return _parsed(batches, payloads)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _RECORD)


def _first(order: Column) -> list[Column]:
    """The response with the smallest id, as an aggregate."""
    found = F.struct(order.alias("order"), "row_id", "uri", "date")
    return [F.min(F.when(order.isNotNull(), found)).alias("o"), F.count(F.lit(1)).alias("n")]


def resolve_revisits(
    spark: SparkSession, source: str, target: str, id_type: str = "long", least_bytes: int = 100,
    records_per_file: int = 5000,
) -> None:
    """Rewrite archives so that of equal payloads only the first is stored and the others refer to it.

    Revisit records of the source stay revisits, of the original that their
    digest now has, whatever its size.
    """
    order = F.col("row_id").cast(id_type)
    headers = staged(read_records(spark, source, payloads=False), "headers")
    responses = headers.where("record_type = 'response'")
    repeated = responses.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(*_first(order)).where("n > 1")
    asked = headers.where("record_type = 'revisit'").select("digest").distinct()
    named = responses.join(asked, "digest", "left_semi").groupBy("digest").agg(*_first(order))
    originals = repeated.unionByName(named).where("o is not null").dropDuplicates(["digest"]).select(
        "digest", F.col("o.row_id").alias("original_row"), F.col("o.uri").alias("original_uri"),
        F.col("o.date").alias("original_date"))
    rows = read_records(spark, source).where("record_type in ('response', 'revisit')") \
        .join(staged(originals, "originals"), "digest", "left")
    # What revisits refer to are the originals' records as they are written now.
    rows = rows.withColumn("record_id", _fresh_id("resolved")).withColumn("original_id", _fresh_id("resolved", "original_"))
    other = (F.col("record_type") == "revisit") | ~F.col("row_id").eqNullSafe(F.col("original_row"))
    is_revisit = F.col("original_row").isNotNull() & other
    rows = rows.withColumn("is_revisit", is_revisit).withColumns(
        {f"original_{n}": F.when(F.col("is_revisit"), F.col(f"original_{n}")) for n in ("row", "id", "uri", "date")})
    _written(rows, target, records_per_file)


def resolved(records: DataFrame) -> DataFrame:
    """row_id, payload_bytes, payload_digest, record_type and refers_to of records, revisits joined to their originals."""
    plain = records.select("row_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type",
                           F.col("refers_to_row").alias("refers_to"))
    responses = plain.where("record_type = 'response'")
    sizes = responses.groupBy("payload_digest", F.col("row_id").alias("refers_to")) \
        .agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = plain.where("record_type = 'revisit'").drop("payload_bytes").join(
        staged(sizes, "sizes"), ["payload_digest", "refers_to"], "left")
    return responses.unionByName(revisits)
