"""WARC archives with revisit records for payloads that occur again.

1. Each record is staged once with its payload's digest and a number of its own.
2. The headers (no payloads) are shuffled by payload digest; of equal payloads
   the record with the largest id is the original, and the others are joined to
   it: they become revisit records, which need no payload.
3. What is left, joined away by record number, is written with its payload as
   response records.  All headers are made afresh, record ids among them.

Archives are written by Spark's text sink: a record is a row, and the blank
lines that the format asks for between records are the line separator.  They
are read by its text source, with the beginning of a record as the separator.
An archive is one gzip stream, which Spark doesn't split, so a task sees the
pieces of a record in order; a payload that itself holds a record's beginning
is put together again by its content length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm.common import in_slices, stage

# Fixed values of the format.
VERSION, READ_VERSIONS = "WARC/1.1", "WARC/1."
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_FIELD = "X-Source-Id"  # an extension field: the record's id in the table that it comes from
LEAST_REVISIT = 1000  # bytes of payload; smaller ones are written whole
LONGEST_HEADER = 1 << 26  # bytes that a header may have; what goes on longer is no record


def quoted(value: Column, percent: bool) -> Column:
    """A header's value: line ends, which would end the header, as %0D and %0A; for ids % too, so that it can be undone."""
    value = value.cast("string")
    if percent:
        value = F.replace(value, F.lit("%"), F.lit("%25"))
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def unquoted(value: Column) -> Column:
    value = F.replace(F.replace(value, F.lit("%0D"), F.lit("\r")), F.lit("%0A"), F.lit("\n"))
    return F.replace(value, F.lit("%25"), F.lit("%"))


def resolved_headers(records: DataFrame, least: int) -> DataFrame:
    """row, id, url, digest, bytes, original (a struct of row, id and url): the records whose payload another record stands for.

    Headers only: originals are aggregated partially, then joined to the headers
    by digest.  A digest that a third of all records share is one row of the
    original's side and many small ones of the other, which Spark may split.
    """
    headers = records.filter(F.col("bytes") >= least).select("row", "id", "url", "digest", "bytes")
    # the largest id; of equal ones any, as nothing but the row number tells them apart
    best = F.max(F.struct("id", "row", "url")).alias("original")
    shared = headers.groupBy("digest", "bytes").agg(best, F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return headers.join(shared, ["digest", "bytes"]).filter("row != original.row").select(*headers.columns, "original")


def record_urn(row: Column, run: str) -> Column:
    """The same for a record however often its task runs: a UUID of its number and the run."""
    h = F.md5(F.concat(F.lit(run + ":"), row.cast("string")))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record as bytes in a string; fields that are null are left out."""
    named = [F.concat(F.lit(name + ": "), value.cast("string"), F.lit(CRLF)) for name, value in fields]
    lines = F.concat(F.lit(VERSION + CRLF), *(F.coalesce(x, F.lit("")) for x in named))
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF))
    return F.concat(lines, length, F.lit(CRLF), block)


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT, per_archive: int = 50_000,
                   id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write a record for each row of ``pages`` to archives under ``path``, each payload of ``least`` bytes or more once.

    Of equal payloads the record with the largest id is the response, the others
    revisit it; of records that share that id too, one is.  Null payloads are
    empty, strings are UTF-8; null ids and urls leave their field out (a null id
    is smaller than all others); repeated rows are records of their own; an
    empty table gives archives without records; other columns are ignored.
    Line ends in urls and ids are written as %0D and %0A.  An archive holds
    ``per_archive`` records at most and is one gzip stream.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    records = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    records = records.select(
        F.monotonically_increasing_id().alias("row"), "id", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    records = stage(records, "records")
    now = datetime.now(UTC)
    date = now.strftime("%Y-%m-%dT%H:%M:%SZ")
    run = f"{path}:{now.isoformat()}"
    revisits = stage(resolved_headers(records, least), "revisits")

    def fields(kind: str) -> list[tuple[str, Column]]:
        return [
            ("WARC-Type", F.lit(kind)), ("WARC-Record-ID", record_urn(F.col("row"), run)), ("WARC-Date", F.lit(date)),
            ("WARC-Target-URI", quoted(F.col("url"), percent=False)), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            (ID_FIELD, quoted(F.col("id"), percent=True)),
        ]

    # the header that the payload was sent with; a revisit keeps it and leaves out the payload
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    whole = records.join(revisits.select("row"), "row", "left_anti")
    responses = whole.select(_record([*fields("response"), http], F.concat(head, F.col("payload").cast("string"))).alias("value"))
    original = F.col("original")
    refers = [
        ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", record_urn(original["row"], run)),
        ("WARC-Refers-To-Target-URI", quoted(original["url"], percent=False)), ("WARC-Refers-To-Date", F.lit(date)),
    ]
    again = revisits.select(_record([*fields("revisit"), *refers, http], head).alias("value"))
    out = responses.unionByName(again)
    out.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_archive).text(path)


def _parsed(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    """Records of one task's archives, put together from pieces that begin like a record."""
    kinds = [("record_id", pa.string()), ("record_type", pa.string()), ("source_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
             ("digest_field", pa.string()), ("refers_to_record", pa.string()), ("http_length", pa.int64()), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string())] + ([("payload", pa.binary())] if with_payload else [])
    schema = pa.schema(kinds)
    mark = READ_VERSIONS.encode()
    held: list[bytes] = []  # pieces of a record that isn't whole yet
    have = need = 0

    def fields_of(head: bytes) -> dict[str, str]:
        out = {}
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            out.setdefault(name.strip().decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace"))
        return out

    def finished(record: bytes, fields: dict[str, str], begin: int, end: int) -> tuple:
        block, payload, length = record[begin:end], b"", None
        if fields.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            sent = fields_of(head).get("content-length")
            length = int(sent) if sent and sent.isdigit() else None
        else:
            payload = block
        row = (fields.get("warc-record-id"), fields.get("warc-type"), fields.get(ID_FIELD.lower()), fields.get("warc-target-uri"), fields.get("warc-date"),
               fields.get("warc-payload-digest"), fields.get("warc-refers-to"), length, len(payload), hashlib.sha1(payload).hexdigest())
        return (*row, payload) if with_payload else row

    for batch in batches:
        for part in in_slices([batch]):
            out = []
            for piece in part.column(0).to_pylist():
                if not held and not piece.strip(b"\r\n"):
                    continue  # before the first record of an archive
                if held:
                    held.append(mark)
                    have += len(mark)
                held.append(piece)
                have += len(piece)
                if have < need:
                    continue
                record = b"".join(held)
                at = record.find(b"\r\n\r\n")
                if at < 0 and have < LONGEST_HEADER:  # the header holds a record's beginning
                    held, need = [record], have + 1
                    continue
                if at < 0:
                    raise ValueError(f"no WARC record: {record[:80]!r}")
                fields = fields_of(record[:at])
                length = fields.get("content-length", "")
                if not length.isdigit():
                    raise ValueError(f"WARC record without a content length: {record[:80]!r}")
                begin, end = at + 4, at + 4 + int(length)
                if end + 4 > have:
                    held, need = [record], end + 4
                    continue
                if record[end:].strip(b"\r\n"):
                    raise ValueError(f"WARC record longer than its content length: {record[:80]!r}")
                out.append(finished(record, fields, begin, end))
                held, have, need = [], 0, 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(schema), schema)], schema=schema)
    if held:
        raise ValueError("the last WARC record is cut short")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the gzip archives (WARC 1.0 and 1.1) under ``path``, as they stand.

    record_id, record_type, source_id, target_uri, date, digest_field,
    refers_to_record, http_length (what the HTTP header says), payload_bytes and
    payload_digest (of the payload read) and, if asked for, the payload.  Fields
    that a record lacks are null.  Archives without records give no rows; a
    record that is cut short, or longer than it says, is an error.
    """
    pieces = spark.read.option("lineSep", READ_VERSIONS).text(path).select(F.col("value").cast("binary").alias("value"))
    schema = ("record_id string, record_type string, source_id string, target_uri string, date string, digest_field string, refers_to_record string, "
              "http_length long, payload_bytes long, payload_digest string") + (", payload binary" if with_payload else "")
    return pieces.mapInArrow(lambda batches: _parsed(batches, with_payload), schema)


def with_originals(records: DataFrame) -> DataFrame:
    """Records as read, each revisit joined to the response that it refers to.

    payload_bytes, payload_digest and, where present, the payload are the
    original's; refers_to is its source id, null for responses and for revisits
    whose original isn't there (those keep what their own fields say, without a
    payload).  Only revisits are joined, so many that refer to one response are
    a side that Spark may split; responses pass as they are.  Originals that are
    written more than once under one record id count once.
    """
    held = [c for c in records.columns if c == "payload"]
    revisits = records.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest", *held)
    asked = revisits.select(F.col("refers_to_record").alias("original")).distinct()
    originals = records.filter("record_type = 'response'").join(asked, F.col("record_id") == F.col("original"), "left_semi")
    originals = originals.dropDuplicates(["record_id"]).select(
        F.col("record_id").alias("original"), F.col("source_id").alias("refers_to"), "payload_bytes", "payload_digest", *held)
    found = revisits.join(originals, F.col("refers_to_record") == F.col("original"), "left").drop("original")
    claimed = F.regexp_extract("digest_field", "^sha1:([0-9a-f]{40})$", 1)
    found = found.withColumns({"payload_bytes": F.coalesce("payload_bytes", "http_length"), "payload_digest": F.coalesce("payload_digest", F.nullif(claimed, F.lit("")))})
    rest = records.filter("record_type is null or record_type != 'revisit'").withColumn("refers_to", F.lit(None).cast("string"))
    return rest.unionByName(found)
