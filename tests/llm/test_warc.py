"""WARC archives: what is written, read back, and resolved, against a plain reading of the rows and of the files."""

import gzip
import hashlib
import pathlib

import pytest
from pyspark.sql import functions as F

from callscope.llm import queries, warc

BIG = "a" * 1000
ROWS = [
    (1, "http://a.com/", BIG), (2, "http://a.com/2", BIG), (7, "http://a.com/7", BIG), (3, "http://a.com/3", "a" * 999), (4, None, "a" * 999),
    (5, "http://x/\r\nWARC-Type: forged\r\n\r\n", None), (6, "", ""), (8, "http://y/?WARC/1.1", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1." + "é" * 500),
    (9, "http://y/", "WARC/1.WARC/1.\r\n\r\n" * 300), (10, "http://y/", "\r\n\r\n" * 300), (11, "u" * 50_000, "long " * 100_000), (7, "http://a.com/7", BIG),
    (None, "http://n/", BIG), (None, None, None), (12, "http://y/", "WARC/1.WARC/1.\r\n\r\n" * 300),
]


def plain(rows):
    by_payload = {}
    for at, (i, _, html) in enumerate(rows):
        by_payload.setdefault((html or "").encode(), []).append((i is not None, i or 0, -at, i))
    out = []
    for payload, ids in by_payload.items():
        first, *rest = sorted(ids, reverse=True)
        revisits = len(payload) >= 1000
        digest = hashlib.sha1(payload).hexdigest()
        out.append((first[-1], len(payload), digest, "response", None))
        out += [(i[-1], len(payload), digest, "revisit" if revisits else "response", first[-1] if revisits else None) for i in rest]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, digest string").repartition(4)


def test_query_equals_a_plain_reading(spark, pages, tmp_path):
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op12_warc(spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(ROWS)


def test_files_are_archives_and_hold_each_large_payload_once(spark, pages, tmp_path):
    path = f"{tmp_path}/archives"
    warc.write_archives(pages, path, per_archive=3)
    seen, bodies = {}, []
    for file in pathlib.Path(path).glob("*.gz"):
        data, at = gzip.decompress(file.read_bytes()), 0
        while at < len(data):  # by the format alone
            end = data.index(b"\r\n\r\n", at)
            version, *lines = data[at:end].decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines)
            length = int(fields["Content-Length"])
            block, at = data[end + 4:end + 4 + length], end + 8 + length
            assert version == "WARC/1.1" and data[at - 4:at] == b"\r\n\r\n"
            head, _, payload = block.partition(b"\r\n\r\n")
            assert fields["WARC-Record-ID"] not in seen
            seen[fields["WARC-Record-ID"]] = (fields, payload)
            assert f"Content-Length: {len(payload)}".encode() in head or fields["WARC-Type"] == "revisit"
            if fields["WARC-Type"] == "response":
                bodies.append(payload)
                assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
    assert len(seen) == len(ROWS)
    large = [b for b in bodies if len(b) >= 1000]
    assert len(large) == len(set(large))
    for fields, payload in seen.values():
        if fields["WARC-Type"] == "revisit":
            assert payload == b"" and fields["WARC-Profile"] == warc.REVISIT_PROFILE
            original, body = seen[fields["WARC-Refers-To"]]
            assert original["WARC-Type"] == "response" and original["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]
            assert fields.get("WARC-Refers-To-Target-URI") == original.get("WARC-Target-URI")


def test_payloads_come_back(spark, pages, tmp_path):
    path = f"{tmp_path}/archives"
    warc.write_archives(pages, path)
    records = warc.with_originals(warc.read_archives(spark, path))
    got = sorted(((warc_id, bytes(p)) for warc_id, p in records.select("source_id", "payload").collect()), key=str)
    assert got == sorted(((None if i is None else str(i), (h or "").encode()) for i, _, h in ROWS), key=str)


def test_binary_payloads_and_string_ids(spark, tmp_path):
    rows = [("a%0D\r\n%", "u", bytes(range(256)) * 8), ("b", "u", b"\xff\r\n\r\nWARC/1.\xfe" * 200)]
    warc.write_archives(spark.createDataFrame(rows, "page_id string, url string, html binary"), f"{tmp_path}/x")
    got = warc.read_archives(spark, f"{tmp_path}/x").select(warc.unquoted(F.col("source_id")), "payload").collect()
    assert {(r[0], bytes(r[1])) for r in got} == {(i, p) for i, _, p in rows}


def test_foreign_archives(spark, tmp_path):
    """Other record types, one gzip member for each record, version 1.0, a revisit without its original."""
    def member(*lines, block=b""):
        return gzip.compress("\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    data = member("WARC/1.0", "WARC-Type: warcinfo", block=b"software: x\r\n")
    data += member("WARC/1.0", "warc-type: response", "WARC-Record-ID: <r:1>", "content-type: application/http", block=b"HTTP/1.1 200 OK\r\n\r\nbody")
    data += member("WARC/1.0", "WARC-Type: revisit", "WARC-Refers-To: <r:0>", "WARC-Payload-Digest: sha1:" + "ab" * 20,
                   "Content-Type: application/http", block=b"HTTP/1.1 200 OK\r\nContent-Length: 17\r\n\r\n")
    (tmp_path / "a.warc.gz").write_bytes(data)
    got = warc.with_originals(warc.read_archives(spark, str(tmp_path))).select("record_type", "payload_bytes", "payload", "payload_digest", "refers_to").collect()
    assert sorted((r[0], r[1], r[2] and bytes(r[2]), r[4]) for r in got) == [("response", 4, b"body", None), ("revisit", 17, None, None), ("warcinfo", 13, b"software: x\r\n", None)]
    assert [r[3] for r in got if r[0] == "revisit"] == ["ab" * 20]


@pytest.mark.parametrize("record", ["WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n", "WARC/1.1\r\nWARC-Type: x\r\n\r\n", "WARC/1.1\r\nContent-Length: 1\r\n\r\nlonger\r\n\r\n"])
def test_broken_records_are_errors(spark, tmp_path, record):
    (tmp_path / "a.gz").write_bytes(gzip.compress(record.encode()))
    with pytest.raises(Exception, match="WARC record"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_nothing(spark, pages, tmp_path):
    warc.write_archives(pages.limit(0), f"{tmp_path}/x")
    assert warc.with_originals(warc.read_archives(spark, f"{tmp_path}/x")).count() == 0
