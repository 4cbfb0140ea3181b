import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from touchline.llm import common, warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))


def expected(rows):
    data = [(p, (h or "").encode()) for p, _, h in rows]
    last = {}
    for p, b in data:
        if len(b) >= 1000 and p is not None:
            last[b] = max(p, last.get(b, p))
    out = []
    for p, b in data:
        again = b in last and p != last[b]
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last[b] if again else None))
    return sorted(out, key=repr)


def read(files, **options):
    found = warc.read_archives(files, **options)
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found.collect()), key=repr)


BIG = "<p>é</p>" * 200
ROWS = [(1, "http://a/ b\r\nX: y", BIG), (2, None, BIG), (3, "http://c", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""), (7, "u", "y" * 200_000), (None, "u", BIG), (2, "again", BIG), (8, "u", "WARC/1.1\r\n\r\n" + "\x1f\u008b\x08" * 50)]


@pytest.mark.parametrize("split", [64, 777, 1 << 20])
def test_each_record_is_read_once_however_it_is_split(spark, split):
    files = warc.write_archives(pages(spark, ROWS), file_bytes=2000)
    assert files.count() > 1
    assert read(files, split_bytes=split) == expected(ROWS)


def test_payload_and_uri_come_back(spark):
    files = warc.write_archives(pages(spark, ROWS))
    got = {(r["page_id"], r["target_uri"]): r["payload"] for r in warc.read_archives(files, payload=True).where("record_type = 'response'").collect()}
    assert bytes(got[7, "u"]) == b"y" * 200_000
    assert bytes(got[2, None]) == BIG.encode()
    uris = [r["target_uri"] for r in warc.read_archives(files).where("page_id = 1").collect()]
    assert uris == ["http://a/%20b%0D%0AX:%20y"]


def test_archives_are_plain_gzip(spark):
    for f in warc.write_archives(pages(spark, ROWS)).collect():
        with common.open_input(f["path"]) as x:
            text = gzip.decompress(x.read())
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_magic_that_begins_no_record_is_passed_by(tmp_path):
    member = lambda b: (z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(b) + z.flush()
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\na\r\n\r\n\r\n\r\n"
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"\x1f\x8b\x08junk" + member(b"no record") + member(record) + b"\x1f\x8b\x08")
    assert list(warc.members(f"file://{path}", 0, path.stat().st_size)) == [record]


def test_no_pages(spark):
    files = warc.write_archives(pages(spark, []))
    assert files.count() == 0 and warc.read_archives(files).count() == 0
