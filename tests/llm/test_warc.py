import base64
import gzip
import hashlib
import zlib

import pytest

from pricetide.llm import warc as W


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        refers = first.get(h or "") if i is not None and first[h or ""] != i else None
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


ROWS = [(1, "http://a/é b", "<p>é</p>"), (3, None, "<p>é</p>"), (2, "http://a", None), (4, "u", ""), (None, "u", "<p>é</p>"), (5, "u\r\nX: y", "WARC/1.1\r\nContent-Length: 3\r\n\r\n"), (6, "u", "z" * 300_000), (7, "u", "z" * 300_000), (7, "u", "z" * 300_000)]


@pytest.mark.parametrize("size", [1, 100_000, 1 << 23])
def test_round_trip(spark, monkeypatch, size):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", size)
    got = W.archive_round_trip(pages(spark, ROWS)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(ROWS)


def test_members_stand_alone_and_index_fits(spark):
    members = W.normalise(W.write_monolithic(W.deduplicated(pages(spark, ROWS).coalesce(1)))).collect()
    n = 0
    for row in members:
        whole = gzip.decompress(row.data)
        assert b"".join(zlib.decompress(row.data[x.offset : x.offset + x.length], 31) for x in row["index"]) == whole
        for x in row["index"]:
            n += zlib.decompress(row.data[x.offset : x.offset + x.length], 31).startswith(b"WARC/1.1\r\n")
    assert n == len(ROWS)


def test_payloads_come_back_whole(spark):
    members = W.normalise(W.write_monolithic(W.deduplicated(pages(spark, ROWS))))
    got = {r.page_id: bytes(r.payload) for r in W.read_records(members).where("record_type = 'response' and page_id is not null").collect()}
    assert got[1] == "<p>é</p>".encode() and got[6] == b"z" * 300_000 and got[2] == b""


def test_many_members_are_inflated_in_one_pass():
    assert b"".join(W.inflated(gzip.compress(b"a") + gzip.compress(b"b" * 3_000_000) + gzip.compress(b""))) == b"a" + b"b" * 3_000_000
    assert list(W.inflated(b"")) == []
    with pytest.raises(ValueError):
        list(W.inflated(gzip.compress(b"a" * 5000)[:-12]))


def test_monolith_of_many_records(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (1 + i % 40)) for i in range(4000)] + [(9000, "big", "q" * 5_000_000)]
    one = W.write_monolithic(W.deduplicated(pages(spark, rows).coalesce(1))).collect()
    joined = b"".join(bytes(r.data) for r in one)  # a foreign file: several members of many records each
    members = W.normalise(spark.createDataFrame([("whole", joined)], "archive string, data binary"))
    got = {r.page_id: len(r.payload) for r in W.read_records(members).collect()}
    assert got == {i: len(h) for i, _, h in rows}
    with pytest.raises(ValueError):
        list(W.split_records(gzip.compress(gzip.decompress(bytes(one[0].data))[:-700])))


def test_urls_are_percent_encoded_by_byte(spark):
    rows = [(1, "http://a/\u3000x\u2028y z\té", "h")]
    members = W.normalise(W.write_monolithic(W.deduplicated(pages(spark, rows))))
    assert W.read_records(members).first().url == "http://a/%E3%80%80x%E2%80%A8y%20z%09é"


def test_export(spark, tmp_path):
    members = W.normalise(W.write_monolithic(W.deduplicated(pages(spark, ROWS))))
    total = sum(r.records for r in W.export_files(members, f"file://{tmp_path}/out").collect())
    assert total == len(ROWS)
    assert sum(gzip.decompress(p.read_bytes()).count(b"WARC-Type:") for p in (tmp_path / "out").glob("*.warc.gz")) == len(ROWS)


def test_empty(spark):
    assert W.archive_round_trip(pages(spark, [])).count() == 0


def test_records_of_other_writers(spark):
    """A warcinfo, a request, a response without digest and a revisit without length, normalised and read back."""
    def rec(kind, block, *more):
        return "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"Content-Length: {len(block)}", *more]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    whole = (
        rec("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields", "WARC-Record-ID: <urn:uuid:1>")
        + rec("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "Content-Type: application/http; msgtype=request")
        + rec("response", b"HTTP/1.1 200 OK\r\ncontent-type: text/html\r\n\r\n<p>\r\n\r\n", "Content-Type: application/http; msgtype=response", "WARC-Record-ID: <urn:page:7>")
        + rec("revisit", b"HTTP/1.1 200 OK\r\n\r\n", "Content-Type: application/http; msgtype=response", "WARC-Refers-To: <urn:page:7>", "WARC-Payload-Digest: md5:00")
        + rec("resource", b"", "Content-Type: text/plain")
    )
    archives = spark.createDataFrame([("a", bytearray(gzip.compress(whole)))], "archive string, data binary")
    got = [(r.record_type, r.page_id, r.payload_bytes, r.payload_digest, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in W.read_records(W.normalise(archives)).collect()]
    assert got == [
        ("warcinfo", None, 13, None, None, b"software: x\r\n"),
        ("request", None, 0, None, None, b""),
        ("response", 7, 7, None, None, b"<p>\r\n\r\n"),
        ("revisit", None, None, "00", 7, None),
        ("resource", None, 0, None, None, b""),
    ]


def test_one_payload_in_half_of_all_pages(spark, monkeypatch):
    monkeypatch.setattr(W, "FREQUENT", 4)
    rows = [(i, "u", "same" if i % 2 else f"few {i % 5}" if i % 3 else f"own {i}") for i in range(600)] + [(1, "u", "same"), (None, "u", "same"), (4, "u", "other")]
    found = W.deduplicated(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(found) == len(rows)
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html] = min(i, first.get(html, i))
    for r in found:
        assert r.refers_to == (None if r.page_id in (None, first[r.html]) else first[r.html])
