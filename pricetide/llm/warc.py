"""WARC archives: write records, and turn whole-file gzip into one member per record with an offset index.

Archives are rows of a Parquet table (archive, data), so Spark's committer makes each exactly once and any executor
can read them, and the index of a normalised archive is in its row; ``export_files`` writes both out as files, the index
as a sidecar of its archive. The normaliser inflates a whole-file stream once, piece by piece, finds the records by their
Content-Length, compresses each as a gzip member of its own and notes its offset and length.

Nulls: a null payload is an empty one; a record without page_id has none in its headers, is never the response that
others refer to, and is a response itself. Rows that repeat the least page_id of a payload are all responses. Empty
tables give no archives. Payloads are stored whole, and a long one makes a long archive. Equal
payloads are told by their SHA-1 (a payload of very many pages moves ids and digests, never their html); other columns of pages are not looked at. URLs keep their printable characters; others
are percent-encoded byte by byte in UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm import kernel as K
from pricetide.session import cut, stash

PIECE, READ_ROWS = 1 << 20, 500  # bytes inflated, and records read, at a time
FREQUENT = 1000  # payloads of more than this part of all repeated ones are looked up by broadcast
ARCHIVE_BYTES = 8 << 20  # of records before compression
LEVEL = 4
GZIP = 31  # zlib's window bits for gzip framing
RECORD_ID = "urn:page:"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

_ARCHIVE = pa.schema([("archive", pa.string()), ("data", pa.binary())])
_MEMBER = pa.schema([("archive", pa.string()), ("data", pa.binary()), ("index", pa.list_(pa.struct([("record_id", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])))])
_MEMBER_DDL = "archive string, data binary, index array<struct<record_id: string, offset: bigint, length: bigint>>"
_PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_PAGE_DDL = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, sha1, refers_to): of equal payloads of least_bytes or more, the least page_id is referred to by the others."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    keyed = rows.select("page_id", "sha1", F.octet_length("html").alias("bytes")).where((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull()).drop("bytes")
    least = cut(keyed.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    total = least.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") * FREQUENT > total
    near = F.broadcast(least.where(frequent).select("sha1", "first"))  # fewer than FREQUENT rows
    apart = keyed.join(near, "sha1", "left_anti").join(least.where(~frequent).select("sha1", "first"), "sha1")
    later = keyed.join(near, "sha1").unionByName(apart).where("page_id <> first").distinct()
    named = later.select(F.col("page_id").alias("own_id"), F.col("sha1").alias("own_sha1"), F.col("first").alias("refers_to"))
    return rows.join(named, (F.col("page_id") == F.col("own_id")) & (F.col("sha1") == F.col("own_sha1")), "left").drop("own_id", "own_sha1")


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP head alone as its block."""
    head = HTTP_HEAD.format(len(payload)).encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <{RECORD_ID}{page_id}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(data: bytes, at: int) -> tuple[dict[str, str], int, int]:
    """Header fields of the record at a place, where its block starts and where the next record starts."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, end + 4, end + 4 + int(fields["content-length"]) + 4


def write_monolithic(records: DataFrame) -> DataFrame:
    """(archive, data): gzip streams of many records each, from (page_id, url, html, sha1, refers_to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, parts, size, first = None, [], 0, b""

        def done() -> pa.RecordBatch:
            data = b"".join([*parts, press.flush()])
            return K.table({"archive": [hashlib.sha1(first + b"%d" % zlib.crc32(data)).hexdigest()[:20]], "data": [data]}, _ARCHIVE)

        for batch in batches:
            for row in rows_of(batch):
                rec = record(row["page_id"], row["url"], row["html"].encode(), bytes.fromhex(row["sha1"]), row["refers_to"])
                if press is None:
                    press, first = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), rec[:400]
                parts.append(press.compress(rec))
                size += len(rec)
                if size >= ARCHIVE_BYTES:
                    yield done()
                    press, parts, size = None, [], 0
        if press is not None:
            yield done()

    return records.select("page_id", "url", "html", "sha1", "refers_to").mapInArrow(run, "archive string, data binary")


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one at a time: only one archive is held as Python bytes."""
    for at in range(batch.num_rows):
        yield {name: batch.column(name)[at].as_py() for name in batch.schema.names}


def inflated(data: bytes) -> Iterator[bytes]:
    """All members of a gzip file in one pass, as pieces of at most ``PIECE`` bytes."""
    while data:
        stream = zlib.decompressobj(GZIP)
        while not stream.eof:
            piece = stream.decompress(data, PIECE)
            data = stream.unconsumed_tail
            if piece:
                yield piece
            elif not data and not stream.eof:
                raise ValueError("gzip stream ends early")
        data = stream.unused_data


def split_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields of each record of a gzip file, and the record as a gzip member; held are a piece and the member."""
    pieces, held = inflated(data), bytearray()
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if (more := next(pieces, None)) is None:
                if held:
                    raise ValueError("archive ends within a record's header")
                return
            held += more
        fields, _, left = headers(bytes(held[: end + 4]), 0)
        press, member = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), []
        while left:
            if not held:
                if (more := next(pieces, None)) is None:
                    raise ValueError("archive ends within a record")
                held += more
            part = bytes(held[:left])
            del held[: len(part)]
            left -= len(part)
            member.append(press.compress(part))
        yield fields, b"".join([*member, press.flush()])


def normalise(archives: DataFrame) -> DataFrame:
    """(archive, data, index): each record a gzip member of its own; index has record_id, offset and length of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                place, members, index = 0, [], []
                for fields, member in split_records(row["data"]):
                    index.append({"record_id": fields.get("warc-record-id", "").strip("<>") or None, "offset": place, "length": len(member)})
                    members.append(member)
                    place += len(member)
                yield K.table({"archive": [row["archive"]], "data": [b"".join(members)], "index": [index]}, _MEMBER)

    return archives.select("archive", "data").mapInArrow(run, _MEMBER_DDL)


def record_row(data: bytes, with_payload: bool = True) -> dict:
    """A record, inflated, as a row. Records of others may lack any field but type and length, and need not hold HTTP."""
    fields, block, nxt = headers(data, 0)
    kind, content, http, body = fields.get("warc-type"), fields.get("content-type", ""), {}, block
    if content.startswith("application/http") and (end := data.find(b"\r\n\r\n", block, nxt - 4)) >= 0:
        body = end + 4
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[block:end].decode("latin-1").split("\r\n")[1:])}
    payload = data[body : nxt - 4]

    def number(name: str) -> int | None:
        text = fields.get(name, "").strip("<>")
        return int(text.removeprefix(RECORD_ID)) if re.fullmatch(RECORD_ID + r"-?\d+", text) else None

    algorithm, _, digest = fields.get("warc-payload-digest", "").partition(":")
    if kind == "response" and algorithm == "sha1" and not {"content-encoding", "transfer-encoding"} & http.keys() and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {fields.get('warc-record-id')} differs from its digest")
    told = http.get("content-length", "")
    size = (int(told) if told.isdigit() else None) if kind == "revisit" else len(payload)
    return {"page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest or None, "record_type": kind, "refers_to": number("warc-refers-to"), "payload": payload if with_payload and kind != "revisit" else None}


def read_records(members: DataFrame, with_payload: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for a revisit), found through the index.

    Records of other writers are read as well: an id that isn't a page's is null, and so is a digest that isn't told.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                found = (record_row(zlib.decompress(row["data"][x["offset"] : x["offset"] + x["length"]], GZIP), with_payload) for x in row["index"])
                while part := list(islice(found, READ_ROWS)):
                    yield pa.RecordBatch.from_pylist(part, schema=_PAGE)

    return members.select("archive", "data", "index").mapInArrow(run, _PAGE_DDL)


def export_files(members: DataFrame, uri: str) -> DataFrame:
    """Write each archive as uri/<archive>.warc.gz with its index beside it; run the result. uri: file or hdfs store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for row in rows_of(batch):
                lines = "".join(f"{x['record_id'] or '-'} {x['offset']} {x['length']}\n" for x in row["index"])
                for name, data in ((f"{row['archive']}.warc.gz", row["data"]), (f"{row['archive']}.idx", lines.encode())):
                    with store.open_output_stream(f"{root}/.{name}", compression=None) as f:
                        f.write(data)
                    store.move(f"{root}/.{name}", f"{root}/{name}")
                yield pa.RecordBatch.from_pylist([{"archive": row["archive"], "records": len(row["index"])}], schema=pa.schema([("archive", pa.string()), ("records", pa.int64())]))

    return members.mapInArrow(run, "archive string, records bigint")


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) into archives, normalise these, and read all records back."""
    archives = stash(write_monolithic(deduplicated(pages, least_bytes)), "warc")
    members = stash(normalise(archives), "members")
    return read_records(members, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
