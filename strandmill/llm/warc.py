"""WARC archives: a writer with revisit records and a splittable reader.

Writing.  Payloads are equal if their SHA-256 and length are.  Of pages with equal payloads the one with the smallest id is a ``response``; the others are
``revisit`` records that name it and carry no payload.  Every record is a gzip member of its own.  Spark's text sink
writes the members, so archives land wherever Spark can write and only through its commit protocol.
The sink ends each row with one separator byte; a member ends with the byte 0 (the top byte of
its length field, for records under 16 MiB), so 0 is the separator and the member is handed over without
it.  A larger record is followed by an empty member, which ends with 0 again.

Reading.  Files are cut into byte ranges.  A task looks in its range for the gzip magic, tries to decode what
follows, and takes it for a record only if it starts like one and if the member is followed by another
or by the end of the file; from then on it goes from member to member.  It owns the records that start
inside its range and reads the last one to its end, beyond the range if need be.  Damage raises: where a member has to
start and none can be read, where a record's payload and digest differ, and where a file does not start with a member.

Nulls: a null html is an empty payload; a null url is left out and read back as null; a null id never is a
revisit's target, and its record is a response.  Rows that repeat the first row's id are responses.
Empty tables give an empty archive and an empty result.  Columns other than page_id, url and html are not written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import tokens
from strandmill.llm.scratch import fresh_path

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
SPLIT = 16 << 20
#: Ranges that a task reads, where there are many.
RANGES = 16
_CHUNK = 1 << 18


def _urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One gzip member.  ``first``: the page that holds the payload, if another one does."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": _urn(page_id),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if page_id is not None:
        fields["X-Page-Id"] = str(page_id)
    if url is not None:
        fields["WARC-Target-URI"] = _line(url)
    if first is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _urn(first), "X-Refers-To-Page-Id": str(first)}
    block = http + payload if first is None else http
    fields["Content-Length"] = str(len(block))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    whole = head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = squeeze.compress(whole) + squeeze.flush()
    return member if member.endswith(b"\0") else member + EMPTY_MEMBER


def write_archives(pages: DataFrame, path: str) -> None:
    """``pages`` (page_id, url, html) as gzip WARC files below ``path``."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha2(F.encode("html", "UTF-8"), 256))
    # Which page holds a payload is settled without the payloads; they move once, by page, so that no common payload fills a task.
    light = rows.select("page_id", "sha", F.octet_length("html").alias("size"))
    firsts = light.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = light.join(firsts, ["sha", "size"]).where("page_id != first").select("page_id", "sha", "first").distinct()
    named = rows.join(revisits, ["page_id", "sha"], "left").select("page_id", "url", "html", "first")

    def run(batches):
        for batch in batches:
            for part in tokens.slices(batch, "html", 4_000_000):
                rows = zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True)
                out = [record(i, u, h.encode("utf-8", "surrogatepass"), f)[:-1] for i, u, h, f in rows]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    members = named.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("lineSep", "\0").option("compression", "none").text(path)


class _File:
    """Bytes of a file by offset, on a local disk or any store that pyarrow can open."""

    def __init__(self, path: str):
        if path.startswith("file:"):
            self.handle = pa.OSFile("/" + path[5:].lstrip("/"))
        else:
            from pyarrow import fs

            store, inner = fs.FileSystem.from_uri(path)
            self.handle = store.open_input_file(inner)
        self.size = self.handle.size()

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *what) -> None:
        self.handle.close()

    def at(self, offset: int, n: int) -> bytes:
        self.handle.seek(offset)
        return self.handle.read(min(n, max(0, self.size - offset)))


def member_at(file: _File, offset: int, whole: bool) -> tuple[bytes, int] | None:
    """(content, end offset) of the gzip member at ``offset``; None where there is none.

    Unless ``whole``, only a start like a record's makes the rest be decoded.
    """
    inflate, out, at = zlib.decompressobj(31), [], offset
    try:
        while not inflate.eof:
            chunk = file.at(at, 512 if at == offset else _CHUNK)
            if not chunk:
                return None
            at += len(chunk)
            out.append(inflate.decompress(chunk))
            if not whole and sum(map(len, out[:8])) >= 7:
                if not b"".join(out[:8]).startswith(b"WARC/1."):
                    return None
                whole = True
        return b"".join(out), at - len(inflate.unused_data)
    except zlib.error:
        return None


def _follows(file: _File, offset: int) -> bool:
    return offset >= file.size or file.at(offset, 3) == MAGIC


def _must(file: _File, offset: int) -> tuple[bytes, int]:
    """The member at ``offset``, where one has to start."""
    got = member_at(file, offset, True)
    if not got or not _follows(file, got[1]):
        raise ValueError(f"the archive is damaged at or after byte {offset}")
    return got


def members(file: _File, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the records that start in [start, end).

    A file starts with a member and a member follows a member; where none can be read there, it raises.  The
    first record of a later range is found by trial, so the range before vouches for it by reading it too.
    """
    at, synced = start, start == 0
    while at < min(end, file.size):
        if synced:
            got = _must(file, at)
        else:
            window = file.at(at, min(_CHUNK, end - at) + len(MAGIC) - 1)
            k = window.find(MAGIC)
            if k < 0 or at + k >= end:
                at += max(1, len(window) - len(MAGIC) + 1)
                continue
            at += k
            got = member_at(file, at, False)
            if not got or not got[0].startswith(b"WARC/1.") or not _follows(file, got[1]):
                at += 1
                continue
        if got[0]:
            yield at, got[0]
        at, synced = got[1], True
    if synced and at < file.size:
        _must(file, at)


def parse(content: bytes) -> tuple[dict[str, str], bytes, int]:
    """(fields, payload, payload length) of a record; a revisit has the length but no payload."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    return fields, payload, length


def read_archives(spark: SparkSession, path: str, split: int = SPLIT, with_payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload, path, offset) of all records.

    A task reads several ranges, one after the other, where there are many.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start"))
    n = ranges.count()
    ranges = ranges.repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism), -(-n // RANGES)))
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, path string, offset long"
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(path: str, start: int) -> Iterator[tuple]:
        with _File(path) as file:
            yield from records(file, path, start)

    def records(file: _File, path: str, start: int) -> Iterator[tuple]:
        for offset, content in members(file, start, start + split):
            fields, payload, length = parse(content)
            kind = fields["WARC-Type"]
            stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != stated):
                raise ValueError(f"the record at {offset} of {path} is damaged")
            number = lambda x: int(x) if x else None
            yield number(fields.get("X-Page-Id")), fields.get("WARC-Target-URI"), kind, length, stated, number(fields.get("X-Refers-To-Page-Id")), payload if with_payload else None, path, offset

    def run(batches):
        for batch in batches:
            for path, start in zip(*(batch.column(c).to_pylist() for c in ("path", "start")), strict=True):
                held, size = [], 0
                for row in rows(path, start):
                    held.append(row)
                    size += row[3] + 500
                    if size > 8_000_000:
                        yield _batch(held)
                        held, size = [], 0
                yield _batch(held)

    def _batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, kind in enumerate(kinds)], names=names)

    return ranges.mapInArrow(run, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows without archives; base32 takes four letters from every five hexadecimal digits.
OP9_SQL = """
WITH paged AS (
  SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
),
hashed AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, page_id <> first AS again, first FROM paged)
SELECT
  page_id,
  payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (5 * (3 - i % 4))::INTEGER) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to
FROM hashed
"""
