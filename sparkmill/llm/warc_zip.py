"""WARC records in ZIP packages: writer, directory reader, range reader.

A package is a ZIP whose members are stored, not deflated: ``archive/data.warc.gz``
(each record its own gzip member) and ``indexes/index.cdxj`` (one line a record
with its offset and length).  The reader parses the end record, the ZIP64
locator and end record, and the central directory with ZIP64 extra fields; reads
the index member; and range-reads single records out of the package, which is
never unpacked.  Files are opened through Arrow's file systems, so a package can
lie in any store named by URI.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import join_by_key, ship, stage
from sparkmill.session import scratch_path

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2000-01-01T00:00:00Z"
#: A package is closed once its records hold this many bytes, which bounds the index a task keeps.
PACKAGE_BYTES = 256 << 20
#: Neighbouring records are fetched in one request up to this size; larger records have one of their own.
FETCH_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


# --- writing -------------------------------------------------------------------------------------------------------


def warc_record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One record; a revisit keeps the HTTP header (with the payload's length) and no payload."""
    name = "" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:x-page:{name}>"), ("WARC-Date", DATE),
            ("WARC-Target-URI", quote(url or "about:blank", safe="%:/?#[]@!$&'()*+,;=-._~")), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    if kind == "revisit":
        head[2:2] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class PackageWriter:
    """Streams records into one package; the index follows when it is closed."""

    def __init__(self, uri: str, level: int = 6):
        self.uri, self.level, self.at, self.lines = uri, level, 0, []
        fs, path = _open(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(WARC_MEMBER, "w", force_zip64=True)

    def add(self, url, record: bytes, fields: dict) -> None:
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        packed = packer.compress(record) + packer.flush()
        self.member.write(packed)
        self.lines.append(f"{quote(url or 'about:blank', safe=':/?&=')} {DATE} " + json.dumps(
            fields | {"offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(INDEX_MEMBER, "".join(f"{x}\n" for x in self.lines))
        self.zip.close()
        self.out.close()


MANIFEST = "package string, records bigint, bytes bigint"


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write (page_id, url, payload, digest, record_type, refers_to) rows; one row a package, staged.

    Every attempt of a task writes packages under names of its own, and only the
    committed manifest names packages: a repeated or lost attempt leaves files
    that nothing reads.
    """
    ship(records.sparkSession)
    folder = _uri(folder)

    def write(batches):
        made, writer = [], None
        for b in batches:
            for r in b.to_pylist():
                if writer is None:
                    writer = PackageWriter(f"{folder}/{uuid.uuid4().hex}.wacz")
                record = warc_record(r["page_id"], r["url"], r["payload"], r["digest"], r["record_type"], r["refers_to"])
                writer.add(r["url"], record, {"digest": f"sha1:{r['digest']}", "type": r["record_type"]})
                if writer.at >= package_bytes:
                    writer.close()
                    made, writer = [*made, writer], None
        if writer is not None:
            writer.close()
            made.append(writer)
        yield pa.RecordBatch.from_pydict({"package": [w.uri for w in made], "records": [len(w.lines) for w in made],
                                          "bytes": [w.at for w in made]}, pa.schema([("package", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    rows = records.select("page_id", "url", "payload", "digest", "record_type", "refers_to")
    return stage(rows.mapInArrow(write, MANIFEST), "warc-manifest")


# --- reading -------------------------------------------------------------------------------------------------------


@dataclass
class Member:
    name: str
    method: int
    size: int
    stored_size: int
    header_at: int


def _read(f, at: int, n: int) -> bytes:
    f.seek(at)
    data = f.read(n)
    if len(data) != n:
        raise ValueError(f"archive ends at {at + len(data)}, {n} bytes wanted at {at}")
    return data


def directory(f, size: int) -> list[Member]:
    """Members from the central directory of a package of ``size`` bytes; ZIP64 where the archive uses it."""
    tail_at = max(0, size - 65_557)  # the end record with the longest comment
    tail = _read(f, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06", 0, max(0, len(tail) - 18))
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if tail_at + end >= 20 and (locator := _read(f, tail_at + end - 20, 20))[:4] == b"PK\x06\x07":
        record = _read(f, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("ZIP64 locator leads to no ZIP64 end record")
        count, length, at = struct.unpack_from("<QQQ", record, 32)
    raw, p, out = _read(f, at, length), 0, []
    for _ in range(count):
        if raw[p:p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", raw, p + 8)
        stored, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, p + 20)
        header, = struct.unpack_from("<I", raw, p + 42)
        name = raw[p + 46:p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = raw[p + 46 + n_name:p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, q)
            if tag == 1:  # ZIP64: only the fields that are all ones in the entry, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                full, stored, header = (next(wide) if v == 0xFFFFFFFF else v for v in (full, stored, header))
            q += 4 + n
        out.append(Member(name, method, full, stored, header))
        p += 46 + n_name + n_extra + n_comment
    return out


def data_start(f, m: Member) -> int:
    """Where a stored member's bytes begin."""
    if m.method != 0:
        raise ValueError(f"{m.name} is compressed; only stored members can be read by range")
    head = _read(f, m.header_at, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {m.name}")
    return m.header_at + 30 + sum(struct.unpack_from("<HH", head, 26))


def read_index(packages: DataFrame, column: str = "package") -> DataFrame:
    """(package, offset in the package, length, url, digest, type) of every record listed in the packages' indexes."""
    ship(packages.sparkSession)

    def locate(batches):
        schema = pa.schema([("package", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()),
                            ("digest", pa.string()), ("type", pa.string())])
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = _open(_uri(uri))
                with fs.open_input_file(path) as f:
                    members = {m.name: m for m in directory(f, f.size())}
                    base = data_start(f, members[WARC_MEMBER])
                    index = members[INDEX_MEMBER]
                    lines = _read(f, data_start(f, index), index.size).decode().splitlines()
                for i in range(0, len(lines), 10_000):
                    found = [(x.split(" ", 2)[0], json.loads(x.split(" ", 2)[2])) for x in lines[i:i + 10_000]]
                    yield pa.RecordBatch.from_pydict({
                        "package": [uri] * len(found), "offset": [base + j["offset"] for _, j in found], "length": [j["length"] for _, j in found],
                        "url": [u for u, _ in found], "digest": [j["digest"] for _, j in found], "type": [j["type"] for _, j in found]}, schema)

    return packages.select(column).mapInArrow(locate, "package string, offset bigint, length bigint, url string, digest string, type string")


def parse_record(raw: bytes) -> tuple[dict, bytes, bytes]:
    """(WARC header, HTTP header, payload) of one unpacked record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _runs(rows: list[dict]):
    """Neighbouring rows of one package that fit one request."""
    run = []
    for r in rows:
        if run and (r["package"] != run[0]["package"] or r["offset"] + r["length"] - run[0]["offset"] > FETCH_BYTES):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


RECORDS = "package string, offset bigint, record_id string, type string, url string, refers_to string, digest string, payload_bytes bigint, payload binary"


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Range-read the listed records: one row a record, RECORDS.

    A response's digest is computed from its payload and must equal the header's;
    a revisit's length and digest are those its headers state.  ``payload`` is null
    for revisits, and for all with ``payloads=False``.
    """
    ship(index.sparkSession)
    schema = pa.schema([("package", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()),
                        ("refers_to", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def fetch(batches):
        name, f = None, None
        for b in batches:
            for run in _runs(b.to_pylist()):
                if run[0]["package"] != name:
                    name = run[0]["package"]
                    fs, path = _open(_uri(name))
                    f = fs.open_input_file(path)
                start = run[0]["offset"]
                data = _read(f, start, max(r["offset"] + r["length"] for r in run) - start)
                out = []
                for r in run:
                    raw = zlib.decompress(data[r["offset"] - start:r["offset"] - start + r["length"]], 31)
                    head, http, payload = parse_record(raw)
                    digest = head["warc-payload-digest"].partition(":")[2]
                    if head["warc-type"] == "response":
                        n = len(payload)
                        if payload_digest(payload) != digest:
                            raise ValueError(f"payload digest of {head['warc-record-id']} differs")
                    else:
                        n = int(next(x for x in http.decode().lower().split("\r\n") if x.startswith("content-length:"))[15:])
                        payload = None
                    out.append({"package": name, "offset": r["offset"], "record_id": head["warc-record-id"][1:-1], "type": head["warc-type"],
                                "url": head["warc-target-uri"], "refers_to": head.get("warc-refers-to", "<>")[1:-1] or None, "digest": digest,
                                "payload_bytes": n, "payload": payload if payloads else None})
                yield pa.RecordBatch.from_pylist(out, schema)

    dealt = index.withColumn("_piece", F.floor(F.col("offset") / FETCH_BYTES)).repartition("package", "_piece")
    return dealt.sortWithinPartitions("package", "offset").drop("_piece").mapInArrow(fetch, RECORDS)


# --- the query -----------------------------------------------------------------------------------------------------


def package_pages(pages: DataFrame, folder: str | None = None, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write every page as a record; the manifest.

    Of pages with equal payloads (empty ones too) the largest page_id is the
    response, the others are revisits of it; among rows that repeat that id all are
    responses, and a null id is never the largest unless all are null, when all are
    responses.  A null html is an empty payload, a null url ``about:blank``.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("payload"), F.unhex(F.sha1(html)).alias("sha"))
    winners = stage(rows.groupBy("sha").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")), "warc-payloads")
    joined = join_by_key(rows, winners, "sha", "n", F.xxhash64("page_id", "url"))
    revisit = F.coalesce(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.lit(False))
    to_base32 = F.pandas_udf(_base32, "string")
    kept = joined.select("page_id", "url", "payload", to_base32("sha").alias("digest"),
                         F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("first")).alias("refers_to"))
    return write_packages(kept, folder, package_bytes)


def _base32(digests):
    return digests.map(lambda b: base64.b32encode(bytes(b)).decode())


def roundtrip_digest(pages: DataFrame) -> DataFrame:
    """The digest of the WARC query: pages written as packages and read back."""
    records = read_records(read_index(package_pages(pages)), payloads=False)
    ident = lambda c: F.when(F.length(c) > 11, F.substring(c, 12, 20).cast("bigint"))  # noqa: E731  after urn:x-page:
    return records.select(ident("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
                          F.col("type").alias("record_type"), ident("refers_to").alias("refers_to"))


# Base 32 in SQL: eight groups of five hex digits, each four letters.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(8), lambda i: (
    array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((CAST(('0x' || substr(x, CAST(i * 5 + 1 AS INT), 5)) AS BIGINT) >> k) & 31 AS INT) + 1, 1)), ''))), '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM b
"""
