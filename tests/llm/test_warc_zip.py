"""ZIP-packaged WARC: directory parsing against zipfile, and an exact round trip."""

import base64
import hashlib
import io
import os
import zipfile

import pytest

from sparkmill.llm import warc_zip as W


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string, type string, sha string, n int")


def page(i, url, html):
    return (i, url, html, "x", "y", "z", 1)


def b32(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


@pytest.mark.parametrize("limit,comment", [(None, b""), (10, b""), (10, b"note PK\x05\x06 note" * 3), (None, b"x" * 65_535)])
def test_directory_equals_zipfile(monkeypatch, limit, comment):
    buf = io.BytesIO()
    if limit:  # sizes and offsets above ten bytes go to ZIP64 records
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for i in range(5):
            with z.open(f"archive/é{i}", "w", force_zip64=True) as m:
                m.write(bytes([i]) * (100 * i))
        z.comment = comment
        want = [(i.filename, i.file_size, i.compress_size) for i in z.infolist()]
    raw = buf.getvalue()
    if limit and not comment:
        assert b"PK\x06\x06" in raw and b"PK\x06\x07" in raw
    found = W.directory(io.BytesIO(raw), len(raw))
    assert [(m.name, m.size, m.stored_size) for m in found] == want
    for i, m in enumerate(found):
        at = W.data_start(io.BytesIO(raw), m)
        assert raw[at:at + m.size] == bytes([i]) * (100 * i)


def test_directory_rejects_what_it_cannot_read():
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "b" * 100)
    raw = buf.getvalue()
    with pytest.raises(ValueError, match="compressed"):
        W.data_start(io.BytesIO(raw), W.directory(io.BytesIO(raw), len(raw))[0])
    with pytest.raises(ValueError, match="no end"):
        W.directory(io.BytesIO(raw[:50]), 50)


ROWS = ([page(i, f"http://h/{i}", "copy") for i in range(60)] + [page(100 + i, f"http://h/é {i}\r\nX: y", f"<p>ü{i}</p>\r\n\r\nWARC/1.1\r\n" * i) for i in range(9)]
        + [page(200, None, None), page(201, "u", ""), page(None, "u", "no id"), page(300, "u", "z" * 300_000), page(301, "u", "rep"), page(301, "u", "rep")])


def brute(rows):
    out, first = [], {}
    for r in rows:
        if r[0] is not None:
            first[r[2] or ""] = max(first.get(r[2] or "", -1), r[0])
    for r in rows:
        raw, top = (r[2] or "").encode(), first.get(r[2] or "")
        again = top is not None and r[0] != top
        out.append((r[0], len(raw), b32(raw), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    out = W.roundtrip_digest(pages(spark, ROWS).repartition(3))
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(ROWS)
    assert W.roundtrip_digest(pages(spark, [])).count() == 0


def test_packages_are_plain_zip_and_payloads_come_back(spark, tmp_path):
    manifest = W.package_pages(pages(spark, ROWS).coalesce(1), str(tmp_path / "w"), package_bytes=2000)
    made = manifest.collect()
    assert len(made) > 1 and sum(r.records for r in made) == len(ROWS)
    for r in made:
        with zipfile.ZipFile(r.package.removeprefix("file://")) as z:
            assert z.testzip() is None and z.namelist() == [W.WARC_MEMBER, W.INDEX_MEMBER]
            assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
    records = W.read_records(W.read_index(manifest)).collect()
    got = {bytes(r.payload) for r in records if r.type == "response"}
    assert got == {(r[2] or "").encode() for r in ROWS}
    assert all(r.payload is None for r in records if r.type == "revisit")
    assert all(os.path.getsize(r.package.removeprefix("file://")) > r.bytes for r in made)
