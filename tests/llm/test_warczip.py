"""ZIP-packaged archives against a round trip, and the reader against packages of the standard library."""

import gzip
import hashlib
import io
import json
import zipfile

import pyarrow as pa
import pytest

from quillon.llm import warczip as W

SCHEMA = "page_id long, url string, html string, digest string, first string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], SCHEMA)


def brute(rows):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = min(same) if len(data) >= W.REVISIT and same else i
        kind = "response" if first == i else "revisit"
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), kind, first if kind == "revisit" else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/1", "x" * 100), (0, "http://a/0\n b", "x" * 100), (2, "http://a/2", "x" * 99), (3, None, "x" * 99), (4, "u", None), (5, "u", ""), (6, "é", "ü" * 50), (7, "u", "ü" * 50), (8, "u", "long " * 300_000), (9, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (9, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (None, "u", "x" * 100), (None, "u", "only " * 30), (None, "u", "only " * 30), (10, "u", "\x00" * 120)]


def test_round_trip(spark):
    got = sorted((tuple(r) for r in W.round_trip(pages(spark, ROWS)).collect()), key=str)
    assert got == brute(ROWS)
    assert W.round_trip(pages(spark, [])).collect() == []


def test_hot_payload_joined_by_key(spark, monkeypatch):
    from quillon.llm import common

    rows = [(i, "u", ("hot" if i % 3 == 0 else f"pair {i // 2}") * 60) for i in range(60)]
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    assert sorted((tuple(r) for r in W.round_trip(pages(spark, rows)).collect()), key=str) == brute(rows)


def test_packages_of_bounded_size_hold_whole_records(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"{i} " * 400) for i in range(40)]
    packages = W.write(pages(spark, rows).coalesce(1), str(tmp_path), package_bytes=2000)
    listed = packages.collect()
    assert len(listed) > 3 and sum(r.records for r in listed) == 40
    for r in listed:  # other tools read them too
        with zipfile.ZipFile(r.path) as z:
            assert z.testzip() is None
            lines = z.read("indexes/index.cdxj").decode().splitlines()
            data = z.read("archive/data.warc.gz")
            assert len(lines) == r.records and len(data) == r.bytes
            entry = json.loads(lines[-1].partition(" ")[2])
            record = gzip.decompress(data[int(entry["offset"]) : int(entry["offset"]) + int(entry["length"])])
            assert record.startswith(b"WARC/1.1\r\nWARC-Type: response") and record.endswith(b"\r\n\r\n")
    read = W.read(packages, range_bytes=500).collect()
    assert sorted(r.headers["WARC-Target-URI"] for r in read) == sorted(u for _, u, _ in rows)
    assert all(r.error is None for r in read)


def record(i):
    return W.page_record(i, f"http://h/{i}", f"page {i}".encode(), hashlib.sha256(f"page {i}".encode()).hexdigest(), None)


def package(index=True, method=zipfile.ZIP_STORED, index_method=zipfile.ZIP_STORED, gz=False, comment=b"", wide=False, before=b""):
    records = [record(i) for i in range(5)]
    out = io.BytesIO(before)
    out.seek(len(before))
    lines, at = "!meta 0\n", 0
    for i, r in enumerate(records):
        lines += f"k{i} 2020 {json.dumps({'offset': at, 'length': len(r), 'filename': 'archive/a.warc.gz'})}\n"
        at += len(r)
    with zipfile.ZipFile(out, "a" if before else "w") as z:
        with z.open(zipfile.ZipInfo("archive/a.warc.gz"), "w", force_zip64=wide) if method == zipfile.ZIP_STORED else _Deflated(z) as member:
            member.write(b"".join(records))
        z.writestr("pages/pages.jsonl", "{}")
        if index:
            data = lines.encode()
            z.writestr("indexes/i.cdx.gz" if gz else "indexes/i.cdx", gzip.compress(data[:40]) + gzip.compress(data[40:]) if gz else data, index_method)
        z.comment = comment
    return out.getvalue()


class _Deflated:
    def __init__(self, z):
        self.z = z

    def __enter__(self):
        return self

    def write(self, data):
        self.z.writestr("archive/a.warc.gz", data, zipfile.ZIP_DEFLATED)

    def __exit__(self, *_):
        pass


def read_all(spark, tmp_path, data, **more):
    path = tmp_path / f"{hashlib.md5(data).hexdigest()}.zip"
    path.write_bytes(data)
    rows = W.read(spark.createDataFrame([(str(path),)], "path string"), **more).collect()
    return sorted(r.headers["WARC-Target-URI"] for r in rows if r.error is None), [r.error for r in rows if r.error]


WANT = [f"http://h/{i}" for i in range(5)]


@pytest.mark.parametrize("kind", [{}, {"wide": True}, {"comment": b"PK\x05\x06 not the end" * 9}, {"index_method": zipfile.ZIP_DEFLATED}, {"gz": True}, {"index": False}])
def test_reads_packages_of_other_writers(spark, tmp_path, kind):
    assert read_all(spark, tmp_path, package(**kind)) == (WANT, [])


def zip64(data):
    """The same package with its end record and its directory entries saying that numbers are too large for them."""
    end = data.rfind(b"PK\x05\x06")
    n, size, at = int.from_bytes(data[end + 10 : end + 12], "little"), int.from_bytes(data[end + 12 : end + 16], "little"), int.from_bytes(data[end + 16 : end + 20], "little")
    held, entries = data[at : at + size], b""
    while held:
        name, extra, comment = (int.from_bytes(held[i : i + 2], "little") for i in (28, 30, 32))
        length = 46 + name + extra + comment
        one, held = held[:length], held[length:]
        field = b"\x01\x00\x18\x00" + one[24:28] + b"\0" * 4 + one[20:24] + b"\0" * 4 + one[42:46] + b"\0" * 4
        other = b"\x99\x99\x02\x00ab"
        entries += one[:20] + b"\xff" * 8 + one[28:30] + (len(other + field) + extra).to_bytes(2, "little") + one[32:42] + b"\xff" * 4 + one[46 : 46 + name] + other + field + one[46 + name :]
    wide = b"PK\x06\x06" + (44).to_bytes(8, "little") + b"\0" * 12 + n.to_bytes(8, "little") * 2 + len(entries).to_bytes(8, "little") + at.to_bytes(8, "little")
    locator = b"PK\x06\x07" + b"\0" * 4 + (at + len(entries)).to_bytes(8, "little") + b"\1\0\0\0"
    return data[:at] + entries + wide + locator + b"PK\x05\x06" + b"\0" * 4 + b"\xff" * 12 + b"\0\0"


def test_zip64_directory(spark, tmp_path):
    data = zip64(package())
    with zipfile.ZipFile(io.BytesIO(data)) as z:  # the standard library agrees that this is a package
        assert z.testzip() is None
    assert read_all(spark, tmp_path, data) == (WANT, [])
    members = {m.name: m.size for m in W.directory(pa.BufferReader(package()))}
    file = _File(data)
    assert {m.name: m.size for m in W.directory(file)} == members
    list(W.ranges(file, "p"))
    archive = data.index(b"\x1f\x8b")
    assert not any(at < archive + 20 < at + n < len(data) - 100 and n > 100 for at, n in file.reads[1:])  # no archive bytes


class _File:
    """Notes what is read."""

    def __init__(self, data):
        self.inner, self.reads = pa.BufferReader(data), []

    def size(self):
        return self.inner.size()

    def read_at(self, n, at):
        self.reads.append((at, n))
        return self.inner.read_at(n, at)


def test_errors_stay_with_their_package(spark, tmp_path):
    for bad in (b"", b"no zip", package()[:-30], package(method=zipfile.ZIP_DEFLATED), zip64(package())[:-60] + package()[-22:]):
        got, errors = read_all(spark, tmp_path, bad)
        assert got == [] and errors
    whole = package()
    at = whole.index(record(2))
    broken = whole[:at] + b"\0" * 20 + whole[at + 20 :]
    got, errors = read_all(spark, tmp_path, broken, range_bytes=1)
    assert got == [w for i, w in enumerate(WANT) if i != 2] and len(errors) == 1
    missing = W.read(spark.createDataFrame([(str(tmp_path / "none.zip"),)], "path string")).collect()
    assert [bool(r.error) for r in missing] == [True]
    assert W.read(spark.createDataFrame([], "path string")).collect() == []
