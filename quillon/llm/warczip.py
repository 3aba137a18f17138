"""Web archives packaged as ZIP: written from pages, and read back by ranges without extraction.

A package holds ``archive/data.warc.gz`` (stored; each record a gzip member of its own) and ``indexes/index.cdxj``
(stored; a line per record with its offset and length). Each writing task streams its records into packages of bounded
size in a folder that all machines share, and returns a row per finished package; files of tasks that were run again
are in no such row, so nothing reads them.

The reader finds the end record in a package's tail, follows the ZIP64 locator where numbers do not fit, streams the
central directory, and locates archive members and indexes. Index lines become ranges of neighbouring records, a row
each, dealt over all tasks, which read just these bytes. A member without an index is one range, read as a stream. A
package or range that cannot be read gives one row with an error and no record.

Defined results: a null html counts as empty; long ones are written and read whole; of records with equal payloads of at
least ``REVISIT`` bytes the one with the smallest page_id is the response, repeated rows of that id included, and the
others, those with a null id too, revisit it (with null ids only, all are responses); equal payloads are equal SHA-256
digests; an empty table gives no package and no row; further columns, of whatever names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import join_hot, materialize, shared_folder, small_batches

#: Bytes from which equal payloads are revisited, bytes and records of a package, bytes of a range.
REVISIT, PACKAGE_BYTES, PACKAGE_RECORDS, RANGE = 100, 256 << 20, 200_000, 4 << 20
#: The tail in which the end record lies: its own size and the longest comment, with the ZIP64 locator before it.
_TAIL = 22 + 65535 + 20
_PIECE = 1 << 20
_DATE = "1970-01-01T00:00:00Z"
_BAD_IN_URL = re.compile(r"[\x00-\x20\x7f]")

MANIFEST_SCHEMA = "path string, records long, bytes long"
RANGE_SCHEMA = "path string, start long, length long, offsets array<long>, lengths array<long>, error string"
RECORD_SCHEMA = "path string, offset long, headers map<string,string>, block binary, error string"


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The store of a path or URI and the path in it."""
    if re.match(r"[a-z][a-z0-9+.-]*://", uri) and not uri.startswith("file:"):
        return pa.fs.FileSystem.from_uri(uri)
    return pa.fs.LocalFileSystem(), re.sub(r"^file:(//)?(?=/)", "", uri)


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A response with its payload, or a revisit of the page ``first`` that has an equal one."""
    kind = "response" if first is None or first == page_id else "revisit"
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", _DATE), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Payload-Bytes", str(len(payload)))]
    if url is not None:
        fields.insert(1, ("WARC-Target-URI", _BAD_IN_URL.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if kind == "revisit":
        fields += [("WARC-Refers-To", name(first)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(fields, http + payload if kind == "response" else http)


class _Sink:
    """What a ZIP writer needs of an output that cannot seek."""

    def __init__(self, stream):
        self.write, self.flush = stream.write, lambda: None


class Package:
    """One package while it is written: records stream into the stored archive member, the index follows."""

    def __init__(self, store: pa.fs.FileSystem, base: str, folder: str, name: str):
        self.path, self.lines, self.at = f"{folder}/{name}", [], 0
        self.stream = store.open_output_stream(f"{base}/{name}", compression=None)
        self.zip = zipfile.ZipFile(_Sink(self.stream), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo("archive/data.warc.gz"), "w", force_zip64=True)

    def add(self, record: bytes, key: str) -> None:
        self.member.write(record)
        self.lines.append(f"{key} {json.dumps({'offset': str(self.at), 'length': str(len(record)), 'filename': 'data.warc.gz'})}\n")
        self.at += len(record)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo("indexes/index.cdxj"), "".join(self.lines))
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": [{"path": "archive/data.warc.gz", "bytes": self.at}, {"path": "indexes/index.cdxj"}]}))
        self.zip.close()
        self.stream.close()
        return self.path, len(self.lines), self.at


def write(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes (page_id, url, html) as packages into the folder; a row per package: path, records, bytes."""
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long = rows.where(F.length("payload") >= REVISIT)
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    known = join_hot(rows, materialize(firsts), "digest", "n").select("page_id", "url", "payload", "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        context = TaskContext.get()
        part, package, made = context.partitionId() if context else 0, None, 0
        row = lambda p: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(p.close(), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])
        for batch in batches:
            for page, url, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if package is None:
                    store.create_dir(base, recursive=True)
                    package = Package(store, base, folder, f"part-{part:05d}-{made:04d}-{uuid.uuid4().hex}.zip")
                    made += 1
                package.add(page_record(page, url, payload, digest, first), str(page))
                if package.at >= package_bytes or len(package.lines) >= PACKAGE_RECORDS:
                    yield row(package)
                    package = None
        if package is not None:
            yield row(package)

    return materialize(known.mapInArrow(run, MANIFEST_SCHEMA))


# --- reading


class Member:
    """An entry of a central directory."""

    def __init__(self, name: str, method: int, flags: int, size: int, full: int, header: int):
        self.name, self.method, self.flags, self.size, self.full, self.header = name, method, flags, size, full, header

    def start(self, file) -> int:
        """Where the member's bytes begin: its local header has name and extra lengths of its own."""
        local = _exactly(file, self.header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {self.name}")
        name, extra = struct.unpack_from("<HH", local, 26)
        return self.header + 30 + name + extra


def _exactly(file, at: int, n: int) -> bytes:
    data = file.read_at(n, at) if n and at >= 0 else b""
    if len(data) != n:
        raise ValueError(f"{n} bytes at {at} are not there")
    return data


def directory(file) -> Iterator[Member]:
    """The members of a package, from its central directory, read in pieces."""
    size = file.size()
    tail_at = max(0, size - _TAIL)
    tail = _exactly(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of a central directory")
    entries, length, at = struct.unpack_from("<HII", tail, end + 10)
    if entries == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF:
        if end < 20 or tail[end - 20 : end - 16] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        wide = _exactly(file, struct.unpack_from("<Q", tail, end - 12)[0], 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        entries, length, at = struct.unpack_from("<QQQ", wide, 32)
    held, pos, stop = b"", at, at + length
    for _ in range(entries):
        while len(held) < 46 or len(held) < 46 + sum(struct.unpack_from("<HHH", held, 28)):
            if pos >= stop:
                raise ValueError("the central directory ends early")
            n = min(_PIECE, stop - pos)
            held += _exactly(file, pos, n)
            pos += n
        if held[:4] != b"PK\x01\x02":
            raise ValueError("no entry of a central directory")
        flags, method = struct.unpack_from("<HH", held, 8)
        packed, full, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", held, 20)
        header = struct.unpack_from("<I", held, 42)[0]
        name, extra = held[46 : 46 + name_n], held[46 + name_n : 46 + name_n + extra_n]
        full, packed, header = _wide(extra, full, packed, header)
        held = held[46 + name_n + extra_n + comment_n :]
        yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, flags, packed, full, header)


def _wide(extra: bytes, *values: int) -> list[int]:
    """Values that say 0xFFFFFFFF, from the ZIP64 field, which holds just these in order."""
    out, at = list(values), 0
    wide = b""
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            wide = extra[at + 4 : at + 4 + n]
            break
        at += 4 + n
    for i, value in enumerate(values):
        if value == 0xFFFFFFFF:
            if len(wide) < 8:
                raise ValueError("a ZIP64 field is too short")
            out[i], wide = struct.unpack_from("<Q", wide)[0], wide[8:]
    return out


def _bytes_of(file, member: Member) -> Iterator[bytes]:
    """A member's content in pieces; indexes may be deflated, archives are not."""
    if member.flags & 1 or member.method not in (0, 8):
        raise ValueError(f"{member.name} is encrypted or packed in an unknown way")
    at, left = member.start(file), member.size
    unpack = zlib.decompressobj(-15) if member.method == 8 else None
    while left:
        piece = _exactly(file, at, min(_PIECE, left))
        at, left = at + len(piece), left - len(piece)
        if unpack is None:
            yield piece
            continue
        while piece:  # no more than a piece at once, however well it was packed
            yield unpack.decompress(piece, _PIECE)
            piece = unpack.unconsumed_tail
    if unpack is not None:
        yield unpack.flush()


def _lines(pieces: Iterator[bytes], gz: bool) -> Iterator[bytes]:
    unpack, held = zlib.decompressobj(47) if gz else None, b""
    for piece in pieces:
        if unpack is not None:
            out = b""
            while piece:
                out += unpack.decompress(piece)
                piece = unpack.unused_data
                if unpack.eof and piece:
                    unpack = zlib.decompressobj(47)
            piece = out
        *whole, held = (held + piece).split(b"\n")
        yield from whole
    if held:
        yield held


def ranges(file, path: str, size: int = RANGE) -> Iterator[tuple]:
    """Rows of ``RANGE_SCHEMA``: neighbouring records of each stored archive member, as its index lists them."""
    members = list(directory(file))
    archives = {m.name.rpartition("/")[2]: m for m in members if m.name.startswith("archive/") and m.name.endswith((".warc", ".warc.gz"))}
    listed: set[str] = set()
    for member in members:
        if not (member.name.startswith("indexes/") and re.search(r"\.cdxj?(\.gz)?$", member.name)):
            continue
        run: dict[str, tuple[int, list[int], list[int]]] = {}
        for line in _lines(_bytes_of(file, member), member.name.endswith(".gz")):
            if b"{" not in line:
                continue
            entry = json.loads(line[line.index(b"{") :])
            name, at, n = entry["filename"].rpartition("/")[2], int(entry["offset"]), int(entry["length"])
            archive = archives.get(name)
            if archive is None or archive.method or archive.flags & 1 or at < 0 or n <= 0 or at + n > archive.size:
                yield path, 0, 0, [], [], f"{entry['filename']}: {n} bytes at {at} are not in a stored member"
                continue
            listed.add(name)
            start, offsets, lengths = run.get(name) or (archive.start(file), [], [])
            if offsets and (at != offsets[-1] + lengths[-1] or at + n - offsets[0] > size):
                yield path, start + offsets[0], offsets[-1] + lengths[-1] - offsets[0], offsets, lengths, None
                offsets, lengths = [], []
            offsets.append(at)
            lengths.append(n)
            run[name] = (start, offsets, lengths)
        for start, offsets, lengths in run.values():
            yield path, start + offsets[0], offsets[-1] + lengths[-1] - offsets[0], offsets, lengths, None
    for name, archive in archives.items():
        if name not in listed:
            if archive.method or archive.flags & 1:
                yield path, 0, 0, [], [], f"{archive.name} is not stored"
            else:
                yield path, archive.start(file), archive.size, [], [], None


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *fields = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip(): v.strip() for k, _, v in (f.partition(":") for f in fields)}
    n = int(headers["Content-Length"])
    if len(rest) < n:
        raise ValueError("a record ends early")
    return headers, rest[:n]


def _streamed(file, start: int, length: int) -> Iterator[tuple[int, bytes]]:
    """Gzip members of a stretch that no index describes, with their offsets."""
    at, begun, held, out = 0, 0, b"", b""
    unpack = zlib.decompressobj(31)
    while at < length or held:
        if not held:
            held = _exactly(file, start + at, min(_PIECE, length - at))
            at += len(held)
        out += unpack.decompress(held)
        held = unpack.unused_data if unpack.eof else b""
        if unpack.eof:
            yield begun, out
            begun, out, unpack = at - len(held), b"", zlib.decompressobj(31)
    if out or begun < length:
        raise ValueError("the archive ends within a record")


def read(packages: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """Every record of the packages named in ``path``: path, offset, headers, block; or an error."""
    spark = packages.sparkSession
    small_batches(spark)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
        names = [f.split()[0] for f in RANGE_SCHEMA.split(", ")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    store, inner = filesystem(path)
                    with store.open_input_file(inner) as file:
                        for row in ranges(file, path, range_bytes):
                            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)
                except (OSError, ValueError, KeyError, struct.error, zlib.error) as problem:
                    row = (path, 0, 0, [], [], f"{type(problem).__name__}: {problem}"[:500])
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]
        names = ["path", "offset", "headers", "block", "error"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for row in batch.to_pylist():
                if row["error"] is not None:
                    yield batch_of([(row["path"], None, None, None, row["error"])])
                    continue
                rows, held = [], 0
                try:
                    store, inner = filesystem(row["path"])
                    with store.open_input_file(inner) as file:
                        if row["offsets"]:
                            data, first = _exactly(file, row["start"], row["length"]), row["offsets"][0]
                            found = ((at, data[at - first : at - first + n]) for at, n in zip(row["offsets"], row["lengths"], strict=True))
                            found = ((at, zlib.decompress(x, 31) if x[:2] == b"\x1f\x8b" else x) for at, x in found)
                        else:
                            found = _streamed(file, row["start"], row["length"])
                        for at, raw in found:
                            headers, block = _parse(raw)
                            rows.append((row["path"], at, list(headers.items()), block, None))
                            held += len(block)
                            if held >= range_bytes:
                                yield batch_of(rows)
                                rows, held = [], 0
                except (OSError, ValueError, KeyError, zlib.error) as problem:
                    rows.append((row["path"], None, None, None, f"{type(problem).__name__}: {problem}"[:500]))
                if rows:
                    yield batch_of(rows)

    found = packages.select("path").repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(locate, RANGE_SCHEMA)
    return found.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(fetch, RECORD_SCHEMA)


def payload_digests(records: DataFrame) -> DataFrame:
    """Of page records: page_id, payload_bytes, payload_digest, record_type and refers_to.

    A response's digest and length are those of the payload that was read; a revisit names its response's."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", name or "")) else None
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for pairs, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                headers = dict(pairs)
                payload = block.partition(b"\r\n\r\n")[2]
                digest, n = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["Payload-Bytes"])
                if headers["WARC-Type"] == "response":
                    found = hashlib.sha256(payload).hexdigest()
                    if (found, len(payload)) != (digest, n):
                        raise ValueError(f"the payload of {headers['WARC-Record-ID']} is not the one written")
                row = (number(headers["WARC-Record-ID"]), n, digest, headers["WARC-Type"], number(headers.get("WARC-Refers-To")))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])

    broken = F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "path", "error")))
    whole = records.withColumn("headers", F.coalesce(broken.cast("map<string,string>"), F.col("headers")))
    return whole.select("headers", "block").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages as packages, reads these back, and removes them when their records are digested."""
    folder = f"{shared_folder(pages.sparkSession).rstrip('/')}/packages-{uuid.uuid4().hex}"
    out = materialize(payload_digests(read(write(pages, folder))))
    store, path = filesystem(folder)
    if store.get_file_info(path).type == pa.fs.FileType.Directory:
        store.delete_dir(path)
    return out
