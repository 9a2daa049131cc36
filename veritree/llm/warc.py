"""WARC archives in ZIP packages: written with an index, and read by ranges, without extraction.

A package is a ZIP file with archives (`archive/*.warc.gz`, one gzip member a record), their indexes (`indexes/*.cdxj`) and a description.
Archives are *stored* members, so that a record's place in the package is the place of the member's data plus the record's
offset in the archive. `locate` reads the end of a package, the ZIP64 records if there are any, the central directory, the members' local headers
and the indexes, nothing else, and gives blocks of neighbouring records; `read` deals the blocks out and reads each of them as one range. Archives without index entries are one block.
A large package is read by many tasks; no task holds more than a block's compressed bytes and one record.

Writing: pages with equal payloads are found by an aggregate over SHA-256 digests, so copies of a hot payload are combined before they are exchanged and only payloads that occur twice are joined. Of a payload of
at least `least` bytes, the page with the greatest page_id is a response, others are revisits that refer to it and carry no payload; smaller payloads are all responses. A task writes its rows to packages with names of its own
in the folder shared by all executors (any that Arrow can open: a mounted path, HDFS, S3, GCS). What counts is the list of packages, a table that Spark commits: files of tasks that were lost
or ran twice are not in it.

Cases: a null html is an empty payload, and empty payloads are equal ones. A null page_id is less than all others; among rows with equal payload and page_id, or none, one is the response. A null url is left out of the record, control characters and
blanks in it are percent-encoded. Columns other than page_id, url and html are left out, whatever their names. No pages give no packages and no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import math
import re
import struct
import uuid
import zipfile
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritree.llm.common import dropped, scratch, shared_dir, slices, written

#: A task begins another package where its current one has passed this many bytes.
PACKAGE_BYTES = 256 << 20
#: Records that follow each other are read as one range of about this many bytes, and so many bytes go to a task.
BLOCK_BYTES, TASK_BYTES = 4 << 20, 32 << 20
#: Pages have no date of capture.
DATE = "2000-01-01T00:00:00Z"

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 20


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI, and the path in it; Hadoop's names of S3 are Arrow's `s3`."""
    return pa.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- records


def _headers(lines: list[tuple[str, str | None]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None).encode() + b"\r\n"


def record(kind: str, identity: str, url: str | None, payload: bytes, sha1: str, refers_to: str | None = None, refers_url: str | None = None) -> bytes:
    """A response with its payload, or a revisit without, whose HTTP headers still name the payload's length."""
    block = b"HTTP/1.1 200 OK\r\n" + _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    if kind == "response":
        block += payload
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{identity}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{sha1}"),
        ("WARC-Profile", _PROFILE if kind == "revisit" else None),
        ("WARC-Refers-To", refers_to and f"<{refers_to}>"),
        ("WARC-Refers-To-Target-URI", refers_url),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + _headers(head) + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space continues the last."""
    found: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


@dataclass
class Record:
    kind: str
    identity: str | None
    url: str | None
    stated: str | None
    refers_to: str | None
    payload: bytes | None
    payload_bytes: int | None

    @classmethod
    def parsed(cls, raw: bytes) -> Record:
        head, _, rest = raw.partition(b"\r\n\r\n")
        if not head.startswith(b"WARC/1."):
            raise ValueError("no WARC record")
        f = _fields(head)
        block = rest[: int(f["content-length"])]
        bare = lambda k: f[k].strip("<>") if k in f else None
        stated = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
        payload, size = block, len(block)
        if f.get("content-type", "").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            length = _fields(http).get("content-length", "")
            size = int(length) if length.isdigit() and f["warc-type"] == "revisit" else len(payload)
        return cls(f["warc-type"], bare("warc-record-id"), bare("warc-target-uri"), stated, bare("warc-refers-to"), None if f["warc-type"] == "revisit" else payload, size)


def records(data: Iterator[bytes], zipped: bool) -> Iterator[bytes]:
    """Each record of a range that begins and ends between records, as it is read; zipped ones are one gzip member each."""
    if zipped:
        unzip, out = zlib.decompressobj(31), []
        for chunk in data:
            while chunk:
                out.append(unzip.decompress(chunk))
                if not unzip.eof:
                    break
                yield b"".join(out)
                chunk, unzip, out = unzip.unused_data, zlib.decompressobj(31), []
        if any(out):
            raise ValueError("a record is cut off")
        return
    held = b""
    for chunk in data:
        held += chunk
        while (end := held.find(b"\r\n\r\n")) >= 0:
            size = end + 4 + int(_fields(held[:end])["content-length"]) + 4
            if len(held) < size:
                break
            yield held[:size]
            held = held[size:]
    if held:
        raise ValueError("a record is cut off")


# ---- ZIP directories


@dataclass(frozen=True)
class Member:
    """A member of a package, by its central directory entry; at is the place of its local header."""

    name: str
    method: int
    flags: int
    size: int
    at: int


def _unpacked(form: str, raw: bytes, signature: bytes) -> tuple:
    if raw[:4] != signature:
        raise ValueError("no ZIP record where one should be")
    return struct.unpack(form, raw[4 : 4 + struct.calcsize(form)])


def members(file: pa.NativeFile) -> list[Member]:
    """The central directory of a package, which is read by its end: ZIP64 records where there are any, and a shift where something stands before the package."""
    size = file.size()
    tail_at = max(0, size - 65_557)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of a central directory")
    disk, first, _, n, length, start, _ = _unpacked("<HHHHIIH", tail[end:], b"PK\x05\x06")
    stop = tail_at + end
    large = stop >= 20 and file.read_at(20, stop - 20)
    if large and large[:4] == b"PK\x06\x07":
        _, at, disks = _unpacked("<IQI", large, b"PK\x06\x07")
        if disks > 1:
            raise ValueError("a package of several files")
        found = file.read_at(56, at) if at + 56 <= size else b""
        if found[:4] != b"PK\x06\x06":  # something stands before the package: the record is the last thing before its locator
            at = stop - 20 - 56
            found = file.read_at(56, at)
        _, _, _, disk, first, _, n, length, start = _unpacked("<QHHIIQQQQ", found, b"PK\x06\x06")
        stop = at
    if disk or first:
        raise ValueError("a package of several files")
    shift = stop - length - start
    if shift < 0:
        raise ValueError("the central directory is cut off")
    raw, at, out = file.read_at(length, start + shift), 0, []
    for _ in range(n):
        _, _, flags, method, _, _, _, packed, full, names, extras, comments, _, _, _, local = _unpacked("<HHHHHHIIIHHHHHII", raw[at : at + 46], b"PK\x01\x02")
        name = raw[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra = raw[at + 46 + names : at + 46 + names + extras]
        while len(extra) >= 4:
            kind, m = struct.unpack("<HH", extra[:4])
            if kind == 1:  # in this order, each only where the entry has no room for it
                values = iter(struct.unpack(f"<{m // 8}Q", extra[4 : 4 + m // 8 * 8]))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                local = next(values) if local == 0xFFFFFFFF else local
            extra = extra[4 + m :]
        out.append(Member(name, method, flags, packed, local + shift))
        at += 46 + names + extras + comments
    return out


def data_start(file: pa.NativeFile, member: Member) -> int:
    """Where a stored member's bytes begin: behind its local header, whose name and extra fields may differ from the directory's."""
    if member.method != 0 or member.flags & 1:
        raise ValueError(f"{member.name} is not stored as it is, so it has no ranges")
    names, extras = _unpacked("<HHHHHIIIHH", file.read_at(30, member.at), b"PK\x03\x04")[-2:]
    return member.at + 30 + names + extras


def _chunks(file: pa.NativeFile, at: int, end: int) -> Iterator[bytes]:
    while at < end:
        part = file.read_at(min(_CHUNK, end - at), at)
        if not part:
            raise ValueError("a package is cut off")
        yield part
        at += len(part)


def _lines(data: Iterator[bytes], zipped: bool) -> Iterator[bytes]:
    held = b""
    for part in records(data, True) if zipped else data:
        *whole, held = (held + part).split(b"\n")
        yield from whole
    yield held


def blocks(file: pa.NativeFile) -> Iterator[tuple[int, int, bool]]:
    """(begin, end, zipped) of runs of records in the package: neighbours by the indexes, or an archive without entries as a whole."""
    found = members(file)
    places: dict[str, tuple[int, int, array]] = {}
    for m in found:
        if m.name.startswith("archive/") and m.name.endswith((".warc", ".warc.gz")):
            places[m.name.rpartition("/")[2]] = data_start(file, m), m.size, array("Q")
    for m in found:
        if m.name.startswith("indexes/") and m.name.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")):
            at = data_start(file, m)
            for line in _lines(_chunks(file, at, at + m.size), m.name.endswith(".gz")):
                brace = line.find(b"{")
                if brace < 0:
                    continue
                entry = json.loads(line[brace:])
                if entry.get("filename") in places:
                    places[entry["filename"]][2].extend((int(entry["offset"]), int(entry["length"])))
    for name, (start, size, pairs) in places.items():
        zipped = name.endswith(".gz")
        if not pairs and size:
            yield start, start + size, zipped
        begin = end = None
        for offset, length in sorted(zip(pairs[::2], pairs[1::2])):
            if offset + length > size:
                raise ValueError(f"an index names bytes past the end of {name}")
            if end is not None and (offset != end or end - begin >= BLOCK_BYTES):
                yield start + begin, start + end, zipped
                begin = None
            begin, end = offset if begin is None else begin, offset + length
        if begin is not None:
            yield start + begin, start + end, zipped


# ---- writing packages


class _Output:
    """A stream that only goes on, as zipfile needs it."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def write(self, data) -> int:
        self.stream.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass


def search_key(url: str | None) -> str:
    """A sort key of a URL: its host's parts from the last to the first, then its path."""
    try:
        parts = urlsplit(url or "")
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return (url or "-").lower()
    return (f"{host}){parts.path}" + (f"?{parts.query}" if parts.query else "")).lower()


class Package:
    """A package being written: records go to its one archive, index and description follow when it is closed."""

    def __init__(self, uri: str):
        self.uri, self.lines, self.archive_at = uri, [], 0
        fs, path = opened(uri)
        self.stream = fs.open_output_stream(path)
        self.out = _Output(self.stream)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.archive = self.zip.open("archive/records.warc.gz", "w", force_zip64=True)
        self._add(gzip.compress(b"WARC/1.1\r\n" + _headers([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", "0")]) + b"\r\n\r\n", 6, mtime=0))

    def _add(self, raw: bytes) -> None:
        self.archive.write(raw)
        self.archive_at += len(raw)

    def add(self, url: str | None, sha1: str, raw: bytes) -> None:
        packed = gzip.compress(raw, 6, mtime=0)
        stamp = re.sub("[^0-9]", "", DATE)
        entry = {"url": url, "mime": "text/html", "status": "200", "digest": f"sha1:{sha1}", "length": str(len(packed)), "offset": str(self.archive_at), "filename": "records.warc.gz"}
        self.lines.append(f"{search_key(url)} {stamp} {json.dumps(entry)}\n")
        self._add(packed)

    def close(self) -> tuple[str, int, int]:
        """(uri, bytes, records)."""
        self.archive.close()
        with self.zip.open("indexes/index.cdxj", "w", force_zip64=True) as index:
            for line in sorted(self.lines):
                index.write(line.encode())
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": "archive/records.warc.gz"}, {"path": "indexes/index.cdxj"}]}))
        self.zip.close()
        self.stream.close()
        return self.uri, self.out.at, len(self.lines)


def _clean(url: str | None) -> str | None:
    return None if url is None else re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _identity(page: int | None, row: int) -> str:
    return f"urn:x-page:{'' if page is None else page}:{row}"


def judged(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, row (a number of its own), the first_ columns of the response that a page revisits (null for responses), url and html."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.monotonically_increasing_id().alias("row"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = written(rows.withColumn("sha256", F.sha2("html", 256)), "pages")
    some = rows.filter(F.octet_length("html") >= least)
    again = some.groupBy("sha256").agg(F.max(F.struct("page_id", "row")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = written(again.select("sha256", F.col("first.page_id").alias("first_page"), F.col("first.row").alias("first_row")), "payloads")
    first = lambda c: F.when(F.col("first_row") != F.col("row"), F.col(c)).alias(c)
    return rows.join(again, "sha256", "left").select("page_id", "row", first("first_page"), first("first_row"), "url", "html")


def write(pages: DataFrame, folder: str | None = None, least: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Packages of one record a page in `folder` (by default one below the shared folder): uri, bytes, records."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/veritree-warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        fs.create_dir(path, recursive=True)
        package, done = None, []
        for batch in batches:
            for b in slices(batch):
                for page, row, first_page, first_row, url, html in zip(*(c.to_pylist() for c in b.columns)):
                    if package is not None and package.out.at >= package_bytes:
                        done.append(package.close())
                        package = None
                    package = package or Package(f"{folder}/{uuid.uuid4().hex}.wacz")
                    url, payload = _clean(url), html.encode()
                    sha1 = digest(payload)
                    kind, refers = ("response", None) if first_row is None else ("revisit", _identity(first_page, first_row))
                    package.add(url, sha1, record(kind, _identity(page, row), url, payload, sha1, refers))
        if package is not None:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], ["uri", "bytes", "records"])

    return written(judged(pages, least).mapInArrow(run, "uri string, bytes long, records long"), "packages")


# ---- reading packages


def locate(packages: DataFrame) -> DataFrame:
    """The blocks of records of packages (uri, bytes): uri, begin, end, zipped. Reads directories and indexes only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                fs, path = opened(uri)
                with fs.open_input_file(path) as file:
                    found = list(blocks(file))
                if found:
                    begin, end, zipped = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array([uri] * len(found)), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(zipped)], ["uri", "begin", "end", "zipped"])

    return packages.select("uri").mapInArrow(run, "uri string, begin long, end long, zipped boolean")


RECORDS = "uri string, record_id string, record_type string, url string, payload_bytes long, payload_digest string, digest_ok boolean, refers_to string, payload binary"


def read(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of packages (uri, bytes), but for descriptions: the columns of RECORDS. digest_ok says whether a payload has the digest that its record states; revisits have none. Without `payloads` that column is null, once digests have been checked."""
    total = packages.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    kinds = (*[pa.string()] * 4, pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = [], 0
        for batch in batches:
            for uri, begin, end, zipped in zip(*(c.to_pylist() for c in batch.columns)):
                fs, path = opened(uri)
                with fs.open_input_file(path) as file:
                    for raw in records(_chunks(file, begin, end), zipped):
                        r = Record.parsed(raw)
                        if r.kind == "warcinfo":
                            continue
                        own = None if r.payload is None else digest(r.payload)
                        made.append((uri, r.identity, r.kind, r.url, r.payload_bytes, own or r.stated, None if own is None or r.stated is None else own == r.stated, r.refers_to, r.payload if payloads else None))
                        held += len(raw) if payloads else 256
                        if held >= BLOCK_BYTES:
                            yield _rows(made, kinds)
                            made, held = [], 0
        if made:
            yield _rows(made, kinds)

    dealt = locate(packages).repartition(max(1, math.ceil(total / TASK_BYTES)))
    return dealt.mapInArrow(run, RECORDS)


def _rows(made: list[tuple], kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], [c.split()[0] for c in RECORDS.split(", ")])


def page(identity: str):
    """The page_id in a record's identity; null where it has none."""
    return F.nullif(F.regexp_extract(identity, "^urn:x-page:(-?[0-9]*):", 1), F.lit("")).cast("long")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages written to packages and read back: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id). The packages are deleted once they have been read."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/veritree-warc-{uuid.uuid4().hex}"
    with scratch(spark) as keep:
        found = read(write(pages, folder, least), payloads=False)
        out = keep(written(found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "digest_ok"), "records"))
        dropped(spark, folder)
    if not out.filter("not digest_ok").isEmpty():
        raise ValueError("a payload was read back with another digest")
    return out.drop("digest_ok")
