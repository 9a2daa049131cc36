import base64
import gzip
import hashlib
import io
import json
import random
import zipfile

import pyarrow as pa
import pytest

from veritree.llm import queries, warc

SCHEMA = "page_id long, url string, html string, row int, sha256 string, `payload` int"


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows, least=0):
    best, out = {}, []
    for k, (page, _, html) in enumerate(rows):
        best.setdefault(html or "", []).append((page is not None, page or 0, k, page))
    for k, (page, _, html) in enumerate(rows):
        top = max(best[html or ""])
        first = len((html or "").encode()) < least or top[2] == k
        out.append((page, len((html or "").encode()), sha1(html), "response" if first else "revisit", None if first else top[3]))
    return sorted(out, key=str)


def invented():
    r = random.Random(8)
    rows = [(k, f"http://h{k % 5}.example.com/a b\r\nX: {k}", r.choice(["same", "", None, f"own é日 {k}", "x" * 5000])) for k in range(120)]
    rows += [(None, None, "same"), (None, None, None), (3, "u", "twice"), (3, "u", "twice"), (3, "v", "twice"), (None, "n", "none"), (None, "n", "none"), (-5, "http://[bad", "\r\n\r\nWARC/1.1\r\n"), (9, "z", "long " * 400_000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def test_the_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    out = queries.op12_warc(spark, sf)
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("least", [0, 100])
def test_odd_pages_equal_brute_force(spark, least):
    rows = invented()
    got = sorted((tuple(r) for r in warc.round_trip(frame(spark, rows).repartition(3), least).collect()), key=str)
    assert got == brute(rows, least)


def test_payloads_come_back_and_packages_are_small(spark):
    rows = invented()
    made = warc.write(frame(spark, rows), package_bytes=20_000)
    found = made.collect()
    assert len(found) > 3 and sum(r.records for r in found) == len(rows)
    got = warc.read(made).collect()
    assert len(got) == len(rows) and all(r.digest_ok for r in got if r.record_type == "response")
    assert sorted(r.payload for r in got if r.payload is not None) == sorted({(h or "").encode() for _, _, h in rows})
    assert all(r.url is None or ("\n" not in r.url and " " not in r.url) for r in got)
    # what other tools see: an ordinary ZIP file of gzip members
    with zipfile.ZipFile(found[0].uri.removeprefix("file://")) as z:
        assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        assert gzip.decompress(z.read("archive/records.warc.gz")).startswith(b"WARC/1.1\r\n")
        lines = z.read("indexes/index.cdxj").decode().splitlines()
        assert lines == sorted(lines)


def test_no_pages(spark):
    empty = frame(spark, [])
    assert warc.write(empty).count() == 0 and warc.round_trip(empty).count() == 0


def packed(entries, prefix=b"", comment=b"", method=zipfile.ZIP_STORED):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", method) as z:
        for name, data in entries:
            z.writestr(name, data)
        z.comment = comment
    return prefix + raw.getvalue()


def one(k):
    return warc.record("response", f"urn:x-page:{k}:{k}", f"http://e.com/{k}", b"page %d" % k, warc.digest(b"page %d" % k))


def read_all(raw):
    with pa.BufferReader(raw) as file:
        return [warc.Record.parsed(x).payload for begin, end, zipped in warc.blocks(file) for x in warc.records(warc._chunks(file, begin, end), zipped)]


def archive(zipped, keys):
    parts = [gzip.compress(one(k)) if zipped else one(k) for k in keys]
    offsets = [sum(map(len, parts[:i])) for i in range(len(parts))]
    name = "a.warc.gz" if zipped else "a.warc"
    return name, b"".join(parts), [json.dumps({"offset": str(o), "length": len(p), "filename": name}) for o, p in zip(offsets, parts)]


@pytest.mark.parametrize("limit", [None, 100, 1])
@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("prefix", [b"", b"#!/bin/sh\n" * 7])
def test_directories(monkeypatch, limit, zipped, prefix):
    if limit is not None:  # ZIP64 records for everything past the limit
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    name, data, lines = archive(zipped, range(20))
    whole = [b"page %d" % k for k in range(20)]
    index = "".join(f"com,e)/{k} 2000 {x}\n" for k, x in reversed(list(enumerate(lines))))
    other = ("datapackage.json", b"{}")
    for comment in (b"", b"PK\x05\x06 in a comment of some length"):
        assert read_all(packed([(f"archive/{name}", data), ("indexes/i.cdxj", index), other], prefix, comment)) == whole
    assert read_all(packed([(f"archive/{name}", data), ("indexes/i.cdx.gz", gzip.compress(index.encode()))], prefix)) == whole
    assert read_all(packed([(f"archive/{name}", data)], prefix)) == whole
    some = "".join(f"k 2000 {lines[k]}\n" for k in (3, 4, 9))
    assert read_all(packed([("indexes/i.cdxj", some), (f"archive/{name}", data)], prefix)) == [whole[3], whole[4], whole[9]]


def test_blocks_are_ranges_of_neighbours(monkeypatch):
    name, data, lines = archive(True, range(50))
    raw = packed([(f"archive/{name}", data), ("indexes/i.cdxj", "".join(f"k 2000 {x}\n" for x in lines))])
    for size, n in ((1, 50), (1 << 20, 1)):
        monkeypatch.setattr(warc, "BLOCK_BYTES", size)
        with pa.BufferReader(raw) as file:
            assert len(list(warc.blocks(file))) == n


def test_what_is_refused():
    name, data, lines = archive(True, range(3))
    good = packed([(f"archive/{name}", data)])
    for bad in (b"", b"no package", good[:-30], packed([(f"archive/{name}", data)], method=zipfile.ZIP_DEFLATED), packed([(f"archive/{name}", data[:-9])])):
        with pytest.raises(ValueError):
            read_all(bad)
    past = json.dumps({"offset": 10**6, "length": 5, "filename": name})
    with pytest.raises(ValueError):
        read_all(packed([(f"archive/{name}", data), ("indexes/i.cdxj", f"k 2000 {past}\n")]))
