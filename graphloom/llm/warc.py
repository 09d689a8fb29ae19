"""Web archives in ZIP packages: writing, and reading by ranges without extraction.

A package holds ``archive/data.warc.gz`` (each record a gzip member) and
``indexes/index.cdxj`` as stored members. The reader parses the end of central directory, its
ZIP64 forms and the central directory itself, finds where the stored members lie, and reads
the index and then only the ranges that records occupy.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import cut, folder

#: Payloads from this size on are written once; bytes of a package before the next begins; bytes read at a time.
MIN_REVISIT, PACKAGE, RANGE = 1000, 64 << 20, 4 << 20
WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def _path(uri: str) -> str | None:
    u = urlsplit(uri)
    return u.path if u.scheme in ("", "file") else None


def _open(uri: str):
    """A seekable reader: plain files by open(), other stores by Arrow."""
    if p := _path(uri):
        return open(p, "rb")
    from pyarrow import fs

    store, p = fs.FileSystem.from_uri(uri)
    return store.open_input_file(p)


def _put(uri: str, data: bytes) -> None:
    if p := _path(uri):
        import os

        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(data)
        return
    from pyarrow import fs

    store, p = fs.FileSystem.from_uri(uri)
    store.create_dir(p.rpartition("/")[0], recursive=True)
    with store.open_output_stream(p) as f:
        f.write(data)


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """name -> (offset of the data, length) of the stored members of a ZIP file of ``size`` bytes."""
    back = min(size, 65535 + 22 + 20)
    f.seek(size - back)
    tail = f.read(back)
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    end = size - back + at
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        f.seek(end - 20)
        mark, _, where, _ = struct.unpack("<4sIQI", f.read(20))
        if mark != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        f.seek(where)
        mark, *_, count, length, start = struct.unpack("<4sQHHIIQQQQ", f.read(56))
        if mark != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
    f.seek(start)
    directory, at, out = f.read(length), 0, {}
    for _ in range(count):
        mark, _, _, _, method, _, _, _, packed, plain, n, x, c, _, _, _, offset = struct.unpack_from("<4s6H3I5H2I", directory, at)
        if mark != b"PK\1\2":
            raise ValueError("broken central directory")
        name = directory[at + 46 : at + 46 + n].decode()
        extra, e = directory[at + 46 + n : at + 46 + n + x], 0
        while e + 4 <= len(extra):
            kind, long = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # the fields that are all ones above, in this order
                wide = iter(struct.unpack_from(f"<{long // 8}Q", extra, e + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            e += 4 + long
        at += 46 + n + x + c
        if method == 0:
            f.seek(offset)
            mark, n, x = struct.unpack("<4s22x2H", f.read(30))
            if mark != b"PK\3\4":
                raise ValueError("broken local header")
            out[name] = offset + 30 + n + x, packed
    return out


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member; a revisit has no block."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {(url or '').replace(chr(13), ' ').replace(chr(10), ' ')}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", "Content-Type: text/html; charset=utf-8"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record read from a package."""
    raw = gzip.decompress(member)
    end = raw.index(b"\r\n\r\n")
    first, *lines = raw[:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    return head, raw[end + 4 : end + 4 + int(head["Content-Length"])]


def _write(where: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, index = io.BytesIO(), []

        def package() -> pa.RecordBatch:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                z.writestr(WARC, data.getbuffer())
                z.writestr(INDEX, "\n".join(json.dumps(x) for x in index))
            _put(uri := f"{where}/{uuid.uuid4().hex}.wacz", out.getvalue())  # a retried task writes other files; only those it reports count
            done = pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([out.tell() or len(out.getvalue())], pa.int64()), pa.array([len(index)], pa.int64())], ["uri", "bytes", "records"])
            data.seek(0)
            data.truncate()
            index.clear()
            return done

        for b in batches:
            for page, url, html, digest, to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                member = record(page, url, (html or "").encode(), digest, to)
                index.append({"page_id": page, "offset": data.tell(), "length": len(member)})
                data.write(member)
                if data.tell() >= PACKAGE:
                    yield package()
        if index:
            yield package()

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of about RANGE bytes of whole records, from the index of each package."""
    for b in batches:
        for uri, size in zip(b.column("uri").to_pylist(), b.column("bytes").to_pylist(), strict=True):
            with _open(uri) as f:
                inside = members(f, size)
                start, _ = inside[WARC]
                at, long = inside[INDEX]
                f.seek(at)
                lines = [json.loads(x) for x in f.read(long).decode().split("\n") if x]
            rows, parts = [], []
            for k, x in enumerate(lines):
                parts.append(x["length"])
                first = lines[k + 1 - len(parts)]["offset"]
                if k == len(lines) - 1 or x["offset"] + x["length"] - first >= RANGE:
                    rows.append((uri, start + first, parts))
                    parts = []
            yield pa.RecordBatch.from_pylist([dict(zip(("uri", "offset", "lengths"), r, strict=True)) for r in rows], pa.schema([("uri", pa.string()), ("offset", pa.int64()), ("lengths", pa.list_(pa.int64()))]))


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x else None
        for b in batches:
            for r in b.to_pylist():
                rows = []
                with _open(r["uri"]) as f:
                    f.seek(r["offset"])
                    data, at = f.read(sum(r["lengths"])), 0
                for n in r["lengths"]:
                    head, block = parse(data[at : at + n])
                    at += n
                    own = head["WARC-Type"] == "response"
                    rows.append({"page_id": number(head["X-Page-ID"]), "url": head["WARC-Target-URI"], "record_type": head["WARC-Type"], "refers_to": number(head.get("X-Refers-To-Page-ID")), "digest": hashlib.sha1(block).hexdigest() if own else head["WARC-Payload-Digest"].removeprefix("sha1:"), "n": len(block) if own else None, "payload": block if payloads else None})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("n", pa.int64()), ("payload", pa.binary())]))

    return run


def write_packages(pages: DataFrame) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html; others are not read) and list the packages.

    Gives (uri, bytes, records) of files in the shared scratch folder. Of records with equal
    payloads of at least MIN_REVISIT bytes, that with the largest page_id is a response and the
    others revisit it (with equal ids, or only null ones, each of those is a response). A null
    html is empty.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    groups = rows.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(groups, "digest", "left").withColumn("refers_to", F.when((F.col("page_id") < F.col("last")) | F.col("page_id").isNull(), F.col("last")))
    where = folder(pages.sparkSession, "packages")
    packages = rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_write(where), "uri string, bytes long, records long")
    return cut(packages, "manifest")[0]


def read_packages(spark: SparkSession, packages: DataFrame, payloads: bool = False) -> DataFrame:
    """Read every record of the listed packages by ranges.

    Gives page_id, url, payload_bytes, payload_digest, record_type and refers_to, and with
    ``payloads`` the block. A revisit's digest and size are those of the response it refers to.
    """
    parts = spark.sparkContext.defaultParallelism
    ranges = packages.mapInArrow(_ranges, "uri string, offset long, lengths array<long>").repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = ranges.mapInArrow(_read(payloads), "page_id long, url string, record_type string, refers_to long, digest string, n long, payload binary")
    found = cut(found, "records")[0]
    first = found.where("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("to"), F.col("digest").alias("same"), F.col("n").alias("full")).distinct()
    out = found.join(first, (F.col("refers_to") == F.col("to")) & (F.col("digest") == F.col("same")), "left")
    keep = ["page_id", "url", F.coalesce("n", "full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"]
    return out.select(*keep, *(["payload"] if payloads else []))
