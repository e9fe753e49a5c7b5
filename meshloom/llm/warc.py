"""Operator 6 - WARC records in ZIP packages, read back by range.

Writing: every task writes packages of at most PACKAGE_BYTES, ZIP files whose
members are stored, not deflated: archive/data.warc.gz, one gzip member for each
record, and indexes/index.jsonl with each record's place in it. A record of a
payload that another page with a smaller id has too is a revisit of that page.
Packages have names of their own for each attempt of a task; only those in the
written manifest are read, so a lost executor leaves at worst an unused file.

Reading: a package is never extracted. From its end the reader finds the end of
central directory record (the ZIP64 one where there is one), parses the central
directory with ZIP64 extras, and finds the data of stored members by their local
headers. The index gives ranges of about RANGE_BYTES; these are dealt evenly
over tasks, and each task reads only its range, record by record.

Paths are in the shared folder and opened by pyarrow's file systems, so any
store that executors share will do. Memory is bounded by a record and a range.

Null html is an empty payload; a null url is written as an empty target. Every row
gives a record, decided by its payload's digest and its id, never by the id alone: of
repeated rows with the smallest id of their payload each is a response; all other rows
of that payload, those without an id too, revisit it. If no row of a payload has an id,
all are responses. Ties of the URL that a revisit names go to the smallest. A payload of
any length is one record, held whole by one task. An empty table gives no package and no
rows. Other columns are unused, so their names cannot clash.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, new_path, read_table

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
PACKAGE_BYTES = 256 << 20
RANGE_BYTES = 4 << 20
#: Digests of repeated payloads that are broadcast, some 30 MB; beyond that the pages are shuffled by digest.
BROADCAST_ROWS = 200_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def _fs(path: str):
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs, inner


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url: str, payload: bytes, refers_to=None, refers_url: str = "") -> bytes:
    """One WARC/1.1 record: a response, or a revisit without its payload."""
    http = _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Target-URI", _line(url)), ("Content-Type", "application/http; msgtype=response"),
            ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Refers-To-Target-URI", _line(refers_url))]
    head.append(("Content-Length", str(len(block))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; the block's length and digest must hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(headers["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != "sha1:" + digest(block):
        raise ValueError("damaged WARC record " + headers.get("WARC-Record-ID", ""))
    return headers, block


class _Package:
    def __init__(self, base: str):
        self.path = f"{base}/{uuid.uuid4().hex}.zip"
        fs, inner = _fs(self.path)
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(inner)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(ARCHIVE, "w", force_zip64=True)
        self.index, self.at = io.StringIO(), 0

    def add(self, raw: bytes) -> None:
        packed = gzip.compress(raw, 4, mtime=0)
        self.member.write(packed)
        self.index.write(json.dumps([self.at, len(packed)]) + "\n")
        self.at += len(packed)

    def close(self) -> str:
        self.member.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as f:
            f.write(self.index.getvalue().encode())
        self.zip.close()
        self.out.close()
        return self.path


def _write(base: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        package = None
        for pdf in frames:
            for page, url, html, first, first_url in zip(*(pdf[c] for c in pdf.columns)):
                if package is None:
                    package = _Package(base)
                package.add(record(
                    None if pd.isna(page) else int(page), url or "", (html or "").encode(),
                    None if pd.isna(first) else int(first), first_url or ""))
                if package.at >= PACKAGE_BYTES:
                    yield pd.DataFrame({"package": [package.close()]})
                    package = None
        if package is not None:
            yield pd.DataFrame({"package": [package.close()]})

    return run


class ZipReader:
    """Stored members of a ZIP file by range reads."""

    def __init__(self, path: str):
        fs, inner = _fs(path)
        self.file = fs.open_input_file(inner)
        self.size = self.file.size()
        self.members = {name: place for name, *place in self._directory()}

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        got = self.file.read(n)
        if len(got) != n:
            raise ValueError("ZIP file ends early")
        return got

    def close(self) -> None:
        self.file.close()

    def _directory(self):
        tail_at = max(0, self.size - 65557)
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        count, size, at = struct.unpack_from("<10xHII", tail, end)
        if count == 0xFFFF or size == 0xFFFFFFFF or at == 0xFFFFFFFF:
            mark, where = struct.unpack("<I4xQ", self.read(tail_at + end - 20, 16))
            if mark != 0x07064B50:
                raise ValueError("no ZIP64 locator")
            big = self.read(where, 56)
            if big[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, size, at = struct.unpack_from("<32xQQQ", big)
        block, pos = self.read(at, size), 0
        for _ in range(count):
            (mark, method, _, packed, full, n_name, n_extra, n_note, local) = struct.unpack_from(
                "<I6xH4xIIIHHH8xI", block, pos)
            if mark != 0x02014B50:
                raise ValueError("damaged central directory")
            name = block[pos + 46:pos + 46 + n_name].decode()
            extra, p = block[pos + 46 + n_name:pos + 46 + n_name + n_extra], 0
            while p + 4 <= len(extra):
                kind, length = struct.unpack_from("<HH", extra, p)
                if kind == 1:
                    q = p + 4
                    if full == 0xFFFFFFFF:
                        full, q = struct.unpack_from("<Q", extra, q)[0], q + 8
                    if packed == 0xFFFFFFFF:
                        packed, q = struct.unpack_from("<Q", extra, q)[0], q + 8
                    if local == 0xFFFFFFFF:
                        local = struct.unpack_from("<Q", extra, q)[0]
                p += 4 + length
            yield name, method, packed, local
            pos += 46 + n_name + n_extra + n_note

    def stored(self, name: str) -> tuple[int, int]:
        """Where a stored member's data begins, and its length."""
        method, size, local = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is not stored")
        head = self.read(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("damaged local header")
        n_name, n_extra = struct.unpack_from("<26xHH", head)
        return local + 30 + n_name + n_extra, size


def _ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for path in pdf["package"]:
            z = ZipReader(path)
            base, _ = z.stored(ARCHIVE)
            at, size = z.stored(INDEX)
            rows, lens = [], []
            for line in z.read(at, size).decode().splitlines():
                lo, n = json.loads(line)
                lens.append(n)
                if not rows or lo + n - rows[-1][1] > RANGE_BYTES:
                    rows.append([path, lo, [], base])
                rows[-1][2].append(n)
            z.close()
            yield pd.DataFrame({"path": [r[0] for r in rows], "start": [r[3] + r[1] for r in rows],
                                "lengths": [r[2] for r in rows]})


def _records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for path, start, lengths in zip(pdf["path"], pdf["start"], pdf["lengths"]):
            z = ZipReader(path)
            raw, at, out = z.read(int(start), int(sum(lengths))), 0, []
            z.close()
            for n in lengths:
                headers, block = parse(zlib.decompress(raw[at:at + n], 31))
                at += n
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(http.rpartition(b"Content-Length: ")[2])
                kind, mark = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload) != size or digest(payload) != mark):
                    raise ValueError("damaged payload in " + headers["WARC-Record-ID"])
                ids = [headers.get(k, "").removeprefix("<urn:page:").rstrip(">")
                       for k in ("WARC-Record-ID", "WARC-Refers-To")]
                out.append((ids[0], headers["WARC-Target-URI"], size, mark, kind, ids[1],
                            payload if kind == "response" else None))
            yield pd.DataFrame(out, columns=["id", "url", "payload_bytes", "payload_digest", "record_type", "to", "payload"])


def write_packages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = 0) -> DataFrame:
    """Write all pages; returns the manifest, one row (package) for each file.
    Payloads of at least min_bytes are written once."""
    shelf = Shelf(pages.sparkSession, "warc")
    html = F.coalesce(F.col(html_col), F.lit(""))
    page = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("html"),
                        F.sha1(F.encode(html, "UTF-8")).alias("mark"))
    # One row for each payload of several pages; copies meet as counts before the shuffle.
    firsts = shelf.put("firsts", page.where(F.octet_length("html") >= min_bytes).groupBy("mark").agg(
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select("mark", F.col("first.id").alias("first"), F.col("first.url").alias("first_url")))
    few = firsts.count() <= BROADCAST_ROWS
    todo = page.join(F.broadcast(firsts) if few else firsts, "mark", "left")
    other = F.col("id").isNull() | (F.col("id") != F.col("first"))
    todo = todo.select("id", "url", "html", F.when(other, F.col("first")).alias("first"), "first_url")
    return shelf.put("manifest", todo.mapInPandas(_write(new_path(pages.sparkSession, "packages")), "package string"))


def read_packages(manifest: DataFrame) -> DataFrame:
    """One row for each record of the packages: id, url, payload_bytes,
    payload_digest, record_type, refers_to, payload (null for revisits)."""
    spark = manifest.sparkSession
    ranges = manifest.mapInPandas(_ranges, "path string, start long, lengths array<long>")
    dealt = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    number = lambda c: F.try_to_number(F.col(c), F.lit("S9999999999999999999")).cast("long")
    return (dealt.mapInPandas(_records, "id string, url string, payload_bytes long, payload_digest string, "
                                        "record_type string, to string, payload binary")
            .select(number("id").alias("id"), "url", "payload_bytes", "payload_digest", "record_type",
                    number("to").alias("refers_to"), "payload"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_packages(write_packages(read_table(spark, sf_dir, "pages")))
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL of op6_warc(): base32 is 5 bits a sign, so 5 hexadecimal digits are 4 signs.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, h, sha1(h) AS x, min(page_id) OVER (PARTITION BY sha1(h)) AS first FROM p),
b AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(x, CAST(5 * i + 1 AS INT), 5) AS BIGINT)) AS five FROM m)
SELECT page_id, strlen(h) AS payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((five[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
