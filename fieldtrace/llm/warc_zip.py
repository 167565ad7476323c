"""WARC archives packaged in ZIP: written by tasks, read by ranges without extraction.

Method: an archive is a ZIP file with two stored (uncompressed) members: ``archive/data.warc.gz``, one gzip member per
record, and ``indexes/index.cdx``, a line per record with its offset and length in the first. The reader takes the end
record (and the ZIP64 locator and end record where there are any), parses the central directory with its ZIP64 fields,
finds where a member's bytes begin from its local header, reads the index, and reads records by offset and length.

Of pages with equal payloads of at least 1000 bytes the one with the largest page_id is a response, the others are
revisits that refer to it. Defined cases: a null html is an empty payload; a null url has the record's own id as
target; a null page_id is never referred to (if all are null, each is a response); rows that repeat a page_id with the
same payload are all responses or all revisits; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm import core, files
from fieldtrace.llm.registry import query

LEAST_BYTES = 1000  # payloads from here on are written once
ARCHIVE_BYTES = 16 << 20  # compressed records of one archive
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdx"


# --- records

def _target(url: str | None, page: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries the digest and length of the payload instead of the payload."""
    page = "null" if page_id is None else str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", _target(url, page)),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record; the payload is what follows the HTTP header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _page(uri: str) -> int | None:
    page = uri.removeprefix("<urn:page:").removesuffix(">")
    return None if page == "null" else int(page)


# --- archives

class ArchiveWriter:
    """Records of one archive, and the ZIP file of them."""

    def __init__(self):
        self._records, self._lines, self.size = [], [], 0

    def add(self, page_id, url, payload: bytes, digest: str, refers_to) -> None:
        packer = zlib.compressobj(6, wbits=31)
        data = packer.compress(record(page_id, url, payload, digest, refers_to)) + packer.flush()
        self._lines.append(f"{self.size} {len(data)} {'null' if page_id is None else page_id} {digest}\n")
        self._records.append(data)
        self.size += len(data)

    def write(self, out) -> None:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            with z.open(RECORDS, "w", force_zip64=True) as member:
                for data in self._records:
                    member.write(data)
            z.writestr(INDEX, "".join(self._lines))
        out.write(buffer.getbuffer())

    def __len__(self):
        return len(self._records)


class Archive:
    """Range reads from a ZIP file: directory, members, index and single records."""

    def __init__(self, ranges):
        self._file = ranges
        self.members = self._directory()

    def _directory(self) -> dict[str, tuple[int, int]]:
        """Name -> (offset of the local header, size) of the stored members."""
        tail_size = min(self._file.size, 22 + 0xFFFF)
        tail_at = self._file.size - tail_size
        tail = self._file.read(tail_at, tail_size)
        end = tail.rfind(b"PK\5\6")
        if end < 0:
            raise ValueError("no ZIP file: it has no end record")
        count, size, offset = struct.unpack_from("<HII", tail, end + 10)
        if count == 0xFFFF or 0xFFFFFFFF in (size, offset):
            locator = self._file.read(tail_at + end - 20, 20)
            if locator[:4] != b"PK\6\7":
                raise ValueError("the ZIP64 locator is missing")
            wide = self._file.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if wide[:4] != b"PK\6\6":
                raise ValueError("the ZIP64 end record is missing")
            count, size, offset = struct.unpack_from("<QQQ", wide, 32)
        data, at, found = self._file.read(offset, size), 0, {}
        for _ in range(count):
            if data[at:at + 4] != b"PK\1\2":
                raise ValueError("the central directory is broken")
            method, = struct.unpack_from("<H", data, at + 10)
            packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
            header, = struct.unpack_from("<I", data, at + 42)
            name = data[at + 46:at + 46 + n_name].decode()
            extra = data[at + 46 + n_name:at + 46 + n_name + n_extra]
            plain, packed, header = self._wide(extra, plain, packed, header)
            if method == 0:
                found[name] = (header, packed)
            at += 46 + n_name + n_extra + n_comment
        return found

    @staticmethod
    def _wide(extra: bytes, *narrow: int) -> list[int]:
        """Sizes and offset, those that do not fit 32 bits from the ZIP64 extra field, in which only they stand."""
        out, at = list(narrow), 0
        while at + 4 <= len(extra):
            tag, size = struct.unpack_from("<HH", extra, at)
            if tag == 1:
                place = at + 4
                for k, value in enumerate(out):
                    if value == 0xFFFFFFFF:
                        out[k], = struct.unpack_from("<Q", extra, place)
                        place += 8
            at += 4 + size
        return out

    def locate(self, name: str) -> tuple[int, int]:
        """(first byte, size) of a stored member in the archive."""
        header, size = self.members[name]
        local = self._file.read(header, 30)
        if local[:4] != b"PK\3\4":
            raise ValueError(f"{name} has no local header")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return header + 30 + n_name + n_extra, size

    def index(self) -> list[tuple[int, int]]:
        """(offset, length) of every record within the records' member."""
        lines = self._file.read(*self.locate(INDEX)).decode().splitlines()
        return [(int(a), int(b)) for a, b, *_ in (x.split(" ") for x in lines)]

    def records(self, most: int = 4 << 20):
        """All records as (headers, payload), in order; neighbours share a range read of about ``most`` bytes."""
        base, _ = self.locate(RECORDS)
        entries, k = self.index(), 0
        while k < len(entries):
            upto = k + 1
            while upto < len(entries) and entries[upto][0] + entries[upto][1] - entries[k][0] <= most:
                upto += 1
            first = entries[k][0]
            data = self._file.read(base + first, entries[upto - 1][0] + entries[upto - 1][1] - first)
            for offset, length in entries[k:upto]:
                yield parse(zlib.decompress(data[offset - first:offset - first + length], wbits=31))
            k = upto

    def record(self, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        """One record by the range that the index names."""
        return parse(zlib.decompress(self._file.read(self.locate(RECORDS)[0] + offset, length), wbits=31))


# --- tables

def roles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the revisits alone: light rows, so the pages themselves are not shuffled for this."""
    data = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    facts = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.sha1(data).alias("digest"), F.length(data).alias("size")).where(F.col("size") >= least)
    groups = facts.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    return facts.select("page_id", "digest").join(groups, "digest").where("NOT page_id <=> refers_to").distinct()


def _write(folder: str):
    def run(batches):
        def close(writer):
            uri = f"{folder}/{uuid.uuid4().hex}.wacz"
            files.publish(uri, writer.write)
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(writer)], pa.int64())], names=["uri", "n_records"])

        writer = ArchiveWriter()
        for batch in core.slices(batches):
            for page, url, data, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "data", "digest", "refers_to")), strict=True):
                writer.add(page, url, data, digest, refers_to)
                if writer.size >= ARCHIVE_BYTES:
                    yield close(writer)
                    writer = ArchiveWriter()
        if len(writer):
            yield close(writer)

    return run


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Write all pages as archives in the shared folder; returns the manifest (uri, n_records)."""
    spark = pages.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary").alias("data")).withColumn("digest", F.sha1("data"))
    revisits = roles(pages, id_col, html_col, least).withColumnsRenamed({"page_id": "_id", "digest": "_digest"})
    ready = rows.join(revisits, rows["page_id"].eqNullSafe(revisits["_id"]) & (rows["digest"] == revisits["_digest"]), "left")
    folder = files.new_folder(spark, "warc")
    return core.cut(ready.select("page_id", "url", "data", "digest", "refers_to").mapInArrow(_write(folder), "uri string, n_records long"))


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read(batches):
    for batch in batches:
        for uri in batch.column("uri").to_pylist():
            with files.Ranges(uri) as ranges:
                rows, held = [], 0
                for fields, payload in Archive(ranges).records():
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"a payload of {uri} is damaged")
                    rows.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], int(fields["X-Payload-Length"]) if revisit else len(payload), digest,
                                 fields["WARC-Type"], _page(fields["WARC-Refers-To"]) if revisit else None, None if revisit else payload))
                    held += len(payload)
                    if held > 4 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                yield _rows(rows)


def _rows(rows: list) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    cols = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split(" ")[0] for x in _READ.split(", ")])


def read(manifest: DataFrame) -> DataFrame:
    """All records of all archives of a manifest; a revisit has the digest and length of its payload, not the payload."""
    return manifest.select("uri").repartition(core.parts(manifest.sparkSession, 0, 1), "uri").mapInArrow(_read, _READ)


SQL = r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM m"""


@query("op9_warc_zip", SQL)
def op9(spark, sf_dir):
    return read(write(core.read(spark, sf_dir, "pages"))).drop("url", "payload")
