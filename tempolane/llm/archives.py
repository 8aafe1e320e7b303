"""Operator 5: legacy ARC archives to WARC archives.

ARC files open with a version block (``filedesc://``) whose second line gives the version; version 1 record lines have five
fields (URL, IP address, date, content type, length), version 2 lines ten (result code, checksum, location, offset and file
name before the length). A record is its line, then exactly the declared number of bytes, then a line feed. The converter
parses these and makes the WARC record that a crawler would have written: identifier, ISO 8601 timestamp, record type,
payload and block digests. Of records with equal payloads, one is a response and the others revisit it.

Archives are gzip files with one member a record, in the shared folder; each file holds a bounded number of bytes. Files are
named by their partition, their number in it and their content, not by the attempt: a task that runs again writes the same
files again, and equal rows elsewhere have files of their own.

Defined results: a null payload is an empty one; a null URL is written as ``urn:none``; white space and control characters in a URL are
percent-encoded; null ids are written as ``-`` and come back null, lower than any other id; repeated rows give repeated
records, all of them responses where their id is the group's largest; an empty table gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempolane.llm.shared import materialise, scratch_path

#: Uncompressed bytes of one archive file, more or less (a record is never split).
ARCHIVE_BYTES = 16 << 20
#: Payloads of at least this many bytes are revisited.
REVISIT_BYTES = 0
#: First capture date of made archives; records follow by the second.
EPOCH = 946684800
SALTS = 8
NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "date"]
ARROW = pa.schema(list(zip(NAMES, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()], strict=True)))
_NAMESPACE = uuid.UUID("6f1c1d0e-5a53-5c0e-9f3b-0d8f7f1f7a11")


class Record(NamedTuple):
    """A parsed ARC record."""

    url: str
    ip: str
    date: str
    kind: str
    code: str
    block: bytes


def stamp(seconds: int) -> str:
    """Seconds since 1970 as the 14 digits of an ARC date."""
    return datetime.datetime.fromtimestamp(seconds, datetime.UTC).strftime("%Y%m%d%H%M%S")


def iso(date: str) -> str:
    """ARC date (8 to 14 digits) as a WARC date; missing digits are the least that make a date."""
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def safe_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"


# --- ARC ------------------------------------------------------------------------------------------------------------------


def arc_header(version: int, name: str, date: str) -> bytes:
    fields = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    body = f"{version} 0 tempolane\n{fields}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain " + ("200 - - 0 " + name + " ") * (version == 2) + str(len(body))
    return line.encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, date: str, kind: str, block: bytes, offset: int, name: str) -> bytes:
    middle = f" 200 {zlib.crc32(block):08x} - {offset} {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {kind}{middle} {len(block)}".encode() + b"\n" + block + b"\n"


def parse_arc(data: bytes) -> Iterator[Record]:
    """Records of an uncompressed ARC stream after its version block; malformed input raises ValueError."""
    at, version = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header line at {at} has no end")
        fields = data[at:end].decode("utf-8", "surrogateescape").split(" ")
        if version is None and not fields[0].startswith("filedesc://"):
            raise ValueError("no ARC version block")
        if version is not None and len(fields) != {1: 5, 2: 10}[version]:
            raise ValueError(f"version {version} header line at {at} has {len(fields)} fields")
        if not fields[-1].isdigit() or end + 1 + int(fields[-1]) > len(data):
            raise ValueError(f"bad declared length at {at}")
        block = data[end + 1 : end + 1 + int(fields[-1])]
        if version is None:
            version = int(block.split(b" ", 1)[0])
            if version not in (1, 2):
                raise ValueError(f"unknown ARC version {version}")
        else:
            yield Record(fields[0], fields[1], fields[2], fields[3], fields[4] if version == 2 else "", block)
        at = end + 1 + len(block)
        while data[at : at + 1] == b"\n":
            at += 1


# --- WARC -----------------------------------------------------------------------------------------------------------------


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, url: str, date: str, page: str) -> str:
    """The same record always has the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{kind} {url} {date} {page}')}>"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    head, gap, payload = block.partition(b"\r\n\r\n")
    return head + gap, payload


def header_of(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?mi)^" + name.encode() + rb": ([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace") if m else None


def to_warc(r: Record, page: str, target: str | None) -> bytes:
    """WARC record of an ARC record; ``target`` is the page that it revisits, or None for a response."""
    head, payload = split_http(r.block)
    date, url, revisit = iso(r.date), r.url, target is not None
    block = head if revisit else r.block
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id('revisit' if revisit else 'response', url, date, page)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-IP-Address: {r.ip}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"X-Page-Id: {page}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {target}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an uncompressed WARC stream."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at {at}")
        fields = dict((k.lower(), v) for k, _, v in (x.partition(": ") for x in data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]))
        size = int(fields["content-length"])
        if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"bad declared length at {at}")
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 8 + size


# --- files ----------------------------------------------------------------------------------------------------------------


def put_file(folder: str, name: str, data: bytes) -> None:
    """Write under another name and move into place: a file is whole or absent."""
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    part = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as f:
        f.write(data)
    fs.move(part, f"{base}/{name}")


def write_arc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int | None = None) -> DataFrame:
    """Write the pages as ARC files below ``folder``; gives the names. Files alternate between the versions unless one is named."""

    def run(batches):
        blocks: list[tuple[str, str, str, bytes]] = []
        size = files = 0
        partition = TaskContext.get().partitionId()

        def flush():
            key = hashlib.sha1("\n".join(f"{page} {url}" for page, url, _, _ in blocks).encode() + b"".join(zlib.crc32(b).to_bytes(4, "big") for *_, b in blocks)).hexdigest()
            v, name = version or 1 + int(key[0], 16) % 2, f"{partition:06d}-{files:06d}-{key}.arc.gz"
            first = arc_header(v, name, stamp(EPOCH))
            members, offset = [gzip.compress(first, 1, mtime=0)], len(first)
            for _, url, date, block in blocks:
                record = arc_record(v, url, date, "text/html", block, offset, name)
                members.append(gzip.compress(record, 1, mtime=0))
                offset += len(record)
            put_file(folder, name, b"".join(members))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(blocks)], pa.int64())], names=["name", "records"])

        for batch in batches:
            for page, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                payload = (html or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'-' if page is None else page}\r\n\r\n"
                blocks.append(("-" if page is None else str(page), safe_url(url), stamp(EPOCH + (page or 0) % (1 << 31)), head.encode() + payload))
                size += len(blocks[-1][3])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    blocks, size, files = [], 0, files + 1
        if blocks:
            yield flush()

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "name string, records long")


def archive_rows(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """name and content of the archives in a folder, one row a file."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)  # an empty table writes no file
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def gunzip(data: bytes) -> bytes:
    """All members of a gzip file. The input is handed on in small parts, so that many members cost no more than their bytes."""
    view, at, out = memoryview(data), 0, []
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof:
            part = view[at : at + 16384]
            if not part:
                raise ValueError("gzip member has no end")
            out.append(member.decompress(part))
            at += len(part) - len(member.unused_data)
    return b"".join(out)


def page_of(head: bytes) -> int | None:
    found = header_of(head, "X-Page-Id")
    return None if found in (None, "-") else int(found)


def arc_index(files: DataFrame) -> DataFrame:
    """File, payload digest, payload size and page of every ARC record: what decides which record is the response."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parsed = [split_http(r.block) for r in parse_arc(gunzip(data))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(parsed), pa.string()), pa.array([sha1_base32(x) for _, x in parsed], pa.string()), pa.array([len(x) for _, x in parsed], pa.int64()), pa.array([page_of(h) for h, _ in parsed], pa.int64())],
                    names=["name", "digest", "size", "page"],
                )

    return files.mapInArrow(run, "name string, digest string, size long, page long")


def revisits(index: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """For each file, the digests that several records share and the page of their response; salted, as one digest may have
    a great share of all records."""
    shared = index.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1 AND target IS NOT NULL")
    shared = shared.select("digest", "size", "target", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = index.select("name", "digest", "size").distinct().withColumn("salt", F.pmod(F.crc32("name"), F.lit(SALTS)).cast("int"))
    return own.join(shared, ["digest", "size", "salt"]).groupBy("name").agg(F.collect_list(F.struct("digest", "target")).alias("targets"))


def get_file(folder: str, name: str) -> bytes:
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
        return f.read()


def write_warc(names: DataFrame, old: str, targets: DataFrame, new: str, files: int, least: int = REVISIT_BYTES) -> DataFrame:
    """Convert the ARC files (name) below ``old`` to WARC files below ``new``; gives the names and numbers of records. Tasks
    read their files themselves, so only names and targets are shuffled; about four files make a task when there are many."""

    def run(batches):
        for batch in batches:
            for name, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = {x["digest"]: x["target"] for x in found or []}
                out = []
                for r in parse_arc(gunzip(get_file(old, name))):
                    head, payload = split_http(r.block)
                    page = page_of(head)
                    to = target.get(sha1_base32(payload)) if len(payload) >= least else None
                    out.append(gzip.compress(to_warc(r, "-" if page is None else str(page), None if to == page else to), 1, mtime=0))
                put_file(new, name.replace(".arc.gz", ".warc.gz"), b"".join(out))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(out)], pa.int64())], names=["name", "records"])

    work = names.join(targets, "name", "left").select("name", "targets").repartition(max(1, min(files, max(64, files // 4))), "name")
    return work.mapInArrow(run, "name string, records long")


def read_warc(files: DataFrame) -> DataFrame:
    """One row per WARC record of the files (name, content), from its own headers and block alone."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string"

    def run(batches):
        for batch in batches:
            for data in batch.column(1).to_pylist():
                rows = []
                for fields, block in parse_warc(gunzip(data)):
                    head, payload = split_http(block)
                    revisit = fields["warc-type"] == "revisit"
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and sha1_base32(payload) != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
                    rows.append((page_of(head), int(header_of(head, "Content-Length")), digest, fields["warc-type"], int(fields["x-refers-to-page-id"]) if revisit else None, fields["warc-record-id"], fields["warc-target-uri"], fields["warc-date"]))
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r, strict=True)) for r in rows], schema=ARROW)

    return files.mapInArrow(run, schema)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages to ARC files, ARC files to WARC files, and the records read back from these."""
    spark = pages.sparkSession
    old, new = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    written = materialise(write_arc(pages, old, id_col, url_col, html_col), "arc-names").select("name").distinct()
    targets = revisits(arc_index(archive_rows(spark, old, "*.arc.gz")))
    write_warc(written, old, targets, new, written.count()).agg(F.sum("records")).collect()
    return read_warc(archive_rows(spark, new, "*.warc.gz"))
