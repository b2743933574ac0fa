"""Legacy archive converter: ARC records, version 1 or 2, as WARC records.

The version block that opens an archive tells which fields header lines have;
contents are cut by the lengths that they declare. Each record gets a WARC
identifier, timestamp, type and digests that depend on its contents alone.
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
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: URLs and content types may hold spaces; the fields around them may not.
HEADER = {
    1: re.compile(rb"(?P<url>\S.*?) (?P<ip>[0-9a-fA-F.:]+|-) (?P<date>\d{8,14}) (?P<type>.+?) (?P<length>\d+)"),
    2: re.compile(rb"(?P<url>\S.*?) (?P<ip>[0-9a-fA-F.:]+|-) (?P<date>\d{8,14}) (?P<type>.+?) (?P<code>\d{3}|-) (?P<sum>\S+) (?P<to>\S+) (?P<offset>\d+|-) (?P<file>\S+) (?P<length>\d+)"),
}
COLUMNS = "archive string, arc_offset long, record_id string, warc_type string, target_uri string, warc_date string, ip_address string, content_type string, block_digest string, payload_digest string, content_length long, truncated boolean, warc_base64 string"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
ARCHIVE_PAGES = 256


@dataclass
class ArcRecord:
    offset: int
    url: str
    ip: str
    date: str
    content_type: str
    content: bytes
    truncated: bool


def read_records(data: bytes) -> Iterator[ArcRecord]:
    """The records of an archive, plain or gzipped (one member or many).

    Without a version block version 1 is assumed. Blank lines between records
    are passed over, as are lines that are no header of the version; a record
    whose content ends before its declared length is marked truncated. What is
    before a damage of the compression is read; a last record, without a url,
    tells of it.
    """
    damage = ""
    if data[:2] == b"\x1f\x8b":
        data, damage = gunzipped(data)
    version, pos = 1, 0
    while pos < len(data):
        end = data.find(b"\n", pos)
        end = len(data) if end < 0 else end
        line, begin = data[pos:end].rstrip(b"\r"), pos
        # The version block's own header is of version 1's form in some archives of version 2.
        match = HEADER[version].fullmatch(line) or (HEADER[1].fullmatch(line) or HEADER[2].fullmatch(line) if line.startswith(b"filedesc:") else None)
        pos = end + 1
        if not match:
            continue
        length = int(match["length"])
        content = data[pos : pos + length]
        pos += length
        if line.startswith(b"filedesc:"):
            version = 2 if content[:1] == b"2" else 1
        text = {k: v.decode("utf-8", "replace") for k, v in match.groupdict().items()}
        yield ArcRecord(begin, text["url"], text["ip"], text["date"], text["type"], content, len(content) < length)
    if damage:
        yield ArcRecord(len(data), "", "-", "", "text/plain", damage.encode(), True)


def gunzipped(data: bytes) -> tuple[bytes, str]:
    """(what can be decompressed of one gzip member or many, what is wrong with the rest if anything is)."""
    out, total = [], len(data)
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        at = total - len(data)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            # Once more in small steps, for what is before the damage.
            member, begin = zlib.decompressobj(31), 0
            try:
                while begin < len(data):
                    out.append(member.decompress(data[begin : begin + 64]))
                    begin += 64
            except zlib.error:
                pass
            return b"".join(out), f"damaged gzip member at byte {at}"
        if not member.eof:
            return b"".join(out), f"gzip member at byte {at} ends too early"
        data = member.unused_data
    return b"".join(out), "" if not data.strip(b"\0") else f"no gzip member at byte {total - len(data)}"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def timestamp(date: str) -> str:
    """A date of 8 to 14 digits as a WARC date; what is missing counts as zero, what is no date as the epoch."""
    d = date.ljust(14, "0")
    try:
        return datetime.datetime.strptime(d, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def convert(record: ArcRecord, archive: str) -> tuple:
    """The row of COLUMNS for a record, but for its bytes; see to_warc() for these."""
    content, kind, payload, uri, media = record.content, "resource", None, record.url, record.content_type
    if record.url.startswith("filedesc:"):
        kind, uri, media = "warcinfo", None, "text/plain"
    elif not record.url:
        kind, uri, media = "metadata", None, "text/plain"
    elif content.startswith(b"HTTP/"):
        kind, media = "response", "application/http; msgtype=response"
        head = re.search(rb"\r?\n\r?\n", content)
        payload = digest(content[head.end() :] if head else b"")
    block, date = digest(content), timestamp(record.date)
    key = hashlib.md5(f"{archive}|{record.offset}|{record.url}|{date}|{block}".encode()).hexdigest()
    return archive, record.offset, f"<urn:uuid:{uuid.UUID(key)}>", kind, uri, date, None if record.ip in ("-", "0.0.0.0") else record.ip, media, block, payload, len(content), record.truncated


def to_warc(record: ArcRecord, archive: str) -> bytes:
    """A WARC/1.0 record."""
    return _bytes(convert(record, archive), record, archive)


def _bytes(values: tuple, record: ArcRecord, archive: str) -> bytes:
    row = dict(zip(NAMES, values, strict=False))
    head = [("WARC-Type", row["warc_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["warc_date"]), ("WARC-Target-URI", row["target_uri"]), ("WARC-IP-Address", row["ip_address"])]
    head += [("WARC-Filename", archive if row["warc_type"] == "warcinfo" else None), ("WARC-Block-Digest", row["block_digest"]), ("WARC-Payload-Digest", row["payload_digest"])]
    head += [("WARC-Truncated", "unspecified" if record.truncated else None), ("Content-Type", row["content_type"]), ("Content-Length", str(row["content_length"]))]
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head if v is not None) + b"\r\n" + record.content + b"\r\n\r\n"


def opening(archive: str, version: int) -> bytes:
    """The version block of an archive."""
    content = b"%d 0 quillspan\n%s\n" % (version, FIELDS[version])
    return f"filedesc://{archive} 0.0.0.0 20000101000000 text/plain ".encode() + (b"200 - - 0 %s " % archive.encode() if version == 2 else b"") + b"%d\n" % len(content) + content + b"\n"


def arc_record(url: str | None, ip: str, date: str, content: bytes, archive: str, version: int) -> bytes:
    name = (url or "-").replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D") or "-"
    more = f"200 - - 0 {archive} " if version == 2 else ""
    return f"{name} {ip} {date} text/html {more}{len(content)}\n".encode("utf-8", "replace") + content + b"\n"


def http(html: str | None) -> bytes:
    body = (html or "").encode("utf-8", "replace")
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body


def page_archives(pages: DataFrame, pages_each: int = ARCHIVE_PAGES) -> DataFrame:
    """Rows (archive, data): legacy archives of pages, ARCHIVE_PAGES successive ids each, of version 1 and 2 in turn.

    A page is fetched a minute after the one before it. Null ids share an
    archive of version 1 and the address 0.0.0.0, which reads as unknown; a null
    url reads '-', null html is an empty page; repeated rows are records each.
    """

    def build(rows: list[tuple]) -> tuple[str, bytes]:
        number = rows[0][0]
        archive, version = ("none.arc", 1) if number is None else (f"pages-{number}.arc", 1 + number % 2)
        out = [opening(archive, version)]
        for _, page, url, html in rows:
            ip = "0.0.0.0" if page is None else f"192.0.2.{page % 254 + 1}"
            second = np.datetime64("2000-01-01T00:00:00") + np.timedelta64(60 * (page or 0), "s")
            out.append(arc_record(url, ip, re.sub(r"\D", "", str(second)), http(html), archive, version))
        return archive, b"".join(out)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            archive, data = build(held)
            return pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([data], pa.binary())], ["archive", "data"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()

    page = F.col("page_id").cast("long")
    rows = pages.select(F.floor(page / pages_each).cast("long").alias("number"), page.alias("page"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.repartition("number").sortWithinPartitions("number", "page", "url", "html").mapInArrow(apply, "archive string, data binary")


def convert_archives(archives: DataFrame) -> DataFrame:
    """Rows of COLUMNS, one for each record of archives (archive, data), the WARC record itself among them.

    A null archive reads 'none'; null and empty data gives no rows. Damaged and
    cut ones give what is before, and a metadata record that tells where. Equal
    records of an archive differ by their offset, those of archives that repeat
    a name don't. Contents of any length are converted whole; other columns are
    not read.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for r in read_records(data.as_py() or b""):
                    row = convert(r, name or "none")
                    rows.append((*row, base64.b64encode(_bytes(row, r, name or "none")).decode()))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r, strict=True)) for r in rows], SCHEMA)

    return archives.select("archive", "data").mapInArrow(apply, COLUMNS)


SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]]) for n, c in zip(NAMES, COLUMNS.split(", "), strict=True)])


def write_warc(records: DataFrame, path: str) -> DataFrame:
    """Write records (see convert_archives) as WARC files, one member of gzip each, under path; rows (file, records) of what was written.

    A file is written by one task, under a name of its own until it is whole, and replaces one that an earlier try of the task has left. Repeated rows are written each.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(path)
        system.create_dir(base, recursive=True)
        context = TaskContext.get()
        name, count = f"part-{context.partitionId():05d}.warc.gz", 0
        draft = f"{base}/.{name}.{context.taskAttemptId()}"
        with system.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for x in batch.column(0).to_pylist():
                    if x is not None:
                        out.write(gzip.compress(base64.b64decode(x), mtime=0))
                        count += 1
        system.move(draft, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], ["file", "records"])

    rows = records.select("warc_base64").mapInArrow(apply, "file string, records long").collect()
    return records.sparkSession.createDataFrame(rows, "file string, records long")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, warc_type, record_id, target_uri, warc_date, content_length, content) of the .warc.gz files under path."""
    kind = "file string, warc_type string, record_id string, target_uri string, warc_date string, content_length long, content binary"
    names = [x.split()[0] for x in kind.split(", ")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, pos, rows = gunzipped(data)[0], 0, []
                while (end := data.find(b"\r\n\r\n", pos)) >= 0:
                    head = dict(x.split(": ", 1) for x in data[pos:end].decode("utf-8", "replace").split("\r\n")[1:])
                    size = int(head["Content-Length"])
                    rows.append((name, head.get("WARC-Type"), head.get("WARC-Record-ID"), head.get("WARC-Target-URI"), head.get("WARC-Date"), size, data[end + 4 : end + 4 + size]))
                    pos = end + 8 + size
                for a in range(0, len(rows), 500):
                    types = [pa.string()] * 5 + [pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 500], strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1), "content").mapInArrow(apply, kind)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows (archive, data) of the .arc and .arc.gz files under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.arc*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), F.col("content").alias("data"))


def _sql() -> str:
    """The rows that page archives convert to, from the pages themselves."""
    five = "[" + ", ".join(f"'{i:05b}'" for i in range(32)) + "]"
    four = "[" + ", ".join(f"'{i:04b}'" for i in range(16)) + "]"
    b32 = lambda x: f"'sha1:' || array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_position({five}, substr({x}, 5 * i + 1, 5))::BIGINT, 1)), '')"
    bits = lambda x: f"array_to_string(list_transform(string_split(sha1({x}), ''), lambda c: {four}[strpos('0123456789abcdef', c)]), '')"
    line = lambda x: f"chr(13) || chr(10) || {x}"
    uid = "'<urn:uuid:' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21) || '>'"
    return f"""
WITH pages_of AS (
  SELECT *, 'pages-' || (page_id // {ARCHIVE_PAGES}) || '.arc' AS archive, 1 + (page_id // {ARCHIVE_PAGES}) % 2 AS version, strlen(html) AS body,
    strftime(TIMESTAMP '2000-01-01' + INTERVAL (60 * page_id) SECOND, '%Y-%m-%dT%H:%M:%SZ') AS warc_date,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html AS block
  FROM pages
), opened AS (
  SELECT DISTINCT archive, version, version || ' 0 quillspan' || chr(10) || CASE version WHEN 1 THEN '{FIELDS[1].decode()}' ELSE '{FIELDS[2].decode()}' END || chr(10) AS block FROM pages_of
), heads AS (
  SELECT archive, page_id, url, html, block, 'response' AS warc_type, url AS target_uri, warc_date, '192.0.2.' || (page_id % 254 + 1) AS ip_address, 'application/http; msgtype=response' AS content_type,
    strlen(url || ' ' || '192.0.2.' || (page_id % 254 + 1) || ' 20000101000000 text/html ' || CASE version WHEN 2 THEN '200 - - 0 ' || archive || ' ' ELSE '' END || strlen(block)) + 1 AS head, true AS has_payload
  FROM pages_of
  UNION ALL
  SELECT archive, NULL, 'filedesc://' || archive, NULL, block, 'warcinfo', NULL, '2000-01-01T00:00:00Z', NULL, 'text/plain',
    strlen('filedesc://' || archive || ' 0.0.0.0 20000101000000 text/plain ' || CASE version WHEN 2 THEN '200 - - 0 ' || archive || ' ' ELSE '' END || strlen(block)) + 1, false
  FROM opened
), placed AS (
  SELECT *, coalesce(sum(head + strlen(block) + 1) OVER (PARTITION BY archive ORDER BY page_id NULLS FIRST, url, html ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS arc_offset,
    {bits("block")} AS b, {bits("html")} AS p FROM heads
), digested AS (SELECT *, {b32("b")} AS block_digest, CASE WHEN has_payload THEN {b32("p")} END AS payload_digest FROM placed),
named AS (SELECT *, md5(archive || '|' || arc_offset || '|' || url || '|' || warc_date || '|' || block_digest) AS m FROM digested),
records AS (SELECT *, {uid} AS record_id FROM named)
SELECT archive, arc_offset::BIGINT AS arc_offset, record_id, warc_type, target_uri, warc_date, ip_address, content_type, block_digest, payload_digest, strlen(block)::BIGINT AS content_length, false AS truncated,
  to_base64(encode('WARC/1.0' || {line("'WARC-Type: ' || warc_type")} || {line("'WARC-Record-ID: ' || record_id")} || {line("'WARC-Date: ' || warc_date")} || coalesce({line("'WARC-Target-URI: ' || target_uri")}, '')
    || coalesce({line("'WARC-IP-Address: ' || ip_address")}, '') || CASE warc_type WHEN 'warcinfo' THEN {line("'WARC-Filename: ' || archive")} ELSE '' END || {line("'WARC-Block-Digest: ' || block_digest")}
    || coalesce({line("'WARC-Payload-Digest: ' || payload_digest")}, '') || {line("'Content-Type: ' || content_type")} || {line("'Content-Length: ' || strlen(block)")} || {line("''")} || {line("''")} || block || {line("''")} || {line("''")})) AS warc_base64
FROM records
"""


SQL = _sql()
