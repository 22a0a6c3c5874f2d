"""Legacy archive converter: ARC version 1 and 2 to WARC 1.0.

An ARC file starts with a version block (``filedesc://``) that names the fields of
its header lines; every record is one such line, then as many bytes as the line
declares.  The converter reads those, and writes WARC records with equivalent
identifiers, timestamps, types and digests; of records with equal payloads one is
a ``response`` and the others ``revisit`` it.

Archives are written by Spark's text writer (one record per row, the record's end
as line separator, gzip) and read by its ``binaryFile`` source, so they can live in
any store that Spark reaches.  Files hold at most ``RECORDS_PER_FILE`` records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewise.llm.common import new_path, put, release

RECORDS_PER_FILE = 1_000
#: Stand-ins for what a page table does not know of its capture.
ARC_DATE = "20240101000000"
ARC_IP = "0.0.0.0"
#: Payloads of at least so many bytes can be revisits.
MIN_REVISIT_BYTES = 0
# The field lists of the two ARC versions.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
              2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename "
                 "Archive-length"}
_WRITE = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def sha1_base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


# --- ARC ---------------------------------------------------------------------------------------

def arc_line(version: int, url: str, date: str, mime: str, length: int, checksum: str = "-", status: str = "200",
             offset: int = 0, name: str = "-") -> bytes:
    """Header line of a record; blanks and controls in the URL are percent-encoded, as the line splits at blanks."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    if version == 1:
        return f"{url} {ARC_IP} {date} {mime} {length}\n".encode()
    return f"{url} {ARC_IP} {date} {mime} {status} {checksum} - {offset} {name} {length}\n".encode()


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 notewise\n{ARC_FIELDS[version]}\n".encode()
    return arc_line(version, f"filedesc://{name}", ARC_DATE, "text/plain", len(body), name=name) + body


def http_block(page_id, payload: bytes) -> bytes:
    """HTTP response with the payload; the page id travels in a header field of its own."""
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{own}"
            f"Content-Length: {len(payload)}\r\n\r\n").encode() + payload


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write ``pages`` as ARC files below ``path``: version 1 from even, version 2 from odd partitions.

    A null html is an empty payload, a null URL the id as a URN.
    """
    from pyspark import TaskContext

    def run(batches):
        part = TaskContext.get().partitionId()
        version, n, at = 1 + part % 2, 0, 0
        for batch in batches:
            out, size = [], 0
            for page_id, url, html in zip(*batch.columns, strict=True):
                page_id, url, html = page_id.as_py(), url.as_py(), html.as_py()
                if n % records_per_file == 0:
                    name = f"notewise-{part:06d}-{n // records_per_file:06d}.arc"
                    block = arc_version_block(version, name)
                    out.append(block)
                    at = len(block) + 1
                body = http_block(page_id, (html or "").encode())
                line = arc_line(version, url if url is not None else f"urn:page:{page_id}", ARC_DATE, "text/html",
                                len(body), hashlib.md5(body).hexdigest(), offset=at, name=name)
                out.append(line + body)
                at += len(line) + len(body) + 1
                size += len(body)
                n += 1
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")) \
        .mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")) \
        .write.options(lineSep="\n", maxRecordsPerFile=records_per_file + 1, **_WRITE).text(path)


class Stream:
    """Forward reader over the bytes of a file, inflating gzip members as it goes."""

    def __init__(self, raw: bytes, step: int = 1 << 20):
        self.raw, self.at, self.step, self.buffer, self.pos = raw, 0, step, bytearray(), 0
        self.gzip = raw[:2] == b"\x1f\x8b"
        self.inflater = zlib.decompressobj(31) if self.gzip else None

    def _more(self) -> bool:
        if self.pos > 1 << 20:
            del self.buffer[:self.pos]
            self.pos = 0
        if self.at >= len(self.raw):
            return False
        piece = self.raw[self.at:self.at + self.step]
        self.at += len(piece)
        if not self.gzip:
            self.buffer += piece
            return True
        while piece:
            self.buffer += self.inflater.decompress(piece)
            piece = self.inflater.unused_data if self.inflater.eof else b""
            if self.inflater.eof:
                self.inflater = zlib.decompressobj(31)
        return True

    def line(self) -> bytes | None:
        """Next line without its end; None at the end of the file."""
        look = self.pos
        while (end := self.buffer.find(b"\n", look)) < 0:
            tail = len(self.buffer) - self.pos
            if not self._more():
                if not tail:
                    return None
                end = len(self.buffer)
                break
            look = self.pos + tail
        out = bytes(self.buffer[self.pos:end])
        self.pos = min(end + 1, len(self.buffer))
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.pos < n and self._more():
            pass
        out = bytes(self.buffer[self.pos:self.pos + n])
        if len(out) < n:
            raise ValueError(f"a record declares {n} bytes, {len(out)} are left")
        self.pos += n
        return out


def parse_arc(raw: bytes):
    """Records of an ARC file: dicts of the named fields, ``version``, ``number`` and ``body``.

    The version block comes first (its URL begins with ``filedesc://``) and sets how
    many fields the following header lines have; later records may have such a URL too
    and are records like others.  URLs of old files may hold blanks, so fields are split
    from the right.
    """
    stream, version, number, first = Stream(raw), 1, 0, True
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        text = line.decode("utf-8", "replace")
        opening, first = first, False
        if opening and text.startswith("filedesc://"):
            parts = text.split(" ")
            body = stream.take(int(parts[-1]))
            version = int(body.split(b" ", 1)[0])
            fields = parts[:1] + parts[1:4] + parts[-1:]
            yield dict(zip(ARC_FIELDS[1].split(" "), fields, strict=True)) | {"version": version, "number": -1,
                                                                            "body": body}
            continue
        names = ARC_FIELDS[version].split(" ")
        fields = text.rsplit(" ", len(names) - 1)
        if len(fields) != len(names) or not fields[-1].strip().isdigit():
            raise ValueError(f"not an ARC version {version} header line: {text[:200]!r}")
        yield dict(zip(names, fields, strict=True)) | {"version": version, "number": number,
                                                       "body": stream.take(int(fields[-1]))}
        number += 1


def split_http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """(header bytes with their blank line, fields in lower case, payload) of an HTTP message."""
    if not block.startswith(b"HTTP/"):
        return b"", {}, block
    end = block.find(b"\r\n\r\n")
    head, payload = (block, b"") if end < 0 else (block[:end + 4], block[end + 4:])
    fields = {}
    for line in head.decode("latin-1").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return head, fields, payload


# --- WARC --------------------------------------------------------------------------------------

def warc_date(arc_date: str) -> str:
    """14 (or fewer) digits of an ARC date as a W3C timestamp."""
    d = (re.sub(r"\D", "", arc_date) + "00000101000000"[len(re.sub(r"\D", "", arc_date)):])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts) -> str:
    """The same capture always gets the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, parts)))}>"


def warc_record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its closing two line ends, which the writer adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def parse_warc(raw: bytes):
    """(fields in lower case, block) of every record, by the declared lengths."""
    stream = Stream(raw)
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:100]!r}")
        fields = {}
        while (line := stream.line()) is not None and line.strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.take(int(fields["content-length"]))


_SEEN = "path string, number int, page_id long, payload_bytes long, payload_digest string"


def _digests(batches):
    for batch in batches:
        for path, raw in zip(*batch.columns, strict=True):
            path, out = path.as_py(), []
            for r in parse_arc(raw.as_py()):
                if r["number"] >= 0:
                    _, fields, payload = split_http(r["body"])
                    own = fields.get("x-page-id")
                    out.append((path, r["number"], None if own is None else int(own), len(payload),
                                sha1_base32(payload)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             names=["path", "number", "page_id", "payload_bytes", "payload_digest"])


def _convert(batches):
    for batch in batches:
        for path, raw, first in zip(*batch.columns, strict=True):
            path, first = path.as_py(), first.as_py() or []
            revisits = {r["number"]: r for r in first}
            out, size = [], 0
            for r in parse_arc(raw.as_py()):
                date, uri = warc_date(r["Archive-date"]), r["URL"]
                if r["number"] < 0:
                    out.append(warc_record([
                        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("arc", uri)), ("WARC-Date", date),
                        ("WARC-Filename", uri.removeprefix("filedesc://")),
                        ("Content-Type", "application/warc-fields")],
                        f"software: notewise\r\nformat: WARC File Format 1.0\r\n"
                        f"description: converted from ARC version {r['version']}\r\n".encode()))
                    continue
                head, fields, payload = split_http(r["body"])
                digest = sha1_base32(payload)
                of = revisits.get(r["number"])
                kind = "response" if head else "resource"
                block, extra = r["body"], []
                if of is not None:
                    kind, block = "revisit", head
                    extra = [("WARC-Profile",
                              "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
                             ("WARC-Refers-To", record_id(of["to_path"], of["to_number"])),
                             ("X-Refers-To-Page-Id", of["to_page"])]
                out.append(warc_record([
                    ("WARC-Type", kind), ("WARC-Record-ID", record_id(path.rsplit("/", 1)[-1], r["number"])),
                    ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-IP-Address", r["IP-address"]), *extra,
                    ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
                    ("Content-Type", "application/http; msgtype=response" if head else r["Content-type"])], block))
                size += len(block)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path)


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str,
                min_revisit_bytes: int = MIN_REVISIT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Convert all ARC files below ``arc_path`` to WARC files below ``warc_path``.

    Of records with equal payloads (SHA-1 and length) of at least
    ``min_revisit_bytes`` bytes, the one with the largest page id (then file and
    place) is the response; the others become revisits of it.
    """
    arcs = _files(spark, arc_path)
    seen = put(arcs.select("path", "content").mapInArrow(_digests, _SEEN), "arcseen")
    first = seen.filter(F.col("payload_bytes") >= min_revisit_bytes).groupBy("payload_digest", "payload_bytes") \
        .agg(F.max(F.struct("page_id", "path", "number")).alias("to"), F.count("*").alias("n")).filter("n > 1")
    # a file's revisits: as many as it has records at most, and a file is converted by one task anyway
    revisits = seen.join(first, ["payload_digest", "payload_bytes"]) \
        .filter("NOT (path = to.path AND number = to.number)") \
        .groupBy(F.col("path").alias("in_")).agg(F.collect_list(F.struct(
            "number", F.col("to.page_id").alias("to_page"),
            F.element_at(F.split("to.path", "/"), -1).alias("to_path"),
            F.col("to.number").alias("to_number"))).alias("revisits"))
    revisits = put(revisits, "revisits")
    release(spark)
    arcs.select("path", "content").join(revisits, F.col("path") == F.col("in_"), "left") \
        .select("path", "content", "revisits").mapInArrow(_convert, "record binary") \
        .select(F.col("record").cast("string").alias("value")) \
        .write.options(lineSep="\r\n\r\n", maxRecordsPerFile=records_per_file + 1, **_WRITE).text(warc_path)


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, " \
        "warc_record_id string, warc_date string, url string"


def _read(batches):
    names = [c.split(" ")[0] for c in _READ.split(", ")]
    types = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(c.split(" ")[0], types[c.split(" ")[1]]) for c in _READ.split(", ")])
    for batch in batches:
        for raw in batch.column(0):
            out = []
            for fields, block in parse_warc(raw.as_py()):
                kind = fields["warc-type"]
                if kind == "warcinfo":
                    continue
                _, http, payload = split_http(block)
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                size = len(payload)
                if kind == "revisit":
                    size = int(http["content-length"])
                elif sha1_base32(payload) != digest:
                    raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                own, to = http.get("x-page-id"), fields.get("x-refers-to-page-id")
                out.append((None if own is None else int(own), size, digest, kind,
                            None if to is None or kind != "revisit" else int(to), fields["warc-record-id"],
                            fields["warc-date"], fields["warc-target-uri"]))
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)],
                                             schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record but warcinfo: page_id, payload_bytes, payload_digest, record_type, refers_to and more.

    Payload digests of responses are computed anew and must match the record's.
    """
    return _files(spark, path).select("content").mapInArrow(_read, _READ)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages to ARC files, those to WARC files, and the WARC files read back: one row per page."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc, id_col, url_col, html_col)
    convert_arc(spark, arc, warc, min_revisit_bytes)
    return read_warc(spark, warc)
