"""Legacy ARC archives, their conversion to WARC, and WARC archives, as rows of bytes.

Archives are files that Spark writes and reads, so they can lie in any store
that it reaches.  A file is written by the text writer from one row that
holds the archive's bytes less the last line feed, which the writer puts
after each row; it is read back as one binary row.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import crowds, left_join, materialize, shared_dir

#: Bytes of records after which an archive ends.
ARCHIVE_BYTES = 8 << 20

# Fixed values of the ARC file format: the field lines of its two versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}

RECORD_SCHEMA = "url string, ip string, date string, mime string, block binary"


@dataclass(frozen=True)
class ArcRecord:
    """A record; ``place`` (archive and offset) tells equal records apart."""

    url: str
    ip: str
    date: str
    mime: str
    block: bytes
    place: str = ""


@dataclass(frozen=True)
class Damaged:
    """What stands at an offset (of the unpacked archive) instead of a record."""

    offset: int
    reason: str


class Stream:
    """Lines and blocks of an archive, plain or of gzip members one after the other, unpacked as it is read."""

    def __init__(self, data: bytes):
        self.parts = self._members(data) if data[:2] == b"\x1f\x8b" else iter([data])
        self.held = b""
        self.at = 0
        self.offset = 0
        self.broken = ""

    def _members(self, data: bytes) -> Iterator[bytes]:
        view, at = memoryview(data), 0
        while at < len(data):
            member = zlib.decompressobj(31)
            while not member.eof and at < len(data):
                part = view[at : at + (1 << 16)]
                try:
                    yield member.decompress(part)
                except zlib.error as e:
                    self.broken = f"gzip: {e}"
                    return
                at += len(part) - len(member.unused_data)
            if not member.eof:
                self.broken = "gzip: the last member has no end"

    def _more(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        self.held, self.at = self.held[self.at :] + part, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its end, or None at the end."""
        seen = 0
        while (end := self.held.find(b"\n", self.at + seen)) < 0:
            seen = len(self.held) - self.at
            if not self._more():
                if not seen:
                    return None
                end = len(self.held)
                break
        out = self.held[self.at : end]
        self.offset += min(end + 1, len(self.held)) - self.at
        self.at = min(end + 1, len(self.held))
        return out[:-1] if out.endswith(b"\r") else out

    def read(self, size: int) -> bytes | None:
        """The next ``size`` bytes, or None if there are fewer, which are gone then."""
        parts, left = [], size
        while True:
            part = self.held[self.at : self.at + left]
            parts.append(part)
            left -= len(part)
            self.at += len(part)
            self.offset += len(part)
            if not left:
                return b"".join(parts)
            if not self._more():
                return None


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _word(value: str | None, otherwise: str) -> str:
    """A header field: what would end it is percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "") or otherwise


def arc_archive(records: list[ArcRecord], name: str, version: int = 1) -> bytes:
    """An ARC file: its version block, then each record's header line, declared length and block.

    The version block declares the version and its fields.  Offsets (version
    2) are of each record in the file.
    """
    head = f"{version} 0 corpus\n{ARC_FIELDS[version]}\n".encode()
    out = [f"filedesc://{name} 0.0.0.0 19960101000000 text/plain{' 200 - - 0 ' + name if version == 2 else ''} {len(head)}\n".encode() + head + b"\n"]
    at = len(out[0])
    for r in records:
        extra = f" 200 {hashlib.md5(r.block).hexdigest()} - {at} {name}" if version == 2 else ""
        line = f"{_word(r.url, 'about:blank')} {_word(r.ip, '0.0.0.0')} {r.date} {_word(r.mime, 'no-type')}{extra} {len(r.block)}\n".encode()
        out.append(line + r.block + b"\n")
        at += len(out[-1])
    return b"".join(out)


def parse_arc(data: bytes, name: str = "") -> Iterator[ArcRecord | Damaged]:
    """The records of an ARC file of either version, by declared lengths; the version block is not one.

    The field line in the version block says which of a header line's fields
    is which; spaces beyond them belong to the URL.  An empty file has no
    records.  What is no header line, or declares more bytes than there are,
    is damaged; records go on at the next line that looks like a header.
    """
    stream, names, lost = Stream(data), ARC_FIELDS[1].lower().split(" "), False
    while (line := stream.line()) is not None:
        if not line:
            continue
        at = stream.offset
        if line.startswith(b"filedesc://"):  # archives may be joined, so it may come again
            size = line.rpartition(b" ")[2]
            block = stream.read(int(size)) if re.fullmatch(rb"[0-9]{1,9}", size) else None
            fields = (block or b"").decode("utf-8", "replace").split("\n")[1:2]
            own = fields[0].strip().lower().split(" ") if fields else []
            if "url" in own and own[-1] == "archive-length":
                names, lost = own, False
            else:
                yield Damaged(at, f"a version block with the fields {own}")
                lost = True
            continue
        header = _header(line, names, strict=lost)
        if header is None:
            if not lost:
                yield Damaged(at, f"no header of {len(names)} fields: {line[:100]!r}")
            lost = True
            continue
        lost = False
        block = stream.read(int(header["archive-length"]))
        if block is None:
            yield Damaged(at, f"a record of {header['archive-length']} bytes, which end beyond the archive")
            break
        yield ArcRecord(header["url"], header.get("ip-address", "0.0.0.0"), header.get("archive-date", ""), header.get("content-type", "no-type"), block, f"{name}#{at}")
    if stream.broken:
        yield Damaged(stream.offset, stream.broken)


def _header(line: bytes, names: list[str], strict: bool) -> dict[str, str] | None:
    """The named fields of a header line; if ``strict``, only of one that can hardly be content."""
    parts = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
    if len(parts) != len(names) or not re.fullmatch(r"[0-9]{1,15}", parts[-1]):
        return None
    own = dict(zip(names, parts))
    if strict and not (re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", own["url"]) and re.fullmatch(r"[0-9]{12}([0-9]{2})?", own.get("archive-date", ""))):
        return None
    return own


def http_payload(block: bytes) -> tuple[bytes, bytes]:
    """(head, payload) of an HTTP response; a block that is none is all payload."""
    if not block.startswith(b"HTTP/") or (end := block.find(b"\r\n\r\n")) < 0:
        return b"", block
    return block[: end + 4], block[end + 4 :]


def http_headers(head: bytes) -> dict[str, str]:
    """The headers of an HTTP head, with lower-case names."""
    lines = head[:-4].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def warc_id(record: ArcRecord, head: bytes, payload_digest: str) -> str:
    """A stable identifier for a converted record: the same record of the same place gets the same one."""
    seed = "\n".join([record.url, record.date, hashlib.sha1(head).hexdigest(), payload_digest, record.place])
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, seed)}>"


def warc_date(date: str) -> str:
    """An ARC date (12 or 14 digits) as a WARC date; other dates become the epoch."""
    if not re.fullmatch(r"[0-9]{12}([0-9]{2})?", date):
        return "1970-01-01T00:00:00Z"
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def to_warc(record: ArcRecord, *, refers_to: str | None = None) -> bytes:
    """The WARC record equivalent to an ARC record, without its last line feed.

    HTTP responses become ``response`` records, dns: URLs and others
    ``resource`` records.  With ``refers_to`` (the other record's identifier)
    it is a ``revisit``: the HTTP head stays, the payload goes, and the
    digest is of the full payload.
    """
    head, payload = http_payload(record.block)
    digest = sha1_base32(payload)
    kind = "revisit" if refers_to else "response" if head else "resource"
    body = head if refers_to else record.block
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {warc_id(record, head, digest)}",
        f"WARC-Date: {warc_date(record.date)}",
        f"WARC-Target-URI: {record.url}",
        f"WARC-IP-Address: {record.ip}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(body)}",
        f"Content-Type: {'application/http; msgtype=response' if head else record.mime}",
        f"Content-Length: {len(body)}",
    ]
    if refers_to:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes] | Damaged]:
    """(headers with lower-case names, block) of each record, by declared lengths; damage as in :func:`parse_arc`."""
    stream, lost = Stream(data), False
    while (line := stream.line()) is not None:
        if not line:
            continue
        at = stream.offset
        headers: dict[str, str] = {}
        if line.startswith(b"WARC/"):
            while part := stream.line():
                k, _, v = part.decode("utf-8", "replace").partition(":")
                headers[k.strip().lower()] = v.strip()
        if not re.fullmatch(r"[0-9]{1,15}", headers.get("content-length", "")):
            if not lost:
                yield Damaged(at, f"no WARC header: {line[:100]!r}")
            lost = True
            continue
        lost = False
        block = stream.read(int(headers["content-length"]))
        if block is None:
            yield Damaged(at, f"a record of {headers['content-length']} bytes, which end beyond the archive")
            break
        yield headers, block
    if stream.broken:
        yield Damaged(stream.offset, stream.broken)


def bundles(items: Iterator, join: Callable[[list], bytes], size: Callable[[object], int], most: int = ARCHIVE_BYTES) -> Iterator[bytes]:
    """Archives made by ``join`` of about ``most`` bytes of items (or one larger one); no more than one is held."""
    held, own = 0, []
    for item in items:
        own.append(item)
        held += size(item)
        if held >= most:
            yield join(own)
            held, own = 0, []
    if own:
        yield join(own)


def write_archives(rows: DataFrame, path: str, make: Callable[[Iterator[tuple]], Iterator[bytes]]) -> None:
    """Write the archives that ``make`` makes of a task's rows, which are given as tuples.

    An archive is a file of its own; gzip makes it smaller.  At the default
    level that would take most of the work's time, for a tenth less of bytes.
    """

    def tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            columns = batch.columns
            for k in range(batch.num_rows):
                yield tuple(c[k].as_py() for c in columns)

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for archive in make(tuples(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], names=["archive"])

    made = rows.mapInArrow(archives, "archive binary").select(F.col("archive").cast("string").alias("value"))
    made.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str, parse: Callable[[bytes, str], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that ``parse`` makes of each archive file's bytes and path under ``path``, packed or not.

    A file is one row, so it has to be smaller than 2 GB; what it holds is
    unpacked as it is read.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                out: list[tuple] = []
                held = 0
                for row in parse(content.as_py(), file):
                    out.append(row)
                    held += sum(len(x) for x in row if isinstance(x, (bytes, str)))
                    if held > 2 << 20:
                        yield _batch(out, names, schema)
                        out, held = [], 0
                if out:
                    yield _batch(out, names, schema)

    return archive_files(spark, path).mapInArrow(records, schema)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files under ``path``; names that Spark gives to no data (_SUCCESS, checksums) are not archives."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "[!._]*").option("recursiveFileLookup", True).load(path).select("path", "content")


def _name(file: str) -> str:
    return file.rpartition("/")[2]


def damaged(spark: SparkSession, path: str, *, warc: bool = False) -> DataFrame:
    """(archive, position, reason) of what stands in ARC (or WARC) archives instead of records; conversion passes over it."""
    read = parse_warc if warc else parse_arc
    return read_archives(
        spark, path, lambda data, file: ((_name(file), x.offset, x.reason) for x in read(data) if isinstance(x, Damaged)),
        "archive string, position bigint, reason string"
    )


_TYPES = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64()}


def _batch(rows: list[tuple], names: list[str], schema: str) -> pa.RecordBatch:
    types = [_TYPES[x.split()[1]] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def page_record(page_id: int | None, url: str | None, payload: bytes) -> ArcRecord:
    """A page as an archived HTTP response; the page's id and length are in its HTTP head."""
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode()
    return ArcRecord(_word(url, "about:blank"), "0.0.0.0", "20240101000000", "text/html", head + payload)


def pages_to_arc(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", version: int = 1) -> None:
    """Write pages as ARC archives; null html is an empty payload."""

    def make(rows: Iterator[tuple]) -> Iterator[bytes]:
        # the text writer adds the last line feed
        records = (page_record(i, u, h or b"") for i, u, h in rows)
        return bundles(records, lambda own: arc_archive(own, "pages.arc", version)[:-1], lambda r: len(r.block) + 200)

    rows = pages.select(F.col(page_id).cast("bigint"), F.col(url).cast("string"), F.encode(F.col(html), "UTF-8"))
    write_archives(rows, path, make)


def _arc_rows(data: bytes, file: str) -> Iterator[tuple]:
    for r in parse_arc(data, _name(file)):
        if isinstance(r, ArcRecord):
            head, payload = http_payload(r.block)
            digest = sha1_base32(payload)
            yield _number(http_headers(head).get("x-page-id")), len(payload), digest, warc_id(r, head, digest), r.place, file


def _number(text: str | None) -> int | None:
    """The number of a header, if it is one of 64 bits."""
    digits = re.fullmatch(r"(-?)0*([0-9]{1,19})", text or "", re.ASCII)
    number = int(digits[1] + digits[2]) if digits else None
    return number if number is not None and -(1 << 63) <= number < 1 << 63 else None


_ARC_ROWS = "page_id bigint, payload_bytes bigint, digest string, record_id string, place string, archive string"


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, *, least_payload: int = 0) -> None:
    """Convert all ARC archives under a path to WARC archives.

    Of records with equal payloads (of at least ``least_payload`` bytes) that
    with the largest page id becomes a response, and the others revisits that
    refer to it; ties have the larger record identifier, which is of the
    record's place, so that of equal records one is the response.  Records
    without a page id come last.  Damaged ones (see :func:`damaged`) are
    passed over.  The archives are read twice: first for an index, from which
    each archive gets the list of its revisits, then to be converted one by
    one.  Payloads are never shuffled by themselves; packed archives are, if
    the lists are too many to be broadcast.
    """
    ids = materialize(read_archives(spark, arc_path, _arc_rows, _ARC_ROWS), "arc-index")
    fit = ids.where(F.col("payload_bytes") >= least_payload)
    best = fit.groupBy("digest").agg(
        F.max(F.struct("page_id", "record_id", "archive")).alias("best"), F.count(F.lit(1)).alias("copies")
    ).where("copies > 1").select("digest", F.col("best.record_id").alias("_first"), F.col("best.archive").alias("_of"), "copies")
    crowd = crowds(best, "digest", "copies", ids.count())
    paired = left_join(fit, best.drop("copies"), "digest", crowd, F.concat(F.lit("#"), F.col("record_id")))
    again = paired.where("_first is not null and (_first <> record_id or _of <> archive)")
    lists = again.groupBy(F.col("archive").alias("path")).agg(F.map_from_entries(F.collect_list(F.struct("place", "_first"))).alias("revisits"))

    def make(rows: Iterator[tuple]) -> Iterator[bytes]:
        return bundles(_converted(rows), b"\n".join, len)

    files = archive_files(spark, arc_path).join(materialize(lists, "revisits"), "path", "left")
    write_archives(files.select("path", "content", "revisits"), warc_path, make)


def _converted(archives: Iterator[tuple]) -> Iterator[bytes]:
    """The WARC records of ARC archives: (file, bytes, (place, what it refers to) of the revisits)."""
    for file, content, revisits in archives:
        refers = dict(revisits or ())
        for r in parse_arc(content, _name(file)):
            if isinstance(r, ArcRecord):
                yield to_warc(r, refers_to=refers.get(r.place))


def _warc_rows(data: bytes, file: str) -> Iterator[tuple]:
    for record in parse_warc(data):
        if isinstance(record, Damaged):
            continue
        headers, block = record
        head, payload = http_payload(block)
        http = http_headers(head)
        size = len(payload) if headers.get("warc-type") != "revisit" else _number(http.get("content-length")) or 0
        digest = headers.get("warc-payload-digest")
        yield _number(http.get("x-page-id")), headers.get("warc-record-id"), headers.get("warc-type"), size, digest.rpartition(":")[2] if digest else None, headers.get("warc-refers-to")


def read_warc_pages(spark: SparkSession, warc_path: str) -> DataFrame:
    """A row a record: page_id, payload_bytes, payload_digest, record_type, refers_to (the response's page_id)."""
    index = materialize(
        read_archives(spark, warc_path, _warc_rows, "page_id bigint, record_id string, record_type string, payload_bytes bigint, payload_digest string, refers_id string"),
        "warc-index"
    )
    named = index.where(F.col("refers_id").isNotNull()).groupBy(F.col("refers_id").alias("record_id")).agg(F.count(F.lit(1)).alias("n"))
    first = index.where("record_type <> 'revisit'").select("record_id", "page_id").join(named, "record_id").groupBy(F.col("record_id").alias("refers_id")).agg(F.max("page_id").alias("refers_to"))
    named = named.withColumnRenamed("record_id", "refers_id")
    crowd = crowds(named, "refers_id", "n", index.count())
    out = left_join(index, first, "refers_id", crowd, F.concat(F.lit("#"), F.monotonically_increasing_id()))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
