"""WARC archives as a Spark data source, written in Python: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans one partition per archive file. Record types and header values that a query asks for (options, or filters
where ``spark.sql.python.filterPushdown.enabled`` is set) are tested on the parsed headers; the block of a record that fails them, or
whose payload the schema leaves out, is skipped without being read or inflated. Writing packs every record on its own and rolls to a new file when one is full;
files carry a task's own name until the driver commits them, so a lost executor leaves nothing that readers see.
"""

from __future__ import annotations

import gzip
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from tideframe.session import fresh_path

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary"
#: Column of the schema and the header it comes from; these can be pushed down.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
FILE_BYTES = 128 << 20
MIN_REVISIT_BYTES = 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    files: list


class WarcSource(DataSource):
    """Options: ``path``; ``recordTypes`` and ``headers`` (``name=value``), separated by commas and newlines."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (PushingWarcReader if self.options.get("pushFilters") == "true" else WarcReader)(schema, self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("archives are appended to; write to a new folder instead")
        return WarcWriter(schema, self.options)


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns = schema.fieldNames()
        self.path = options["path"]
        self.wanted: dict[str, set[str]] = {}
        if types := options.get("recordTypes"):
            self.wanted["warc-type"] = set(types.split(","))
        for line in filter(None, options.get("headers", "").split("\n")):
            name, _, value = line.partition("=")
            self.wanted[name.strip().lower()] = {value.strip()}

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        names = sorted(x.path for x in found if x.is_file and x.base_name.endswith((".warc", ".warc.gz")) and not x.base_name.startswith(("_", ".")))
        return [_File(n) for n in names]

    def read(self, partition: _File | None) -> Iterator[tuple]:
        if partition is None:
            return
        system, _ = _filesystem(self.path)
        with system.open_input_file(partition.path) as raw:
            if partition.path.endswith(".gz") and Member(raw).size:
                yield from self._members(raw)
                return
            raw.seek(0)
            stream = gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else raw
            while headers := read_headers(stream):
                length = int(headers.get("content-length", 0))
                if any(headers.get(k) not in v for k, v in self.wanted.items()):
                    stream.seek(length + 4, 1)
                    continue
                yield self._row(stream, headers, length)
                stream.seek(4, 1)

    def _members(self, raw) -> Iterator[tuple]:
        """Records that are gzip members of known size: of an unwanted one only the first bytes are inflated."""
        at = 0
        raw.seek(0)
        while (member := Member(raw, at)).size:
            headers = read_headers(member)
            if all(headers.get(k) in v for k, v in self.wanted.items()):
                yield self._row(member, headers, int(headers.get("content-length", 0)))
            at += member.size
            raw.seek(at)

    def _row(self, stream, headers: dict[str, str], length: int) -> tuple:
        end = stream.tell() + length
        size = payload = None
        if "application/http" in headers.get("content-type", "") and {"payload", "payload_bytes"} & set(self.columns):
            http = read_headers(stream, end)
            size = int(http.get("content-length", end - stream.tell()))
        elif "payload_bytes" in self.columns:
            size = length
        if "payload" in self.columns and headers.get("warc-type") != "revisit":
            payload = stream.read(end - stream.tell())
        stream.seek(end - stream.tell(), 1)
        plain = {c: headers.get(h) for c, h in HEADERS.items()}
        plain |= {c: plain[c] and plain[c].strip("<>") for c in ("record_id", "refers_to")}
        digest = plain["payload_digest"]
        plain |= {"payload_digest": digest and digest.rpartition(":")[2], "payload_bytes": size, "payload": payload}
        return tuple(plain.get(c) for c in self.columns)


class Member:
    """One gzip member, inflated as far as it is read. Its size stands in the ``sl`` extra field, as in web archives of old.

    ``size`` is 0 at the end of the file, and for members of other writers, which do not tell their size.
    """

    def __init__(self, raw, start: int = 0):
        self.raw, self.start, self.size = raw, start, 0
        head = raw.read(24)
        if len(head) == 24 and head[:4] == b"\x1f\x8b\x08\x04" and head[12:14] == b"sl":
            self.size = struct.unpack("<I", head[16:20])[0]
        self.inflate, self.held, self.at = zlib.decompressobj(-zlib.MAX_WBITS), bytearray(), 0

    def read(self, n: int) -> bytes:
        while len(self.held) < self.at + n and not self.inflate.eof:
            more = self.raw.read(min(1 << 16, max(1024, n)))
            if not more:
                break
            self.held += self.inflate.decompress(more)
        out = bytes(self.held[self.at : self.at + n])
        self.at += len(out)
        return out

    def tell(self) -> int:
        return self.at

    def seek(self, n: int, whence: int = 0) -> None:
        self.at = n + whence * self.at


def member(data: bytes) -> bytes:
    """``data`` as a gzip member with its packed and plain sizes in the extra field."""
    deflate = zlib.compressobj(4, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = deflate.compress(data) + deflate.flush()
    size = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(data) % 2**32)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) % 2**32)


class PushingWarcReader(WarcReader):
    """Also takes filters from the optimiser; Spark refuses such a reader where pushdown to Python sources is off."""

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) else None
            if column not in HEADERS or column == "payload_digest":
                yield f
                continue
            values = {str(f.value)} if isinstance(f, EqualTo) else {str(v) for v in f.value}
            values = {f"<{v}>" if column in ("record_id", "refers_to") else v for v in values}
            name = HEADERS[column]
            self.wanted[name] = self.wanted[name] & values if name in self.wanted else values


def read_headers(stream, end: int | None = None) -> dict[str, str]:
    """Header lines up to an empty one, names in lower case; empty at the end of the stream. Folded lines are joined."""
    headers: dict[str, str] = {}
    name = None
    block = b""
    start = stream.tell()
    while b"\r\n\r\n" not in block:
        more = stream.read(1024 if end is None else max(0, min(1024, end - stream.tell())))
        if not more:
            break
        block += more
    head, mark, _ = block.partition(b"\r\n\r\n")
    if not block.strip():
        return headers
    stream.seek(start + len(head) + len(mark))
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    headers["first-line"] = first
    for line in lines:
        if line[:1] in " \t" and name:
            headers[name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        headers[name] = value.strip()
    return headers


class WarcWriter(DataSourceWriter):
    def __init__(self, schema, options):
        self.path = options["path"]
        self.limit = int(options.get("fileBytes", FILE_BYTES))
        self.packed = options.get("compression", "gzip") == "gzip"

    def write(self, rows: Iterator) -> _Written:
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        files: list[tuple[str, str]] = []
        out, size = None, 0
        pack = member if self.packed else bytes
        try:
            for row in rows:
                if out is None or size >= self.limit:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc{'.gz' * self.packed}"
                    files.append((f"{root}/_{name}", f"{root}/{name}"))
                    out = system.open_output_stream(files[-1][0], compression=None)  # records are packed one by one
                    size = out.write(pack(warcinfo(name)))
                size += out.write(pack(record(row.asDict())))
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages: list) -> None:
        system, _ = _filesystem(self.path)
        for message in filter(None, messages):
            for temporary, final in message.files:
                system.move(temporary, final)

    def abort(self, messages: list) -> None:
        system, _ = _filesystem(self.path)
        for message in filter(None, messages):
            for temporary, _final in message.files:
                system.delete_file(temporary)


def _header_value(value) -> str:
    """Blanks and control characters would end a header early; they are written as percent codes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", str(value))


def warcinfo(name: str) -> bytes:
    body = b"software: tideframe\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:archive:{name}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def record(row: dict) -> bytes:
    """One record; a revisit keeps the HTTP headers, with the length of the full payload, and no payload."""
    payload = row.get("payload") or b""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if row.get('payload_bytes') is None else row['payload_bytes']}\r\n\r\n".encode()
    block = http if revisit else http + bytes(payload)
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{_header_value(row['record_id'])}>", f"WARC-Date: {_header_value(row.get('date') or '1970-01-01T00:00:00Z')}"]
    if row.get("target_uri") is not None:
        lines.append(f"WARC-Target-URI: {_header_value(row['target_uri'])}")
    if row.get("payload_digest") is not None:
        lines.append(f"WARC-Payload-Digest: sha256:{_header_value(row['payload_digest'])}")
    if revisit:
        lines += [f"WARC-Refers-To: <{_header_value(row['refers_to'])}>", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def page_records(pages: DataFrame) -> DataFrame:
    """Rows of ``SCHEMA`` for pages: of equal payloads of at least 100 bytes the smallest id holds the payload.

    Ids are ``urn:page:<page_id>``, of a null id ``urn:page:``. A null html is an empty payload. Rows that repeat an id and a
    payload are equal records; those of the smallest id are all responses. Other columns are not read.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"),
        F.encode(html, "UTF-8").alias("payload"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(F.encode(html, "UTF-8"), 256).alias("payload_digest"))
    # One row per repeated payload; pages meet it in a join, so a payload of a third of all pages is no single group.
    first = own.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return own.join(first.drop("n"), "payload_digest", "left").select(
        urn("page_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(None).cast("string").alias("date"),
        "payload_digest", F.when(again, urn("first")).alias("refers_to"), "payload_bytes", F.when(~again, F.col("payload")).alias("payload"))


def write_archives(records: DataFrame, path: str, compression: str = "gzip") -> None:
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").option("compression", compression).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, columns: list[str] | None = None, record_types: tuple[str, ...] = (), headers: dict[str, str] | None = None) -> DataFrame:
    """Records of the archives below ``path``; only ``columns`` are decoded, other types and headers are skipped."""
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc").option("pushFilters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if columns:
        fields = dict(f.strip().split(" ", 1) for f in SCHEMA.split(","))
        reader = reader.schema(", ".join(f"{c} {fields[c]}" for c in columns))
    if record_types:
        reader = reader.option("recordTypes", ",".join(record_types))
    if headers:
        reader = reader.option("headers", "\n".join(f"{k}={v}" for k, v in headers.items()))
    return reader.load(path)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Archive pages, read the archives back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Lengths and digests of responses are taken from the payload read back, those of revisits from their headers.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(page_records(pages), path)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    full = read_archives(spark, path, ["record_id", "record_type", "payload"], ("response",))
    full = full.select(number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    short = read_archives(spark, path, ["record_id", "record_type", "payload_digest", "refers_to", "payload_bytes"], ("revisit",))
    return full.union(short.select(number("record_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to")))
