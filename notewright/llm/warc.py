"""WARC archives as a PySpark data source.

Reading plans partitions from the archives' sizes, takes conditions on record type and other headers, parses a
record's headers first, and leaves the payload of unwanted records undecoded: records are gzip members that carry
their own length, so what follows the headers is not even read. Archives of other writers work too; there the
unwanted payload is inflated, but never kept.

Writing makes one archive per task. What a task wrote counts only once the job's list of archives is written, so
repeated and lost tasks leave nothing behind that a reader sees.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass


import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, "
    "payload_bytes long, headers map<string,string>, payload binary"
)
# Header names of the format, by column.
HEADER_OF = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest",
}
PAYLOAD_BYTES = "X-Payload-Bytes"  # ours: length of the full payload, also where a revisit leaves it out
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EXTRA = b"WR"  # gzip extra field of our archives: the member's whole length
CHUNK = 1 << 16
MANIFEST = "archives.json"


def open_folder(path: str):
    """File system and path of a folder in a store that pyarrow knows."""
    if "://" not in path:
        path = path.removeprefix("file:") if path.startswith("file:/") else path
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def clean(value: str) -> str:
    """A header value on one line; what would end or break it is percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def digest_header(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def digest_hex(header: str | None) -> str | None:
    """Bare lower-case hex of a ``sha1:`` header in base 32 or hex; others as they are."""
    if header is None or not header.lower().startswith("sha1:"):
        return header
    value = header[5:]
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def record_bytes(row: dict) -> bytes:
    """One uncompressed record."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    )
    block = http if revisit else http + payload
    headers = {
        "WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": row["date"],
        "WARC-Target-URI": row["target_uri"], "WARC-Refers-To": row["refers_to"],
        "WARC-Payload-Digest": digest_header(row["payload_digest"]), PAYLOAD_BYTES: str(row["payload_bytes"]),
        "WARC-Profile": REVISIT_PROFILE if revisit else None,
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {clean(v)}\r\n" for k, v in headers.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that tells its own length."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    total = 10 + 2 + 8 + len(body) + 8
    if total > 0xFFFFFFFF:  # its length has no room in the field: a plain member, whose end a reader finds by inflating
        head = b"\x1f\x8b\x08\0\0\0\0\0\0\xff"
    else:
        extra = EXTRA + struct.pack("<HI", 4, total)
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Text:
    """The inflated (or plain) bytes of one member from its start, read as far as asked for."""

    def __init__(self, f, start: int):
        self.f, self.at, self.start = f, start, start
        f.seek(start)
        head = f.read(20)
        self.length = None
        self.plain = head[:2] != b"\x1f\x8b"
        if not self.plain and len(head) == 20 and head[3] & 4 and head[12:14] == EXTRA:
            self.length = struct.unpack("<I", head[16:20])[0]
        f.seek(start)
        self.z = None if self.plain else zlib.decompressobj(31)
        self.buffer, self.over = b"", False

    def more(self) -> bytes:
        """The next piece; empty at the member's end."""
        while not self.over:
            data = self.f.read(CHUNK)
            if not data:
                self.over = True
                return b""
            self.at += len(data)
            if self.plain:
                return data
            out = self.z.decompress(data)
            if self.z.eof:
                self.over = True
                self.at -= len(self.z.unused_data)
            if out:
                return out
        return b""

    def until(self, mark: bytes, most: int | None = None) -> bytes:
        """What comes up to the end of a mark; empty where ``most`` bytes hold none. An error where the text ends without it."""
        parts, kept = [], self.buffer
        size = len(kept)
        while (i := kept.find(mark)) < 0:
            if most is not None and size > most:
                self.buffer = b"".join([*parts, kept])
                return b""
            piece = self.more()
            if not piece:
                raise ValueError("a record ends within its headers")
            # the mark may lie across two pieces
            cut = max(0, len(kept) - len(mark) + 1)
            parts.append(kept[:cut])
            kept, size = kept[cut:] + piece, size + len(piece)
        self.buffer = kept[i + len(mark) :]
        return b"".join([*parts, kept[: i + len(mark)]])

    def take(self, n: int, keep: bool) -> bytes:
        parts = []
        while n > 0:
            if not self.buffer:
                self.buffer = self.more()
                if not self.buffer:
                    raise ValueError("a record ends before its Content-Length")
            part, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(part)
            if keep:
                parts.append(part)
        return b"".join(parts)

    def next_start(self) -> int:
        if self.length is not None:
            return self.start + self.length
        if self.plain:
            return self.at - len(self.buffer)
        while self.more():
            pass
        return self.at


def read_records(f, size: int, start: int, wanted, payloads: bool) -> Iterator[tuple[dict, bytes | None]]:
    """Headers and payload of the wanted records of one archive; unwanted ones are passed over after their headers."""
    at = start
    while at < size:
        text = _Text(f, at)
        if text.plain:  # blank lines between uncompressed records
            first = text.more()
            text.buffer = first.lstrip(b"\r\n")
            if not text.buffer:
                return
        version = text.until(b"\r\n", CHUNK)
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        # some writers send no header at all; then the blank line follows at once
        lines = b"" if text.buffer.startswith(b"\r\n") and text.take(2, True) else text.until(b"\r\n\r\n")
        headers: dict[str, str] = {}
        for line in lines.decode("utf-8", "replace").split("\r\n"):
            name, colon, value = line.partition(":")
            if colon:
                headers[name.strip().lower()] = value.strip()
        length = int(headers.get("content-length", "0"))
        if wanted(headers):
            payload = None
            if payloads:
                payload = text.take(length, True)
                if headers.get("content-type", "").startswith("application/http"):
                    payload = payload.partition(b"\r\n\r\n")[2]
                if headers.get("warc-type") == "revisit":
                    payload = None
            elif text.length is None:
                text.take(length, False)
            yield headers, payload
        elif text.length is None:
            text.take(length, False)
        at = text.next_start()


@dataclass
class Archives(InputPartition):
    files: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path = options["path"]
        self.payloads = options.get("payloads", "true").lower() != "false"
        self.split = int(options.get("partition_bytes", 64 << 20))
        self.conditions: list[tuple[str, frozenset]] = []
        if types := options.get("record_types"):
            self.conditions.append(("warc-type", frozenset(types.split(","))))
        self.names = schema.fieldNames()

    def pushFilters(self, filters):
        for x in filters:
            path = x.attribute if isinstance(x, (EqualTo, In)) else ()
            values = frozenset([x.value] if isinstance(x, EqualTo) else x.value if isinstance(x, In) else [])
            if len(path) == 1 and path[0] in HEADER_OF and path[0] not in ("payload_digest",):
                self.conditions.append((HEADER_OF[path[0]].lower(), values))
            elif len(path) == 2 and path[0] == "headers":
                self.conditions.append((path[1].lower(), values))
            else:
                yield x

    def partitions(self):
        fs, root = open_folder(self.path)
        listed = fs.get_file_info(f"{root}/{MANIFEST}")
        if listed.type == pafs.FileType.File:  # written by this source: only what was committed
            with fs.open_input_stream(listed.path) as f:
                files = [(f"{root}/{n}", size) for n, size in json.loads(f.read())]
        else:
            info = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
            files = [(i.path, i.size) for i in info if i.path.endswith((".warc", ".warc.gz"))]
        # small archives share a partition; largest first, so that partitions come out even
        parts: list[Archives] = []
        room = 0
        for file, size in sorted(files, key=lambda x: (-x[1], x[0])):
            if not parts or room < size:
                parts.append(Archives([]))
                room = self.split
            parts[-1].files.append((file, size))
            room -= size
        return parts or [Archives([])]

    def read(self, partition):
        fs, _ = open_folder(self.path)
        conditions = self.conditions
        wanted = lambda h: all(h.get(name) in values for name, values in conditions)
        for file, size in partition.files:
            with fs.open_input_file(file) as raw:
                for h, payload in read_records(raw, size, 0, wanted, self.payloads):
                    count = h.get(PAYLOAD_BYTES.lower())
                    row = {k: h.get(v.lower()) for k, v in HEADER_OF.items()}
                    row |= {
                        "payload_digest": digest_hex(row["payload_digest"]), "headers": h, "payload": payload,
                        "payload_bytes": len(payload) if payload is not None else int(count) if count else None,
                    }
                    yield tuple(row.get(n) for n in self.names)


@dataclass
class Wrote(WriterCommitMessage):
    file: str
    size: int


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, schema):
        self.path, self.names = options["path"], schema.fieldNames()

    def write(self, iterator):
        fs, root = open_folder(self.path)
        fs.create_dir(root)
        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for row in iterator:
                data = member(record_bytes({n: row[n] for n in self.names}))
                out.write(data)
                size += len(data)
        return Wrote(name, size)

    def commit(self, messages):
        fs, root = open_folder(self.path)
        fs.create_dir(root)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps([(m.file, m.size) for m in messages if m is not None and m.size]).encode())

    def abort(self, messages):
        fs, root = open_folder(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/{m.file}")


class WarcSource(DataSource):
    """``spark.read.format("warc")``: options path, record_types (comma-separated), payloads (false: headers only), partition_bytes."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options), schema)

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def deduplicated(records: DataFrame, least: int = 1000) -> DataFrame:
    """Response and revisit records of (record_id string, order, target_uri, date, body string).

    Of records with equal payloads of at least ``least`` bytes the one with the largest ``order`` is the response,
    the others revisit it; smaller ones are all responses. A null body is empty; a null order never wins over
    others; rows that share the winner's order are responses too.
    """
    keyed = records.select(
        "record_id", "target_uri", "date", F.col("order").alias("_order"), F.coalesce("body", F.lit("")).cast("binary").alias("payload"),
    ).select("*", F.sha1("payload").alias("payload_digest"), F.length("payload").cast("long").alias("payload_bytes"))
    # the winner of each payload comes from narrow rows, folded in every task before they move
    best = keyed.where(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).agg(
        F.max(F.struct("_order", "record_id")).alias("_best"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    joined = keyed.join(best, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    first = F.col("_best").isNull() | F.col("_order").eqNullSafe(F.col("_best._order"))
    return joined.select(
        "record_id", F.when(first, "response").otherwise("revisit").alias("record_type"), "target_uri", "date",
        F.when(~first, F.col("_best.record_id")).alias("refers_to"), "payload_digest", "payload_bytes",
        F.lit(None).cast("map<string,string>").alias("headers"), F.when(first, F.col("payload")).alias("payload"),
    )


def write(records: DataFrame, path: str) -> None:
    """Writes records with the columns of ``SCHEMA`` as archives below ``path``."""
    register(records.sparkSession)
    records.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)
