"""WARC archives as a PySpark Python data source.

``spark.read.format("warc").load(path)`` and ``df.write.format("warc").save(path)``.
The writer makes one gzip member per record, with the member's own length in an ``sl``
extra field; files are rolled at ``maxFileBytes`` and named by task attempt, and only
those that a commit lists in the manifest belong to the archive, so lost and repeated
tasks leave nothing behind in the data.

The reader plans one partition per file. It inflates a record's headers first, little by
little; filters on the header columns are pushed down and judged there, and a record that
they refuse, or whose payload is not asked for (``payload`` = ``false``), is skipped by
seeking over the rest of its member. Archives of others, plain or gzip without ``sl``, are
read too. Page ids are percent-encoded in headers, so any text comes back as it was.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    WriterCommitMessage,
)

from oligo_engine.llm.common import checkpoint, shared_dir

SCHEMA = (
    "record_id string, record_type string, target_uri string, page_id string, payload_bytes long, "
    "payload_digest string, refers_to string, payload binary"
)
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "page_id": "x-page-id",
    "payload_bytes": "x-payload-length",
    "payload_digest": "warc-payload-digest",
    "refers_to": "x-refers-to-page-id",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "manifest-"
#: Bytes that one step of reading inflates to at most.
STEP = 1 << 16


def file_system(path: str):
    from pyarrow import fs

    if re.match(r"[a-z0-9]+:/", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def member(record: bytes, level: int) -> bytes:
    """One gzip member that names its own length."""
    squeezer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeezer.compress(record) + squeezer.flush()
    extra = b"sl" + struct.pack("<H", 8)
    total = 10 + 2 + len(extra) + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra) + 8) + extra
    return head + struct.pack("<II", total, len(record) & 0xFFFFFFFF) + body + struct.pack(
        "<II", zlib.crc32(record), len(record) & 0xFFFFFFFF
    )


def one_line(value: object) -> str:
    return re.sub(r"[\r\n]+", " ", str(value))


def record(row: dict) -> bytes:
    """A response with its payload, or a revisit that names the record it repeats."""
    payload = (row["payload"] or "").encode()
    revisit = row["record_type"] == "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Target-URI: {one_line(row['url'] or '')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {quote(str(row['page_id']), safe='')}")
    block = b""
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-ID: {quote(str(row['refers_to']), safe='')}"]
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed_headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def header_columns(headers: dict[str, str]) -> dict:
    found = {c: headers.get(h) for c, h in HEADERS.items()}
    for name in ("page_id", "refers_to"):
        found[name] = None if found[name] is None else unquote(found[name])
    found["payload_bytes"] = int(found["payload_bytes"]) if found["payload_bytes"] else None
    found["payload_digest"] = (found["payload_digest"] or "").partition(":")[2] or found["payload_digest"]
    return found


def payload_of(block: bytes, kind: str) -> bytes:
    """The entity body of an HTTP block; other blocks are payload as a whole."""
    return block.partition(b"\r\n\r\n")[2] if kind.startswith("application/http") else block


def records(file, size: int, wanted, payload: bool) -> Iterator[dict]:
    """Header columns (and payload) of the wanted records of one archive file."""
    at = 0
    while at < size:
        file.seek(at)
        start = file.read(min(1 << 12, size - at))
        packed = start[:2] == b"\x1f\x8b"
        length = None
        if packed and start[3] & 4:
            (extra,) = struct.unpack_from("<H", start, 10)
            if start[12:14] == b"sl" and extra >= 12:
                (length,) = struct.unpack_from("<I", start, 16)
        opened = zlib.decompressobj(31) if packed else None
        text = opened.decompress(start, 1 << 12) if packed else start
        read = len(start)

        def more() -> bytes:
            nonlocal read
            raw = opened.unconsumed_tail if packed else b""
            if not raw:
                raw = file.read(STEP)
                read += len(raw)
            text = opened.decompress(raw, STEP) if packed else raw
            if not raw and not text and not (packed and opened.eof):
                raise EOFError("an archive ends within a record")
            return text

        while b"\r\n\r\n" not in text:
            text += more()
        head, _, rest = text.partition(b"\r\n\r\n")
        headers = parsed_headers(head.lstrip())
        block, found = int(headers.get("content-length", 0)), header_columns(headers)
        keep = wanted(found)
        parts, have = [rest], len(rest)
        if keep and payload or packed and length is None:
            while have < block + 4 and not (packed and opened.eof):
                parts.append(more())
                have += len(parts[-1])
        if keep:
            if payload:
                found["payload"] = payload_of(b"".join(parts)[:block], headers.get("content-type", ""))
            yield found
        if not packed:
            at += len(head) + 4 + block + 4
        elif length is not None:
            at += length
        else:
            while not opened.eof:
                more()
            at += read - len(opened.unused_data)


class Files(InputPartition):
    def __init__(self, path: str, size: int):
        super().__init__((path, size))
        self.path, self.size = path, size


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Equality, membership and null tests of header columns are judged on headers."""
        for f in filters:
            column = getattr(f, "attribute", (None,))
            if len(column) == 1 and column[0] in HEADERS and isinstance(f, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull)):
                self.tests.append((type(f).__name__, column[0], getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, found: dict) -> bool:
        for kind, column, value in self.tests:
            has = found[column]
            fits = {
                "EqualTo": lambda: has is not None and has == value,
                "EqualNullSafe": lambda: has == value,
                "In": lambda: has is not None and has in value,
                "IsNull": lambda: has is None,
                "IsNotNull": lambda: has is not None,
            }[kind]()
            if not fits:
                return False
        return True

    def partitions(self):
        from pyarrow import fs

        system, root = file_system(self.root)
        listed = [x for x in system.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File]
        manifests = [x for x in listed if x.base_name.startswith(MANIFEST)]
        if manifests:
            names = set()
            for m in manifests:
                with system.open_input_stream(m.path) as f:
                    names |= set(f.read().decode().split())
            listed = [x for x in listed if x.base_name in names]
        else:
            listed = [x for x in listed if re.search(r"\.warc(\.gz)?$", x.base_name)]
        return [Files(x.path, x.size) for x in sorted(listed, key=lambda x: x.path) if x.size]

    def read(self, partition):
        if partition is None:  # no file at all
            return
        system, _ = file_system(self.root)
        kinds = pa.schema([(c, pa.int64() if c == "payload_bytes" else pa.string()) for c in HEADERS] + [("payload", pa.binary())])
        rows, held = [], 0
        with system.open_input_file(partition.path) as file:
            for found in records(file, partition.size, self.wanted, self.payload):
                rows.append(found)
                held += 200 + len(found.get("payload") or b"")
                if len(rows) >= 4096 or held > 1 << 22:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.level = int(options.get("level", 1))
        self.most = int(options.get("maxFileBytes", 256 << 20))

    def write(self, iterator):
        system, root = file_system(self.root)
        system.create_dir(root, recursive=True)
        names: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    packed = member(record(row), self.level)
                    if out is None or size + len(packed) > self.most:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = system.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                    out.write(packed)
                    size += len(packed)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages):
        system, root = file_system(self.root)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}", compression=None) as f:
            f.write("\n".join(n for m in messages if m is not None for n in m.names).encode())

    def abort(self, messages):
        """Files without a manifest entry are no part of the archive."""


class WarcSource(DataSource):
    """Rows to write: page_id, url, payload (text), payload_digest, record_type, refers_to."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """Rows for the writer: of equal payloads of ``least`` bytes the smallest page is the
    response and the others revisit it.

    A null html is an empty payload; null page ids are never the smallest, and where no
    payload's page has an id all are responses; rows that repeat the smallest page are
    responses like it. The first pages are found by partial aggregation, and the join
    that brings them back can be split, so one payload may hold any share of the pages.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumns(
        {"payload_digest": F.sha2("payload", 256), "_long": F.octet_length("payload") >= least}
    )
    digest = F.sha2(F.coalesce(F.col("html"), F.lit("")), 256)
    firsts = (
        pages.filter(F.octet_length("html") >= least)
        .groupBy(digest.alias("_digest"))
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    met = rows.join(firsts, (F.col("payload_digest") == F.col("_digest")) & F.col("_long"), "left")
    revisits = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id"))
    return met.select(
        "page_id",
        "url",
        "payload",
        "payload_digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("_first")).alias("refers_to"),
    )


def read_back(spark, path: str, kind) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of an archive's pages.

    Length and digest are those of the payload that a response holds; a revisit holds none
    and is told by its headers. ``kind`` is the type of page ids.
    """
    read = spark.read.format("warc").load(path).filter(F.col("record_type").isin("response", "revisit"))
    holds = F.col("record_type") == "response"
    return read.select(
        F.col("page_id").cast(kind).alias("page_id"),
        F.when(holds, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(holds, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


def archived(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from
    archives written for ``pages`` (which are deleted after that).

    Rows that repeat an id are records of their own; null ids come back as null. Further
    columns, of whatever name, are not archived.
    """
    spark = pages.sparkSession
    register(spark)
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    kind = pages.schema["page_id"].dataType
    try:
        with_revisits(pages, least).write.format("warc").mode("append").save(path)
        return checkpoint(read_back(spark, path, kind))
    finally:
        system, root = file_system(path)
        from pyarrow import fs

        if system.get_file_info(root).type != fs.FileType.NotFound:
            system.delete_dir(root)
