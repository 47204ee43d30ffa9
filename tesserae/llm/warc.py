"""WARC as a PySpark data source.

``df.write.format("warc")`` writes one gzip member a record, whose gzip header says how long it is (extra field LX: compressed and plain
length), so a reader can skip a record without inflating it. ``spark.read.format("warc")`` plans files into partitions by size, takes
over predicates on the record type and the headers, inflates a record no further than its headers until they have passed, and leaves the rest
of the others unread. Files come and go through Arrow's file systems, so a path is whatever URI those open.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import salted_lookup, scratch_path, stage

#: Columns that come from one header each.
HEADERS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_length long, payload binary, file string"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a file from which the writer starts another, of files read by one task, and of records sent at once; inflated for headers at a time.
FILE_BYTES, TASK_BYTES, SEND_BYTES, HEAD_BYTES = 1 << 28, 1 << 26, 1 << 23, 4096
_BREAKS = re.compile(r"[\x00-\x20\x7f]+")


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


# -- records ------------------------------------------------------------------------------------------------------------------------


def pack_record(row: dict, level: int) -> bytes:
    """One record as a gzip member. Payload and HTTP headers make up a response's block; a revisit's block has HTTP headers only.

    White space and control characters in header values become one space (none in URIs); null values have no header line.
    """
    kind, payload = row["record_type"], row["payload"] or b""
    revisit = kind == "revisit"
    length = row.get("payload_length")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {row.get('content_type') or 'text/html; charset=utf-8'}\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1"]
    for column, name in HEADERS.items():
        value = "application/http; msgtype=response" if column == "content_type" else row.get(column)
        if value is not None:
            lines.append(f"{name}: {_BREAKS.sub('%20' if column == 'target_uri' else ' ', str(value)).strip()}")
    if revisit:
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines.append(f"Content-Length: {len(block)}")
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    press = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = press.compress(data) + press.flush()
    total = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHII", 12, b"LX", 8, total, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


#: Type of the rows that report damaged records.
DAMAGED = "damaged"


def _headers(data: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    name = None
    for line in data.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            key, _, value = line.partition(b":")
            name = key.strip().decode("utf-8", "replace").lower()
            out[name] = value.strip().decode("utf-8", "replace")
    return out


class _Inflated:
    """Plain bytes of a member or of an uncompressed file, read as far as asked."""

    def __init__(self, source, member: bool):
        self.source, self.press, self.plain = source, zlib.decompressobj(31) if member else None, bytearray()
        self.ended = False

    def _more(self) -> bool:
        if self.press is None:
            got = self.source.read(HEAD_BYTES)
            self.plain += got
            self.ended = not got
        else:
            raw = self.press.unconsumed_tail or self.source.read(HEAD_BYTES)
            self.plain += self.press.decompress(raw, 16 * HEAD_BYTES)
            self.ended = self.press.eof or not raw
        return not self.ended

    def head(self) -> bytes | None:
        """Through the empty line; None at the end of the file."""
        while (at := self.plain.find(b"\r\n\r\n")) < 0:
            if not self._more() and (at := self.plain.find(b"\r\n\r\n")) < 0:
                return None
            if at >= 0:
                break
        out = bytes(self.plain[:at])
        del self.plain[: at + 4]
        return out

    def through(self, end: bytes, most: int) -> bytes:
        """Through the first ``end``, or ``most`` bytes without one."""
        while (at := self.plain.find(end, 0, most)) < 0 and len(self.plain) < most and self._more():
            pass
        return self.body(at + len(end) if at >= 0 else most)

    def skip(self, n: int) -> bool:
        """Past n bytes and the line ends after them, kept nowhere; whether there were so many."""
        while n > len(self.plain):
            n -= len(self.plain)
            self.plain.clear()
            if not self._more():
                return False
        del self.plain[:n]
        while not self.plain.lstrip(b"\r\n"):
            self.plain.clear()
            if not self._more():
                return True
        self.plain = self.plain.lstrip(b"\r\n")
        return True

    def body(self, n: int) -> bytes:
        while len(self.plain) < n and self._more():
            pass
        out = bytes(self.plain[:n])
        del self.plain[:n]
        return out


class Damaged(ValueError):
    """A record that ends before its time or can't be inflated."""


def _one(text: _Inflated, wanted, payloads: bool):
    """(headers, payload, its length), or None for a record that doesn't pass, and how many bytes of its block are left; None at the end."""
    head = text.head()
    if head is None:
        if text.plain.strip(b"\r\n"):
            raise Damaged
        return None
    headers = _headers(head.lstrip(b"\r\n"))
    stated = headers.get("content-length", "")
    if not stated.isdigit():
        raise Damaged
    block = int(stated)
    if not wanted(headers):
        return None, block
    payload, length = None, None
    if headers.get("content-type", "").startswith("application/http"):
        inner = text.through(b"\r\n\r\n", block)  # the whole HTTP header, however long
        block -= len(inner)
        own = _headers(inner[:-4]).get("content-length") or ""
        length = int(own) if own.isdigit() else None
        if payloads and headers.get("warc-type") != "revisit":
            payload = text.body(block)
    elif payloads:
        payload = text.body(block)
    if payload is not None:
        if len(payload) < block:
            raise Damaged
        length, block = len(payload), 0
    return (headers, payload, length), block


def read_records(file, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None, int | None]]:
    """(headers, payload, its length) of the records whose headers pass; gzip or plain files, a record or many in a member.

    A damaged record is reported as headers with the type ``damaged``, if those pass. Reading goes on with the next member where the damaged one says how
    long it is; else the file ends there.
    """
    size, at = file.size(), 0
    while at < size:
        file.seek(at)
        start = file.read(24)
        member = start[:2] == b"\x1f\x8b"
        known = member and len(start) == 24 and start[3] & 4 and start[12:14] == b"LX"
        file.seek(at)
        text = _Inflated(file, member)
        try:
            while (got := _one(text, wanted, payloads)) is not None:
                record, left = got
                if record:
                    yield record
                if known:  # such members have one record: what is left needn't be inflated
                    break
                if not text.skip(left):
                    raise Damaged
            if member and not known and not text.press.eof:
                raise Damaged
        except (Damaged, zlib.error):
            if wanted(lost := {"warc-type": DAMAGED}):
                yield lost, None, None
            if not known:
                return
        if known:
            at += struct.unpack("<I", start[16:20])[0]
        elif member:
            at = file.tell() - len(text.press.unused_data)
        else:
            return


# -- data source --------------------------------------------------------------------------------------------------------------------


class WarcDataSource(DataSource):
    """Format "warc". Reading: options path (a file or a folder of .warc and .warc.gz) and payload (false: none decoded). Writing: path, level."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options, overwrite)


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payloads = options["path"], str(options.get("payload", "true")).lower() != "false"
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        """Takes =, <=>, IN, IS NOT NULL and prefixes on header columns; yields the others back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            name = HEADERS.get(column, "").lower() if column != "content_type" else ""
            if name and isinstance(f, EqualTo | EqualNullSafe) and f.value is not None:
                self.tests.append((name, "in", (f.value,)))
            elif name and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name and isinstance(f, IsNotNull):
                self.tests.append((name, "any", ()))
            elif name and isinstance(f, StringStartsWith):
                self.tests.append((name, "prefix", (f.value,)))
            else:
                yield f

    def _wanted(self, headers: dict[str, str]) -> bool:
        for name, how, values in self.tests:
            value = headers.get(name)
            if value is None or how == "in" and value not in values or how == "prefix" and not value.startswith(values):
                return False
        return True

    def partitions(self) -> list[Files]:
        """Files, large ones first, packed into tasks of about TASK_BYTES."""
        files, root = open_path(self.path)
        info = files.get_file_info(root)
        found = [info] if info.is_file else files.get_file_info(pafs.FileSelector(root, recursive=True)) if info.type == pafs.FileType.Directory else []
        found = [x for x in found if x.is_file and re.search(r"\.warc(\.gz)?$", x.path) and "/_temporary/" not in x.path]
        tasks: list[Files] = []
        size = TASK_BYTES
        for x in sorted(found, key=lambda x: (-x.size, x.path)):
            if size + x.size > TASK_BYTES:
                tasks.append(Files([]))
                size = 0
            tasks[-1].paths.append(x.path)
            size += x.size
        return tasks or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = open_path(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with files.open_input_file(path) as file:
                for headers, payload, length in read_records(file, self._wanted, self.payloads):
                    rows.append((*(headers.get(h.lower()) for h in HEADERS.values()), length, payload, path))
                    held += 500 + len(payload or b"")
                    if held >= SEND_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * len(HEADERS) + [pa.int64(), pa.binary(), pa.string()]
    names = [*HEADERS, "payload_length", "payload", "file"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Tasks write under _temporary; the files of tasks that succeeded are moved at commit, so lost and repeated tasks leave nothing."""

    def __init__(self, options, overwrite: bool):
        self.path, self.level, self.overwrite, self.job = options["path"], int(options.get("level", 4)), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = open_path(self.path)
        files.create_dir(f"{root}/_temporary/{self.job}", recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size >= FILE_BYTES:
                        if out:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = files.open_output_stream(f"{root}/_temporary/{self.job}/{names[-1]}", compression=None), 0
                    record = pack_record(row, self.level)
                    out.write(record)
                    size += len(record)
        finally:
            if out:
                out.close()
        return Written(names)

    def commit(self, messages) -> None:
        files, root = open_path(self.path)
        if self.overwrite:
            for x in files.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if x.is_file:
                    files.delete_file(x.path)
        for message in messages:
            for name in message.names if message else ():
                files.move(f"{root}/_temporary/{self.job}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        files, root = open_path(self.path)
        if files.get_file_info(f"{root}/_temporary/{self.job}").type == pafs.FileType.Directory:
            files.delete_dir(f"{root}/_temporary/{self.job}")
            if not files.get_file_info(pafs.FileSelector(f"{root}/_temporary", allow_not_found=True)):
                files.delete_dir(f"{root}/_temporary")
        files.create_dir(root, recursive=True)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_warc(df: DataFrame, path: str, *, level: int = 4) -> None:
    """Write rows of record_type, record_id, target_uri, warc_date, refers_to, payload_digest, payload, payload_length (others are ignored)."""
    register(df.sparkSession)
    kinds = {"payload": "binary", "payload_length": "long"}
    columns = [F.col(c).cast(kinds.get(c, "string")).alias(c) if c in df.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in [*HEADERS, "payload_length", "payload"]]
    df.select(*columns, F.lit(None).cast("string").alias("file")).write.format("warc").mode("append").option("level", level).save(path)


def read_warc(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """Records of a file or folder, as SCHEMA. Filter on header columns: the source evaluates that before it decodes payloads."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """A record per page for ``write_warc``: of equal payloads of ``least_bytes`` or more, that of the largest id is a response, others revisit it.

    Null html is an empty payload, a null url has no target URI. A null id stands below all others; repeated rows of an id are alike, so a
    page twice in the table is a response twice. Other columns are ignored.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")})
    marks = stage(rows.select("page_id", "digest", "payload_length"), "digests")
    groups = marks.where(F.col("payload_length") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    told = salted_lookup(rows, "page_id", "digest", groups.select("digest", "first"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return told.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), name(F.col("page_id")).alias("record_id"), "target_uri",
        F.lit("2024-01-01T00:00:00Z").alias("warc_date"), F.when(revisit, name(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"), F.when(~revisit, F.col("payload")).alias("payload"), "payload_length",
    )


def archived_pages(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the pages' archive and read it back: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri.

    A response's size and digest are those of the payload that was read; a revisit's are what its headers say, and its payload isn't stored.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(archive_records(pages, **options), path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    full = read_warc(spark, path).where("record_type = 'response'")
    full = full.select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to", "target_uri")
    again = read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    again = again.select("record_id", F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", "refers_to", "target_uri")
    return full.union(again).select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"), "target_uri")
