"""WARC archives as a Spark data source.

Writing: one gzip member per record; the member's extra field ``sl`` tells the
compressed and plain lengths, so a reader can step over a record without
inflating it. A task writes its files under names of its own and they count
only once they are in the manifest of a committed job, so a lost and repeated
task leaves nothing behind that is read, and jobs that write to one folder at
the same time don't meet.

Reading: a folder's archives, or one file. Besides what was written here, all
``.warc`` and ``.warc.gz`` files count: plain ones, with a gzip member per
record, or compressed as a whole. Files are the partitions, in groups of
bounded size; one file is read by one task. Filters on header columns
(equality, membership, null tests) are pushed down: headers are read first, and
a record that fails a filter, or whose payload isn't asked for (option
``payload=false``), is stepped over: by a seek in plain files and by its length
in files written here; other compressed bytes have to be inflated, but nothing
is kept of them.

Defined results: a null payload is empty; a record without payload has a
zero-length one; header values are kept on one line (CR and LF are
percent-encoded, and stay so when read). The payload of an HTTP message is what
follows its head, as it was sent; of other records, the whole block. A file
that ends inside a record is an error.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, WriterCommitMessage

from .session import checkpoint_dir, ship

SMALLEST = 100
FILE_BYTES, PARTITION_BYTES, BATCH_BYTES = 64 << 20, 32 << 20, 4 << 20
MANIFEST, OWN = r"_archives.*\.json", r"[0-9a-f]{12}-[0-9a-f]{12}-[0-9]{5}\.warc\.gz"
HEAD_BYTES = 1 << 16
HEADERS = ("record_id", "record_type", "target_uri", "payload_digest", "refers_to", "payload_length")
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_length long, payload binary"
_FIELDS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "payload_length": "X-Payload-Length"}
_NAMES = {v.lower(): v for v in (*_FIELDS.values(), "Content-Length", "Content-Type")}  # header names don't mind their case


class Files:
    """Plain files of a folder: the local (or mounted) file system, or what pyarrow can open."""

    def __init__(self, folder: str):
        at = urlparse(folder)
        if at.scheme in ("", "file"):
            self.fs, self.root = None, at.path
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(folder)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self):
        (os.makedirs(self.root, exist_ok=True) if self.fs is None else self.fs.create_dir(self.root))

    def write(self, name: str):
        return open(self.path(name), "wb") if self.fs is None else self.fs.open_output_stream(self.path(name))

    def read(self, name: str):
        return open(self.path(name), "rb") if self.fs is None else self.fs.open_input_file(self.path(name))

    def exists(self, name: str) -> bool:
        if self.fs is None:
            return os.path.exists(self.path(name))
        return self.fs.get_file_info(self.path(name)).is_file

    def list(self) -> dict[str, int]:
        """Sizes of the folder's files by name."""
        if self.fs is None:
            return {e.name: e.stat().st_size for e in os.scandir(self.root) if e.is_file()} if os.path.isdir(self.root) else {}
        from pyarrow import fs

        return {i.base_name: i.size for i in self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True)) if i.is_file}

    def remove(self, name: str) -> None:
        if self.exists(name):
            os.remove(self.path(name)) if self.fs is None else self.fs.delete_file(self.path(name))


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def member(record: bytes) -> bytes:
    """One gzip member with the lengths of itself and of the record."""
    c = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = c.compress(record) + c.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    total = 12 + 12 + len(body) + 8
    if max(total, len(record)) >= 1 << 32:  # the field has 32 bits; without it the record is inflated when it is passed
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, total, len(record))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def record(fields: dict[str, str | None], payload: bytes, when: str) -> bytes:
    """A response record with its payload, or a revisit without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if fields["record_type"] == "response" else b"")
    lines = ["WARC/1.1"]
    lines += [f"{_FIELDS[k]}: {_line(str(v))}" for k, v in fields.items() if v is not None]
    if fields["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += [f"WARC-Date: {when}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.job = options["path"], uuid.uuid4().hex[:12]
        self.when = options.get("date", "2000-01-01T00:00:00Z")
        Files(self.folder).create()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, names, out, size = Files(self.folder), [], None, 0
        own = uuid.uuid4().hex[:12]
        for batch in iterator:
            cols = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                if out is None:
                    name = f"{self.job}-{own}-{len(names):05d}.warc.gz"
                    out, size = files.write(name), 0
                fields = {k: cols[k][i].as_py() for k in HEADERS}
                data = member(record(fields, cols["payload"][i].as_py() or b"", self.when))
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    names.append((name, size))
                    out = None
        if out is not None:
            out.close()
            names.append((name, size))
        return _Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        listed = [f for m in messages if m is not None for f in m.files]
        with Files(self.folder).write(f"_archives-{self.job}.json") as f:
            f.write(json.dumps(listed).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files = Files(self.folder)
        for m in messages:
            for name, _ in m.files if m is not None else ():
                files.remove(name)


@dataclass
class _Archives(InputPartition):
    names: list[str]


class _Plain:
    """Bytes of a file in order, with a look ahead; what isn't wanted is passed by a seek."""

    def __init__(self, f):
        self.f, self.held = f, b""

    def _more(self) -> bytes:
        return self.f.read(1 << 16)

    def until(self, mark: bytes, most: int) -> bytes | None:
        """Bytes up to and with ``mark``, or None if it isn't among the next ``most``."""
        while mark not in self.held and len(self.held) < most:
            more = self._more()
            if not more:
                break
            self.held += more
        at = self.held.find(mark)
        return None if at < 0 else self.read(at + len(mark))

    def read(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            more = self._more()
            if not more:
                raise EOFError("the archive ends inside a record")
            parts.append(more)
            have += len(more)
        data = b"".join(parts) if len(parts) > 1 else parts[0]
        self.held = data[n:]
        return data[:n]

    def skip(self, n: int) -> None:
        passed = min(n, len(self.held))
        self.held = self.held[passed:]
        if n > passed:
            at = self.f.tell() + n - passed
            self.f.seek(0, os.SEEK_END)
            if self.f.tell() < at:
                raise EOFError("the archive ends inside a record")
            self.f.seek(at)

    def at_end(self) -> bool:
        """Whether only line breaks are left."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            if self.held:
                return False
            self.held = self._more()
            if not self.held:
                return True


class _Inflated(_Plain):
    """The same of gzip members, one after the other."""

    def __init__(self, f):
        super().__init__(f)
        self.z, self.raw = zlib.decompressobj(31), b""

    def _more(self) -> bytes:
        while True:
            if self.z.eof:
                self.raw = self.z.unused_data.lstrip(b"\0")
                self.z = zlib.decompressobj(31)
            raw = self.raw or self.f.read(1 << 16)
            self.raw = b""
            if not raw:
                return b""
            got = self.z.decompress(raw)
            if got:
                return got

    def skip(self, n: int) -> None:
        while n:
            n -= len(self.read(min(n, 1 << 20)))


def _headers(head: bytes) -> dict[str, str]:
    lines = (x.split(":", 1) for x in head.decode("utf-8", "replace").splitlines()[1:] if ":" in x)
    return {_NAMES.get(k.strip().lower(), k.strip()): v.strip() for k, v in lines}


class Stream:
    """Records of one archive, headers first."""

    def __init__(self, f):
        self.f = f

    def records(self, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
        magic = self.f.read(2)
        self.size = self.f.seek(0, os.SEEK_END)
        self.f.seek(0)
        if magic != b"\x1f\x8b":
            yield from self._sequence(_Plain(self.f), wanted, with_payload)
            return
        while (length := self._own()) is not None:
            if not length:
                return
            yield from self._member(length, wanted, with_payload)
        yield from self._sequence(_Inflated(self.f), wanted, with_payload)

    def _own(self) -> int | None:
        """The length of the next member, 0 at the end, or None if it doesn't tell."""
        start = self.f.tell()
        fixed = self.f.read(12)
        extra = self.f.read(struct.unpack("<H", fixed[10:])[0]) if len(fixed) == 12 and fixed[3] == 4 else b""
        self.f.seek(start)
        if not fixed:
            return 0
        return struct.unpack("<I", extra[4:8])[0] if extra[:2] == b"sl" and len(extra) == 12 else None

    def _member(self, length: int, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """The record of a member of known length: no more than its first bytes are inflated for the headers."""
        f, start = self.f, self.f.tell()
        if start + length > self.size:
            raise EOFError("the archive ends inside a record")
        z, read, got = zlib.decompressobj(31), 0, b""
        while b"\r\n\r\n" not in got and not z.eof:
            raw = f.read(min(length - read, 1024))
            read += len(raw)
            got += z.decompress(raw)
        head, _, rest = got.partition(b"\r\n\r\n")
        headers = _headers(head)
        keep = wanted(headers)
        payload = None
        if keep and with_payload:
            block = (rest + z.decompress(f.read(length - read)) + z.flush())[: int(headers["Content-Length"])]
            payload = block.partition(b"\r\n\r\n")[2]
        f.seek(start + length)
        if keep:
            yield headers, payload

    def _sequence(self, source: _Plain, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """Records one after the other, whoever wrote them."""
        while not source.at_end():
            head = source.until(b"\r\n\r\n", HEAD_BYTES)
            if head is None or not head.startswith(b"WARC/"):
                raise ValueError("no WARC record where one should begin")
            headers = _headers(head)
            left = int(headers["Content-Length"])
            if headers.get("Content-Type", "").lower().startswith("application/http"):
                source.until(b"\0" * 9, min(left, HEAD_BYTES))  # looks ahead
                at = source.held[:left].find(b"\r\n\r\n", 0, HEAD_BYTES)
                if at >= 0:
                    source.skip(at + 4)
                    left -= at + 4
            headers.setdefault("X-Payload-Length", str(left))
            keep = wanted(headers)
            payload = source.read(left) if keep and with_payload else None
            if payload is None:
                source.skip(left)
            if keep:
                yield headers, payload


def _value(headers: dict[str, str], column: str):
    v = headers.get(_FIELDS[column])
    return int(v) if v is not None and column == "payload_length" else v


def _test(f: Filter):
    """A test of headers for a pushed filter, or None if it isn't supported."""
    if len(f.attribute) != 1 or f.attribute[0] not in _FIELDS:
        return None
    name = f.attribute[0]
    if isinstance(f, EqualTo | EqualNullSafe):
        return lambda h, v=f.value: _value(h, name) == v
    if isinstance(f, In):
        return lambda h, v=frozenset(f.value): _value(h, name) in v
    if isinstance(f, IsNull):
        return lambda h: _value(h, name) is None
    if isinstance(f, IsNotNull):
        return lambda h: _value(h, name) is not None
    return None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.only = options["path"], None
        if self.folder.endswith((".warc", ".warc.gz")):
            self.folder, _, self.only = self.folder.rpartition("/")
        self.payload = options.get("payload", "true").lower() == "true"
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            test = _test(f) if isinstance(f, EqualTo | EqualNullSafe | In | IsNull | IsNotNull) else None
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def _files(self) -> dict[str, int]:
        """Sizes of the archives by name: what committed jobs wrote here, and any other."""
        files = Files(self.folder)
        found = files.list()
        archives = {n: size for n, size in found.items() if n.endswith((".warc", ".warc.gz")) and not re.fullmatch(OWN, n)}
        for name in found:
            if re.fullmatch(MANIFEST, name):
                archives |= dict(json.loads(files.read(name).read()))
        return archives

    def partitions(self) -> list[InputPartition]:
        if self.only is not None:
            return [_Archives([self.only])]
        out, held, size = [], [], 0
        for name, length in sorted(self._files().items()):
            if held and size + length > PARTITION_BYTES:
                out.append(_Archives(held))
                held, size = [], 0
            held.append(name)
            size += length
        return [*out, _Archives(held)]

    def read(self, partition: _Archives) -> Iterator[pa.RecordBatch]:
        files, tests = Files(self.folder), self.tests
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        names = [*HEADERS, "payload"]
        rows: list[list] = [[] for _ in names]
        size = 0
        wanted = lambda h: all(t(h) for t in tests)
        for name in partition.names:
            with files.read(name) as f:
                for headers, payload in Stream(f).records(wanted, self.payload):
                    for column, values in zip(HEADERS, rows, strict=False):
                        values.append(_value(headers, column))
                    rows[-1].append(payload)
                    size += 300 + len(payload or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], names=names)
                        rows, size = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], names=names)


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known to the session, with filter pushdown."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def records_of(pages: DataFrame) -> DataFrame:
    """One record per page. Of equal payloads of at least 100 bytes the least page_id is a response, others revisit it."""
    payload = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    each = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload"))
    each = each.select("*", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("length"))
    # grouped by two columns and joined by one: the join gets exchanges of its own, which can be split where a digest is hot
    first = each.where(F.col("length") >= SMALLEST).groupBy("digest", "length").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = each.join(first, "digest", "left")
    again = F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull())
    id_of = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return joined.select(
        id_of(F.col("page_id")).alias("record_id"),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.col("url").alias("target_uri"),
        F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"),
        F.when(again, id_of(F.col("first"))).alias("refers_to"),
        F.col("length").alias("payload_length"),
        "payload",
    )


def archive(pages: DataFrame, folder: str | None = None) -> str:
    """Write one record per page; returns the folder (one of its own below the shared checkpoint folder by default)."""
    spark = pages.sparkSession
    register(spark)
    if folder is None:
        folder = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    records_of(pages).write.format("warc").mode("append").save(folder)
    return folder


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def digests(records: DataFrame) -> DataFrame:
    """page_id and what its record tells; a response's length and digest are those of the payload that was read."""
    number = lambda c: F.when(F.length(c) > 11, F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).cast("long"))
    full = F.col("record_type") == "response"
    return records.select(
        number(F.col("record_id")).alias("page_id"),
        F.when(full, F.length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.substring("payload_digest", 8, 64)).alias("payload_digest"),
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )

