"""WARC archives as a Spark data source, ``format("warc")``.

Reading plans one partition per group of archive files (small ones together, up to
``partitionBytes``). Each record's headers are parsed first; comparisons of warc_type,
record_id, target_uri, content_length, payload_digest and refers_to with constants are
pushed down and decided on them, and the payload of a record that fails is skipped:
an uncompressed one is seeked over, in a gzip member the bytes are inflated but neither
kept nor decoded. With option ``payload`` "false" no payload is read at all.

Writing puts each partition into files of up to ``fileBytes``, a gzip member per record
(``compression`` "none": plain). Files get their final name only when the whole job commits,
so a task that runs again leaves nothing behind. A record without a WARC-Date among its
headers gets the job's: option ``date``, or the time at which the writer was made.

Names of headers are compared without regard to case, and folded lines are joined. A record
without a length, one that does not begin with its version, and a file that ends within a
record stop the job with an error that names the file.

Paths may lie in any store that pyarrow's filesystems reach. Nulls: a record without a
target, digest or reference has no such header and reads back as null; a null payload is
written as an empty one. Values of headers have their control characters percent-encoded.
"""

from __future__ import annotations

import zlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

SCHEMA = (
    "warc_type string, record_id string, target_uri string, content_length long, payload_digest string, "
    "refers_to string, headers map<string,string>, payload binary"
)
#: Column and header of each record attribute.
HEADERS = {
    "warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
    "content_length": "Content-Length", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
}
CHUNK = 1 << 20
BATCH_BYTES = 4 << 20
END = b"\r\n\r\n"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and ":/" not in path:
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


# -- reading ------------------------------------------------------------------------------


class _Bytes:
    """Bytes of an archive: read(n) and skip(n), over plain or gzip files, in bounded memory."""

    def __init__(self, file: pa.NativeFile, gz: bool):
        self.file, self.gz = file, gz
        self.inflate = zlib.decompressobj(31) if gz else None
        self.raw = self.buf = b""
        self.at = 0

    def _more(self) -> bool:
        if not self.gz:
            got = self.file.read(CHUNK)
        else:
            got = b""
            while not got:
                if self.inflate.eof:
                    self.raw = self.inflate.unused_data or self.raw
                    self.inflate = zlib.decompressobj(31)
                elif self.inflate.unconsumed_tail:
                    self.raw = self.inflate.unconsumed_tail
                if not self.raw:
                    self.raw = self.file.read(CHUNK)
                    if not self.raw:
                        break
                raw, self.raw = self.raw, b""
                got = self.inflate.decompress(raw, CHUNK)
        self.buf = self.buf[self.at :] + got
        self.at = 0
        return bool(got)

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark, which is passed over; None at the end of the file."""
        seen = self.at
        while (i := self.buf.find(mark, seen)) < 0:
            seen = max(self.at, len(self.buf) - len(mark) + 1) - self.at
            if not self._more():
                if self.buf[self.at :].strip():
                    raise EOFError("archive ends within a record's headers")
                return None
            seen += self.at
        out = self.buf[self.at : i]
        self.at = i + len(mark)
        return out

    def read(self, n: int) -> bytes:
        parts = []
        while n:
            if self.at == len(self.buf) and not self._more():
                raise EOFError("archive ends within a record")
            part = self.buf[self.at : self.at + n]
            parts.append(part)
            self.at += len(part)
            n -= len(part)
        return b"".join(parts)

    def skip(self, n: int) -> None:
        have = len(self.buf) - self.at
        if not self.gz and n > have:
            if self.file.tell() + n - have > self.file.size():
                raise EOFError("archive ends within a record")
            self.file.seek(n - have, 1)
            self.buf, self.at = b"", 0
            return
        while n:
            if self.at == len(self.buf) and not self._more():
                raise EOFError("archive ends within a record")
            step = min(n, len(self.buf) - self.at)
            self.at += step
            n -= step


def parse_headers(block: bytes) -> dict[str, str]:
    """Named fields of a record's header block, as spelt there; of one name the last counts."""
    first, *lines = block.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record begins with {first[:40]!r}")
    out: dict[str, str] = {}
    last = None
    for line in lines:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and last is not None:
            out[last] = f"{out[last]} {line.strip()}".strip()
        elif colon:
            last = name.strip()
            out[last] = value.strip()
    return out


def attributes(headers: dict[str, str]) -> dict:
    """The columns of ``HEADERS`` of a record; the length must be there."""
    folded = {k.lower(): v for k, v in headers.items()}
    row: dict = {c: folded.get(h.lower()) for c, h in HEADERS.items()}
    if row["content_length"] is None or not row["content_length"].isdecimal():
        raise ValueError(f"record {row['record_id']} has no length but {row['content_length']!r}")
    row["content_length"] = int(row["content_length"])
    return row


def _passes(f: Filter, row: dict) -> bool:
    v = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return v is None
    if v is None:
        return False
    if isinstance(f, EqualTo):
        return v == f.value
    if isinstance(f, In):
        return v in f.value
    if isinstance(f, GreaterThan):
        return v > f.value
    if isinstance(f, GreaterThanOrEqual):
        return v >= f.value
    if isinstance(f, LessThan):
        return v < f.value
    if isinstance(f, LessThanOrEqual):
        return v <= f.value
    if isinstance(f, StringStartsWith):
        return v.startswith(f.value)
    if isinstance(f, StringEndsWith):
        return v.endswith(f.value)
    if isinstance(f, StringContains):
        return f.value in v
    return isinstance(f, IsNotNull)


PUSHED = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, StringEndsWith, StringContains, IsNull, IsNotNull)


class FileGroup(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.options, self.filters = options["path"], options, []
        self.schema = schema
        self.names = [f.name for f in schema]

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, PUSHED) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, at = _open(self.path)
        most = int(self.options.get("partitionbytes", 64 << 20))
        files = fs.get_file_info(pafs.FileSelector(at, recursive=True))
        files = sorted((f for f in files if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)
        groups: list[list[str]] = []
        size = most + 1
        for f in files:
            if size + f.size > most:
                groups.append([])
                size = 0
            groups[-1].append(f.path)
            size += f.size
        return [FileGroup(g) for g in groups] or [FileGroup([])]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, _ = _open(self.path)
        schema = to_arrow_schema(self.schema)
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            for row in self._records(fs, path):
                rows.append(row)
                size += 200 + len(row.get("payload") or b"")
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    @staticmethod
    def _next(data: _Bytes, path: str) -> dict | None:
        """Attributes and headers of the record that begins here; None at the end of the file."""
        try:
            block = data.until(END)
            if block is None:
                return None
            headers = parse_headers(block)
            return attributes(headers) | {"headers": headers}
        except (ValueError, EOFError) as e:
            raise type(e)(f"{path}: {e}") from e

    def _records(self, fs: pafs.FileSystem, path: str) -> Iterator[dict]:
        payloads = self.options.get("payload", "true").lower() == "true" and "payload" in self.names
        with fs.open_input_file(path) as file:
            data = _Bytes(file, path.endswith(".gz"))
            while (row := self._next(data, path)) is not None:
                length, headers = row["content_length"], row.pop("headers")
                if all(_passes(f, row) for f in self.filters):
                    row["headers"] = list(headers.items())
                    if payloads:
                        row["payload"] = data.read(length)
                    else:
                        data.skip(length)
                    yield {c: row.get(c) for c in self.names}
                else:
                    data.skip(length)
                data.skip(len(END))


# -- writing ------------------------------------------------------------------------------


def _clean(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(row: dict, date: str) -> bytes:
    """One record, header block first; ``date`` unless its headers have one."""
    payload = row.get("payload") or b""
    lines = ["WARC/1.0"]
    own = {h.lower() for h in HEADERS.values()}
    if not any(k.lower() == "warc-date" and v is not None for k, v in row.get("headers") or []):
        lines.append(f"WARC-Date: {date}")
    lines += [f"{h}: {_clean(row[c])}" for c, h in HEADERS.items() if c != "content_length" and row.get(c) is not None]
    lines += [f"{_clean(k)}: {_clean(v)}" for k, v in row.get("headers") or [] if v is not None and k.lower() not in own]
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode("utf-8", "replace") + END + payload + END


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.options, self.overwrite = options["path"], options, overwrite
        self.job = uuid.uuid4().hex[:12]
        self.date = options.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, at = _open(self.path)
        fs.create_dir(at, recursive=True)
        gz = self.options.get("compression", "gzip") == "gzip"
        most = int(self.options.get("filebytes", 256 << 20))
        task = TaskContext.get().partitionId()
        attempt = uuid.uuid4().hex[:8]
        files: list[tuple[str, str]] = []
        out, size = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{self.job}-{task:05d}-{len(files):03d}.warc" + (".gz" if gz else "")
                    files.append((f"{at}/_{attempt}-{name}", f"{at}/{name}"))
                    out, size = fs.open_output_stream(files[-1][0], compression=None), 0
                data = record_bytes(row, self.date)
                if gz:
                    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = squeeze.compress(data) + squeeze.flush()
                out.write(data)
                size += len(data)
                if size >= most:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = _open(self.path)
        fs.create_dir(at, recursive=True)
        if self.overwrite:
            new = {a for m in messages if m for a, _ in m.files}
            for f in fs.get_file_info(pafs.FileSelector(at)):
                if f.is_file and f.path not in new and ".warc" in f.base_name:
                    fs.delete_file(f.path)
        for m in messages:
            for a, b in m.files if m else []:
                fs.move(a, b)
        for f in fs.get_file_info(pafs.FileSelector(at)):
            if f.base_name.startswith("_") and f"-{self.job}-" in f.base_name:
                fs.delete_file(f.path)  # of attempts that did not count

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            for a, _name in m.files if m else []:
                if fs.get_file_info(a).is_file:
                    fs.delete_file(a)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options), schema)  # names in lower case

    def writer(self, schema, overwrite: bool):
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``format("warc")`` known and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# -- deduplicated archives of pages -----------------------------------------------------


def base32_sha1(hex_digest) -> "F.Column":
    """Bare upper-case base32 of a SHA-1 given in hexadecimal: 20 bits, four letters, at a time."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for i in range(8):
        v = F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(letters, F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def archive_records(pages: DataFrame, key: str, url: str, body: str, min_bytes: int = 0) -> DataFrame:
    """Records to write for raw pages: response, or revisit of the equal payload with the least key.

    Payloads shorter than ``min_bytes`` are all responses. A null body is an empty payload.
    Rows that repeat a key and payload are the same record and are all responses; a null key
    is greater than any other and cannot be referred to. Payloads are told apart by SHA-256,
    the least key is found with partial sums, and each payload is shuffled once.
    """
    payload = F.encode(F.coalesce(pages[body].cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(pages[key].cast("long").alias("__key"), pages[url].cast("string").alias("__url"), payload.alias("__payload"))
    rows = rows.withColumn("__same", F.sha2("__payload", 256))
    least = rows.groupBy("__same").agg(F.min("__key").alias("__first"))
    rows = rows.join(least, "__same")
    again = (F.length("__payload") >= min_bytes) & F.col("__first").isNotNull() & ~F.col("__key").eqNullSafe(F.col("__first"))
    digest = F.concat(F.lit("sha1:"), base32_sha1(F.sha1("__payload")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"),
        urn("__key").alias("record_id"),
        F.col("__url").alias("target_uri"),
        F.length("__payload").cast("long").alias("content_length"),
        digest.alias("payload_digest"),
        F.when(again, urn("__first")).alias("refers_to"),
        F.create_map(
            F.lit("X-Payload-Bytes"), F.length("__payload").cast("string"),
            F.lit("WARC-Profile"), F.when(again, "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
        ).alias("headers"),
        F.when(~again, F.col("__payload")).alias("payload"),
    )


def archived_pages(records: DataFrame) -> DataFrame:
    """Pages as the archives hold them: length and digest of a response are taken from its payload."""
    number = lambda c: F.regexp_extract(F.col(c), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    response = F.col("warc_type") == "response"
    return records.select(
        number("record_id").alias("page_id"),
        F.when(response, F.length("payload").cast("long")).otherwise(F.col("headers")["X-Payload-Bytes"].cast("long")).alias("payload_bytes"),
        F.when(response, base32_sha1(F.sha1("payload"))).otherwise(F.expr("substring(payload_digest, 6)")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.when(~response, number("refers_to")).alias("refers_to"),
        F.col("target_uri").alias("url"),
    )
