"""WARC archives as a PySpark Python data source (format "warc").

Writing: a task writes records one after another and begins a new archive when one has `roll_mb`; commit moves finished
archives to their names, so lost or repeated tasks leave none behind. Archives are plain (".warc") or a gzip member per
record (".warc.gz"), whose extra field tells the member's length (the format's skip lengths, "sl"). Reading: files are grouped into
partitions by size; predicates on record_type, target_uri, record_id and refers_to are pushed to the reader, which parses a record's
headers first and seeks over payloads of unwanted records, and over all payloads if the option payload is "false". In plain
archives that is a seek within the file; of gzip members only the first bytes are inflated and the rest is never read, or, where other
writers left out the length, inflated piece by piece and thrown away. An archive is one task's, so `roll_mb` bounds tasks.
A gzip file that another writer made of one member for all its records is one task's too and can't be passed over unread.
Paths go through pyarrow.fs: file, hdfs, s3 and whatever else it knows.

Header names count in any case, and their values as they are; only values that no line can hold are escaped by this writer, under a mark of its own. A
record without a length, or one that is cut, ends its archive: the job fails, or, by option, the archive gives a row with an error.

Defined results: a null payload is an empty one; a null target_uri leaves its header out and reads as null; a null record_id gets a
fresh urn:uuid, as every record needs one, under a mark that makes it read as null; repeated rows are records each; of ties in
payload and id all are responses; very long payloads and urls are taken whole; an empty table writes and reads as no records; further
columns are ignored.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from . import common

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary, error string"
#: Columns and the headers that hold them.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
}
VERSION = b"WARC/1.1"
#: The profile of revisits by digest, the mark of records without an id.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = "X-Record-ID-Absent"
#: Our own mark: the names of a record's headers that are percent-encoded; others' are taken as they are.
ESCAPED = "X-Escaped-Headers"
KNOWN = {name.lower(): name for name in (*HEADERS.values(), NO_ID, ESCAPED, "Content-Length", "Content-Type", "WARC-Date", "WARC-Profile")}
#: Fixed value: a gzip header with an extra field of 12 bytes, the subfield "sl" of two lengths (member, record).
MEMBER = "<10sH2sHII"
MEMBER_SIZE = struct.calcsize(MEMBER)
MEMBER_HEAD = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff"
#: Bytes read at once, and inflated at once while headers are sought.
CHUNK, FEW = 1 << 16, 1 << 12


def filesystem(path: str):
    """(pyarrow file system, path in it)."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def needs_escape(text: str) -> bool:
    """Whether a header line can't hold the text as it is: control characters, or white space at an end."""
    return text != text.strip(" ") or any(ord(c) < 32 or ord(c) == 127 for c in text)


def header_value(text: str) -> str:
    """A text that needs it in one line: percent signs, spaces and control characters are percent-encoded, and the record names the header (ESCAPED)."""
    return "".join(f"%{ord(c):02X}" if c == "%" or ord(c) <= 32 or ord(c) == 127 else c for c in text)


def header_text(value: str) -> str:
    first, *rest = value.split("%")
    return first + "".join(chr(int(r[:2], 16)) + r[2:] for r in rest)


def read_headers(stream) -> dict[str, str]:
    """A record's headers. Names count in any case, known ones under the name they have here; lines that begin with white space go on from the one
    before; what is no UTF-8 is Latin-1; lines without a colon are passed over."""
    headers: dict[str, str] = {}
    name = None
    while (line := stream.readline()).strip():
        try:
            text = line.decode("utf-8")
        except UnicodeDecodeError:
            text = line.decode("latin-1")
        if text[0] in " \t" and name is not None:
            headers[name] += f" {text.strip()}"
            continue
        found, colon, value = text.partition(":")
        if colon:
            name = KNOWN.get(found.strip().lower(), found.strip())
            headers[name] = value.strip(" \t\r\n")
    for name in headers.pop(ESCAPED, "").split():
        if name in headers:
            headers[name] = header_text(headers[name])
    return headers


def record(values: dict, payload: bytes, date: str = "1970-01-01T00:00:00Z", content_type: str = "text/html") -> bytes:
    """A record's bytes."""
    lines, escaped = [VERSION, f"WARC-Date: {date}".encode(), f"Content-Type: {content_type}".encode()], []
    for column, name in HEADERS.items():
        if values.get(column) is not None:
            value = str(values[column])
            if needs_escape(value):
                escaped.append(name)
                value = header_value(value)
            lines.append(f"{name}: {value}".encode())
    if values.get("record_id") is None:
        lines += [f"{HEADERS['record_id']}: <urn:uuid:{uuid.uuid4()}>".encode(), f"{NO_ID}: 1".encode()]
    if escaped:
        lines.append(f"{ESCAPED}: {' '.join(escaped)}".encode())
    if values.get("record_type") == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}".encode())
    lines.append(f"Content-Length: {len(payload)}".encode())
    return b"\r\n".join(lines) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member that tells its length; one of 4 GB or more tells 0, not known."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = squeeze.compress(data) + squeeze.flush()
    whole = MEMBER_SIZE + len(body) + 8
    told = (whole, len(data)) if max(whole, len(data)) < 1 << 32 else (0, 0)
    return struct.pack(MEMBER, MEMBER_HEAD, 12, b"sl", 8, *told) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Members:
    """The inflated bytes of a file of gzip members, read as they are asked for; seek(n, 1) goes over bytes, and over the rest
    of a member that tells its length without reading it."""

    def __init__(self, raw):
        self.raw, self.at, self.kept, self.inflate = raw, 0, b"", None
        self.out, self.left = b"", None  # inflated bytes that wait; bytes of the record to come, if told
        self.end = None  # where the member ends, if told

    def _begin(self) -> bool:
        """Opens the next member; False at the file's end."""
        if len(self.kept) < MEMBER_SIZE:
            self.kept += self.raw.read(CHUNK)
        if not self.kept:
            return False
        self.inflate, self.end, self.left = zlib.decompressobj(zlib.MAX_WBITS | 16), None, None
        if len(self.kept) >= MEMBER_SIZE:
            head, extra, name, _, whole, size = struct.unpack_from(MEMBER, self.kept)
            if head[:3] == b"\x1f\x8b\x08" and head[3] & 4 and extra >= 12 and name == b"sl" and whole:
                self.end, self.left = self.at + whole, size
        return True

    def _more(self, least: int = 1) -> bool:
        """Inflates until `least` bytes wait; False at the file's end."""
        parts, n = [self.out], len(self.out)
        while n < least:
            if self.inflate is None and not self._begin():
                break
            if not self.kept:
                self.kept = self.raw.read(CHUNK)
                if not self.kept:
                    raise ValueError("an archive ends within a record")
            given = len(self.kept)
            part = self.inflate.decompress(self.kept, CHUNK if least > FEW else FEW)
            self.kept = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.at += given - len(self.kept)
            if self.left is not None:
                self.left -= len(part)
            if self.inflate.eof:
                self.inflate = self.end = self.left = None
            parts.append(part)
            n += len(part)
        self.out = b"".join(parts)
        return n >= least

    def readline(self) -> bytes:
        at = -1
        while (at := self.out.find(b"\n", max(at, 0))) < 0:
            at = len(self.out)
            if not self._more(at + 1):
                break
        end = at + 1 if at >= 0 and at < len(self.out) else len(self.out)
        line, self.out = self.out[:end], self.out[end:]
        return line

    def read(self, n: int) -> bytes:
        self._more(n)
        got, self.out = self.out[:n], self.out[n:]
        return got

    def seek(self, n: int, whence: int = 1) -> None:
        if n <= len(self.out):
            self.out = self.out[n:]
            return
        n -= len(self.out)
        self.out = b""
        if self.left is not None and n <= self.left <= n + 4:  # all but the record's last line ends: the rest of the member can go
            self.out = b"\r\n" * ((self.left - n) // 2)
            known = self.end - self.at
            if known > len(self.kept):
                self.raw.seek(self.end)
            self.at, self.kept = self.end, self.kept[known:]
            self.inflate = self.end = self.left = None
            return
        while n:
            if not self._more():
                raise ValueError("an archive ends within a record")
            step = min(n, len(self.out))
            self.out, n = self.out[step:], n - step


def read_records(stream, wanted=lambda headers: True, payloads: bool = True):
    """(headers, payload) of each wanted record. Headers first; payloads not wanted are passed over."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record begins with {line[:40]!r}")
        headers = read_headers(stream)
        if headers.pop(NO_ID, None):
            headers.pop(HEADERS["record_id"], None)
        n = headers.get("Content-Length", "")
        if not (n.isascii() and n.isdigit()):
            raise ValueError(f"a record without a length: {n[:40]!r}")
        n = int(n)
        take = wanted(headers)
        if take and payloads:
            payload = stream.read(n)
            if len(payload) < n:
                raise ValueError("an archive ends within a record")
        else:
            stream.seek(n, 1)
            payload = None
        if take:
            yield headers, payload


@dataclass
class Files(InputPartition):
    """The files that one task reads."""

    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    """A task's finished archives under their passing names; none for a task without rows."""

    parts: list[str]


class WarcSource(DataSource):
    """Options: path; reading: payload ("true"), split_mb (128, files of a task), parallelism (1, tasks aimed at), bad ("fail": a broken archive
    fails the job, "row": it is a row with an error after its good records);
    writing: compression ("none" or "gzip"), roll_mb (256, size of an archive), content_type ("text/html")."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool):
        return WarcWriter(self.options, overwrite, [f.name for f in schema.fields])


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payloads = options.get("payload", "true").lower() != "false"
        self.split = int(float(options.get("split_mb", 128)) * (1 << 20))
        self.parallelism = max(int(options.get("parallelism", 1)), 1)
        self.bad = options.get("bad", "fail").lower()
        self.allowed: dict[str, set[str]] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 and isinstance(f, (EqualTo, In)) else None
            if column in HEADERS and column != "payload_length":
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.allowed[column] = self.allowed[column] & values if column in self.allowed else values
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz")) and not f.base_name.startswith("_"))
        groups: list[Files] = []
        split, room = min(self.split, max(sum(size for _, size in files) // self.parallelism, 1 << 22)), 0
        for path, size in files:
            if size > room or not groups:
                groups.append(Files([]))
                room = split
            groups[-1].paths.append(path)
            room -= size
        return groups or [Files([])]

    def wanted(self, headers: dict[str, str]) -> bool:
        return all(headers.get(HEADERS[c]) in values for c, values in self.allowed.items())

    def read(self, partition):
        import pyarrow as pa

        system, _ = filesystem(self.path)
        names = [*HEADERS, "payload", "error"]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string()]
        rows: list[tuple] = []
        size = 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for path in partition.paths:
            with system.open_input_file(path) as raw:
                stream = Members(raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 18)
                try:
                    for headers, payload in read_records(stream, self.wanted, self.payloads):
                        length = headers.get(HEADERS["payload_length"], "")
                        rows.append((*(headers.get(HEADERS[c]) for c in names[:5]), int(length) if length.isascii() and length.isdigit() else None, payload, None))
                        size += len(payload or b"") + 200
                        if size > 1 << 23:
                            yield batch()
                            rows.clear()
                            size = 0
                except (ValueError, EOFError, zlib.error) as e:
                    if self.bad != "row":
                        raise
                    rows.append((*[None] * 7, f"{path}: {e}"))
        if rows:
            yield batch()


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool, names: list[str]):
        self.path, self.overwrite, self.names = options["path"], overwrite, names
        self.gzip = options.get("compression", "none") == "gzip"
        self.roll = int(float(options.get("roll_mb", 256)) * (1 << 20))
        self.content_type = options.get("content_type", "text/html")
        self.date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")  # the job's, so that repeated tasks write the same
        self.job = uuid.uuid4().hex[:12]

    def write(self, iterator):
        from pyspark import TaskContext

        system, root = filesystem(self.path)
        out, parts, size = None, [], 0
        context, folder = TaskContext.get(), f"{root}/_passing-{self.job}"
        for b in iterator:
            cols = {n: b.column(i) for i, n in enumerate(self.names)}
            for i in range(b.num_rows):
                values = {c: cols[c][i].as_py() for c in HEADERS if c in cols}
                made = record(values, (cols["payload"][i].as_py() if "payload" in cols else None) or b"", self.date, self.content_type)
                made = member(made) if self.gzip else made
                if out is not None and size + len(made) > self.roll:
                    out.close()
                    out = None
                if out is None:
                    system.create_dir(folder, recursive=True)
                    parts.append(f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}-{len(parts):04d}.warc{'.gz' if self.gzip else ''}")
                    out, size = system.open_output_stream(parts[-1], compression=None, buffer_size=1 << 18), 0
                out.write(made)
                size += len(made)
        if out is not None:
            out.close()
        return Written(parts)

    def commit(self, messages):
        from pyarrow import fs

        system, root = filesystem(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root)):
                if f.is_file:
                    system.delete_file(f.path)
        for m in messages:
            for part in m.parts if m is not None else []:
                system.move(part, f"{root}/{self.job}-{part.rsplit('/', 1)[1]}")
        self.abort(messages)

    def abort(self, messages):
        system, root = filesystem(self.path)
        if system.get_file_info(f"{root}/_passing-{self.job}").is_file is False:
            try:
                system.delete_dir(f"{root}/_passing-{self.job}")
            except FileNotFoundError:
                pass


def register(spark) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records_of(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", text_col: str = "html", least: int = 100) -> DataFrame:
    """A record per row, in SCHEMA's columns. Of equal payloads of at least `least` bytes, rows with the smallest id are responses and the
    others revisits that refer to it, without payload.

    Only ids and digests meet in the search for copies; payloads move once, in a join by id. Rows that repeat the smallest
    id with the same payload are all responses; so are rows with a null id."""
    payload = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    keys = rows.where((F.col("n") >= least) & F.col("id").isNotNull()).select("id", "digest")
    first = keys.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select(F.col("digest").alias("_d"), "first")
    again = keys.join(first, F.col("digest") == F.col("_d")).where("id > first").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "first").distinct()
    out = rows.join(again, (F.col("id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    return out.select(
        F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"),
        name("id").alias("record_id"),
        F.col("uri").alias("target_uri"),
        name("first").alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.col("n").alias("payload_length"),
        F.when(F.col("first").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"),
    )


def archive(pages: DataFrame, path: str, compression: str = "none", **columns) -> None:
    """Writes pages as WARC archives under path."""
    register(pages.sparkSession)
    records_of(pages, **columns).write.format("warc").option("path", path).option("compression", compression).mode("append").save()


def load(spark, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives under path."""
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).option("parallelism", spark.sparkContext.defaultParallelism).load()


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from gzip archives in the shared folder.

    A response's size and digest are those of the payload that was read; a revisit has them in its headers."""
    spark = pages.sparkSession
    path = common.shared_path(spark, "warc")
    archive(pages, path, "gzip")
    back = load(spark, path)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?\\d+)>$", 1).try_cast("long")
    is_response = F.col("record_type") == "response"
    return back.select(
        number("record_id").alias("page_id"),
        F.when(is_response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(is_response, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
