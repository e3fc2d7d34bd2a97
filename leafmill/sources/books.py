"""EPUB packages and texts as files: a PySpark Python data source that reads packages (format "epub") and writes a file a book.

Reading: files are grouped into partitions by size. A package's central directory is read first; predicates on name (equal, in, begins, ends,
contains) and path are pushed to the reader, and only wanted entries are read and inflated, or none if the option payload is "false". What is no
package, or has no documents, is a row with an error.

Writing: rows (book, ord, name, data) for "epub", (book, ord, data) for "txt", a book's rows together and in order in one partition, as
write_books() deals them. A task streams a book's rows into its file, entry by entry, so memory holds one; files are written under a passing
name and moved to theirs when the whole job commits, so a lost or repeated task, or a job that fails, leaves none.

Defined results: null data is empty; books without rows have no file; a repeated name is an entry each time, as zip files allow; an EPUB's media
type comes first, uncompressed, whatever the rows say; names that a file system would not take are replaced, with a digest against clashes.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zipfile
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

SCHEMA = "path string, ord int, name string, size long, data binary, error string"
#: The media type of packages, what documents are called.
MEDIA_TYPE = b"application/epub+zip"
DOCUMENT, NO_DOCUMENT = re.compile(r"\.(xhtml|html|htm|xml)$", re.I), re.compile(r"\.(opf|ncx)$", re.I)
#: Bytes of a batch of entries.
BATCH = 8 << 20


def filesystem(path: str):
    """(pyarrow file system, path in it): file, hdfs, s3 and what else pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:") and "://" not in path else path)


def is_document_name(name: str) -> bool:
    """P2 for a name."""
    return bool(DOCUMENT.search(name)) and not name.startswith("META-INF/") and not NO_DOCUMENT.search(name)


def read_package(stream, path: str, wanted=lambda name: True, payload: bool = True):
    """(path, ord, name, size, data, error) of a package's wanted files in their order, folders left out."""
    try:
        with zipfile.ZipFile(stream) as z:
            listed = [x for x in z.infolist() if not x.is_dir()]
            if not any(is_document_name(x.filename) for x in listed):
                yield path, None, None, None, None, "no documents"
                return
            for ord_, info in enumerate(listed):
                if wanted(info.filename):
                    yield path, ord_, info.filename, info.file_size, z.read(info) if payload else None, None
    except (zipfile.BadZipFile, EOFError, NotImplementedError, ValueError) as e:
        yield path, None, None, None, None, f"not a zip: {e}"


@dataclass
class Files(InputPartition):
    """The files that one task reads."""

    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    """A task's finished files: passing names and books."""

    files: list[tuple[str, str]]


class EpubSource(DataSource):
    """Options: path; reading: payload ("true"), split_mb (128), suffix (".epub"; empty for all files); writing: kind ("epub" or "txt"),
    separator (of a text's parts, two line feeds)."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return EpubReader(self.options)

    def writer(self, schema, overwrite: bool):
        return BookWriter(self.options, overwrite, [f.name for f in schema.fields])


class EpubReader(DataSourceReader):
    TESTS = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: lambda x, v: v in x}

    def __init__(self, options):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.split, self.suffix = int(float(options.get("split_mb", 128)) * (1 << 20)), options.get("suffix", ".epub").lower()
        self.tests: dict[str, list] = {"name": [], "path": []}

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in self.TESTS and f.attribute in (("name",), ("path",)):
                self.tests[f.attribute[0]].append((type(f), f.value))
            yield f  # Spark applies them too, so that rows with an error go as they should

    def passes(self, column: str, value: str) -> bool:
        return all(self.TESTS[kind](value, v) for kind, v in self.tests[column])

    def partitions(self):
        from pyarrow import fs

        system, root = filesystem(self.path)
        top = system.get_file_info(root)
        found = [top] if top.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        groups, room = [], 0
        for f in sorted((f for f in found if f.is_file and f.path.lower().endswith(self.suffix) and "/_passing-" not in f.path and self.passes("path", f.path)), key=lambda f: f.path):
            if f.size > room or not groups:
                groups.append(Files([]))
                room = self.split
            groups[-1].paths.append(f.path)
            room -= f.size
        return groups or [Files([])]

    def read(self, partition):
        import pyarrow as pa

        system, _ = filesystem(self.path)
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "ord", "name", "size", "data", "error"])

        for path in partition.paths:
            with system.open_input_file(path) as raw:
                for row in read_package(raw, path, lambda name: self.passes("name", name), self.payload):
                    rows.append(row)
                    size += len(row[4] or b"") + 200
                    if size > BATCH:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class Settled:
    """A file to write zip entries to where one cannot go back: what was written since the last settle() waits in memory, so a
    header can still be filled in; settle() hands it on."""

    def __init__(self, raw):
        self.raw, self.base, self.waiting = raw, 0, io.BytesIO()

    def write(self, data) -> int:
        return self.waiting.write(data)

    def tell(self) -> int:
        return self.base + self.waiting.tell()

    def seek(self, at: int, whence: int = 0) -> int:
        if whence or at < self.base:
            raise OSError("written already")
        return self.base + self.waiting.seek(at - self.base)

    def flush(self) -> None:
        pass

    def settle(self) -> None:
        made = self.waiting.getvalue()
        self.raw.write(made)
        self.base, self.waiting = self.base + len(made), io.BytesIO()


class Package:
    """K3, K4: an EPUB file, entry by entry, the media type first and stored."""

    def __init__(self, raw, separator: str):
        self.raw, self.out = raw, Settled(raw)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)
        self.zip.writestr(zipfile.ZipInfo("mimetype"), MEDIA_TYPE, zipfile.ZIP_STORED)
        self.out.settle()

    def add(self, name: str | None, data: bytes) -> None:
        if name != "mimetype":
            self.zip.writestr(zipfile.ZipInfo(name or ""), data, zipfile.ZIP_DEFLATED)
            self.out.settle()

    def close(self) -> None:
        self.zip.close()
        self.out.settle()
        self.raw.close()


class Text:
    """K1, K2: a text file of parts, and a line feed at its end."""

    def __init__(self, raw, separator: str):
        self.raw, self.separator, self.begun = raw, separator.encode(), False

    def add(self, name: str | None, data: bytes) -> None:
        self.raw.write(self.separator + data if self.begun else data)
        self.begun = True

    def close(self) -> None:
        self.raw.write(b"\n")
        self.raw.close()


KINDS = {"epub": Package, "txt": Text}


def file_stem(book: str) -> str:
    """What a book's file is called: the last part of its path without its extension; characters that a name can't have give way to a line."""
    stem = re.sub(r"\.(epub|txt)$", "", book.rstrip("/").rsplit("/", 1)[-1], flags=re.I)
    return re.sub(r'[\\/:*?"<>|\x00-\x1f]', "_", stem).strip(". ")[:100] or "book"


def file_names(books: list[str]) -> dict[str, str]:
    """The books' stems; a digest tells those apart that would be one (where a file system knows no case, too)."""
    stems = {b: file_stem(b) for b in books}
    times = Counter(s.lower() for s in stems.values())
    return {b: s if times[s.lower()] == 1 else f"{s}-{hashlib.md5(b.encode()).hexdigest()[:12]}" for b, s in stems.items()}


class BookWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool, names: list[str]):
        self.path, self.overwrite, self.names = options["path"], overwrite, names
        self.kind, self.separator = options.get("kind", "epub"), options.get("separator", "\n\n")
        self.job = uuid.uuid4().hex[:12]

    def write(self, iterator):
        from pyspark import TaskContext

        system, root = filesystem(self.path)
        context, files, now, out = TaskContext.get(), [], None, None
        for b in iterator:
            cols = {n: b.column(i) for i, n in enumerate(self.names)}
            for i in range(b.num_rows):
                book = str(cols["book"][i].as_py())
                if out is None or book != now:
                    if out is not None:
                        out.close()
                    folder = f"{root}/_passing-{self.job}"
                    system.create_dir(folder, recursive=True)
                    files.append((f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}-{len(files):06d}", book))
                    now, out = book, KINDS[self.kind](system.open_output_stream(files[-1][0]), self.separator)
                data = cols["data"][i].as_py() or b""
                out.add(cols["name"][i].as_py() if "name" in cols else None, data.encode() if isinstance(data, str) else data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages):
        from pyarrow import fs

        system, root = filesystem(self.path)
        system.create_dir(root, recursive=True)
        passing = [f for m in messages if m for f in m.files]
        names = file_names([book for _, book in passing])
        made = {f: f"{root}/{names[book]}.{self.kind}" for f, book in passing}
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root)):
                if f.is_file and f.path.endswith(f".{self.kind}") and f.path not in made.values():
                    system.delete_file(f.path)
        for at, own in made.items():
            system.move(at, own)
        self._clear(system, root)

    def abort(self, messages):
        self._clear(*filesystem(self.path))

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/_passing-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_passing-{self.job}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EpubSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_books(rows: DataFrame, path: str, kind: str = "epub", separator: str = "\n\n") -> None:
    """A file per book in folder path, of rows (book, ord, name, data) or, as texts, (book, ord, data); files there of the same kind go.

    A file is one stream, so a book is one task's; its rows pass through one after the other."""
    register(rows.sparkSession)
    kept = ["book", "ord", "name", "data"] if kind == "epub" else ["book", "ord", "data"]
    ordered = rows.select(*kept).repartition("book").sortWithinPartitions("book", *kept[1:-1]).drop("ord")
    ordered.withColumn("book", F.coalesce(F.col("book").cast("string"), F.lit(""))).write.format("epub").mode("overwrite").option("kind", kind).option("separator", separator).save(path)


def read_epubs(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """(path, ord, name, size, data, error) of the packages under path."""
    register(spark)
    return spark.read.format("epub").option("payload", str(payload).lower()).load(path)


def text_of(data) -> F.Column:
    """Bytes as UTF-8, what is none replaced."""
    return F.make_valid_utf8(data.cast("string"))


def spine(entries: DataFrame, book: str = "path") -> tuple[DataFrame, DataFrame]:
    """What packages' own files say of entries (book, ord, name, data): manifest items (book, id, name) and references (book, ord, idref)."""
    from .files import joined_href, opf_path

    named = entries.where("error is null") if "error" in entries.columns else entries
    container = named.where("name = 'META-INF/container.xml'").groupBy(F.col(book).alias("_b")).agg(F.max(text_of(F.col("data"))).alias("container"))
    first = named.where(F.lower("name").endswith(".opf")).groupBy(F.col(book).alias("_b")).agg(F.min_by("name", "ord").alias("first"))
    of_book = named.select(F.col(book).alias("_b")).distinct().join(container, "_b", "left").join(first, "_b", "left")
    of_book = of_book.select("_b", opf_path(F.col("container"), F.array("first")).alias("opf"))
    opf = named.select(F.col(book).alias("_b"), F.col("name").alias("opf"), "data").where(~F.col("opf").rlike("(?i)\\.(xhtml|html|htm|png|jpe?g)$")).join(of_book, ["_b", "opf"])
    opf = opf.select("_b", F.regexp_extract("opf", "^(.*)/[^/]*$", 1).alias("base"), text_of(F.col("data")).alias("text"))
    tags = lambda tag: F.posexplode(F.regexp_extract_all("text", F.lit(f"<{tag}\\b[^>]*>"), F.lit(0))).alias("at", "tag")
    value = lambda name: F.regexp_extract("tag", f'{name}="([^"]+)"', 1)
    items = opf.select("_b", "base", tags("item")).select("_b", "at", value("id").alias("id"), joined_href(F.col("base"), value("href")).alias("name"), value("href").alias("href"))
    items = items.where("id != '' and href != ''").groupBy("_b", "id").agg(F.max_by("name", "at").alias("name"))
    refs = opf.select("_b", tags("itemref")).select("_b", F.col("at").alias("ord"), value("idref").alias("idref")).where("idref != ''")
    return items.select(F.col("_b").alias("book"), "id", "name"), refs.select(F.col("_b").alias("book"), "ord", "idref")


def documents(entries: DataFrame, book: str = "path") -> DataFrame:
    """(book, name, ord, place, data): the documents of packages, with their places in reading order (those that the spine doesn't
    name come last, all with one place, in the order of the package)."""
    from .files import is_document, spine_order

    docs = entries.where(is_document(F.col("name"))).select(F.col(book).alias("book"), "name", "ord", "data")
    return docs.join(spine_order(docs.select("book", "name"), *spine(entries, book)), ["book", "name"])
