"""Uploads and downloads: what is refused, names, headers, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import VISUAL_EXTENSIONS

#: File types that are taken, and what a refused upload is told.
EXTENSIONS = [*VISUAL_EXTENSIONS, "epub", "txt"]
NO_FILE, EMPTY, NO_KEY, NO_TYPE = "没有收到文件", "文件内容为空", "未配置 API Key", "不支持的文件类型"


def extension(name: Column) -> Column:
    """A file name's last suffix in lower case, with its dot; empty where it has none (a leading dot is none)."""
    return F.lower(F.regexp_extract(F.regexp_extract(name, "([^/]*)$", 1), "^.+(\\.[^.]+)$", 1))


def refusal(name: Column, size: Column, has_key: Column) -> Column:
    """Why an upload (name, bytes, whether a key is known) is refused, the first reason that holds, or null. A null size is no file,
    an empty name one of the default type."""
    ext = extension(F.coalesce(F.nullif(name, F.lit("")), F.lit("upload.pdf")))
    return F.when(size.isNull(), NO_FILE).when(size == 0, EMPTY).when(~has_key, NO_KEY).when(~ext.isin([f".{x}" for x in EXTENSIONS]), NO_TYPE)


def download_name(title: Column) -> Column:
    """a title as a file name: characters that file systems refuse as underscores, "output" for an empty one."""
    return F.coalesce(F.nullif(F.regexp_replace(F.coalesce(title, F.lit("")), r'[\\/:*?"<>|]', "_"), F.lit("")), F.lit("output"))


def content_disposition(name: Column) -> Column:
    """the header for a download, with an ASCII name and the whole one percent-encoded."""
    plain = F.coalesce(F.nullif(F.trim(F.regexp_replace(name, "[^\\x20-\\x7e]", "_")), F.lit("")), F.lit("output"))
    coded = F.url_encode(name)
    for java, asked in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        coded = F.replace(coded, F.lit(java), F.lit(asked))
    return F.concat(F.lit('attachment; filename="'), plain, F.lit("\"; filename*=UTF-8''"), coded)


def job_id() -> Column:
    """16 random hex digits."""
    return F.substring(F.sha1(F.uuid()), 1, 16)
