"""Files below a folder, and tracked files of a Git tree, as raw documents.

Paths are listed first, hidden ones too, and matched (globs become one regular expression on the relative path);
executors then read the contents of what matches, and of nothing else. Failures of single files are a status,
never an exception, and never a deletion.
"""

from __future__ import annotations

import fnmatch
import hashlib
import io
import os
import re
import subprocess
import zipfile
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.sources.html import extract

# What is read by default, and media types by suffix.
FILE_INCLUDE = ("**/*.md", "**/*.markdown", "**/*.txt", "**/*.pdf", "**/*.epub")
GIT_INCLUDE = ("**/*.md", "**/*.markdown", "**/*.txt", "**/*.yaml", "**/*.yml")
GIT_EXCLUDE = (".git/**", "atlas/**", "learning/**", "compass/**")
MEDIA = {"md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "yaml": "text/yaml", "yml": "text/yaml", "pdf": "application/pdf", "epub": "application/epub+zip"}
FILE_SUFFIXES = ("md", "markdown", "txt", "pdf", "epub")


def glob_regex(pattern: str) -> str:
    """A path glob: ** crosses folders, * and ? do not."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return out


def any_of(path: Column, expressions: list[str]) -> Column:
    return path.rlike("^(?:" + "|".join(expressions) + ")$") if expressions else F.lit(False)


def tracked_match(path: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """A path from its right end part by part, or as a shell pattern whose * crosses folders, also without a leading **/; exclusion also by prefix."""

    def shell(pattern: str) -> str:
        return re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"\1", fnmatch.translate(pattern))

    def from_right(pattern: str) -> str:
        return "(?:.*/)?" + "/".join(re.escape(p).replace(r"\*\*", "[^/]*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]") for p in pattern.split("/"))

    wanted = [f(p) for p in include for f in (from_right, shell, lambda p: shell(p.removeprefix("**/")))]
    unwanted = [f(p) for p in exclude for f in (from_right, shell, lambda p: re.escape(p.removesuffix("/**")) + ".*")]
    return any_of(path, wanted) & ~any_of(path, unwanted)


def _stacked(parts: list[tuple[dict, str]]) -> tuple[str, list[dict]]:
    """The texts that are not blank with a blank line between, and what each one is with the lines it takes (two are counted between)."""
    full = [(what, body) for what, body in parts if body.strip()]
    heights = [body.count("\n") + 1 for _, body in full]
    starts = accumulate((h + 2 for h in heights), initial=1)
    return "\n\n".join(body for _, body in full), [what | {"line_start": a, "line_end": a + h - 1} for (what, _), a, h in zip(full, starts, heights, strict=False)]


def _epub(data: bytes) -> tuple[str, list[dict]]:
    """Chapters of an e-book in reading order, with the lines they take."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in container.iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(book.read(opf))
        items = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if e.tag.endswith("}item") and "html" in e.attrib.get("media-type", "")}
        order = dict.fromkeys([*(e.attrib["idref"] for e in package.iter() if e.tag.endswith("}itemref")), *items])
        names = [items[k] for k in order if k in items]
        within = lambda href: os.path.normpath(os.path.join(os.path.dirname(opf), unquote(href))).replace(os.sep, "/")
        return _stacked([({"chapter": n, "name": href}, extract(book.read(within(href)).decode("utf-8", "replace"))["text"]) for n, href in enumerate(names, 1)])


def _pdf(data: bytes) -> tuple[str, list[dict]]:
    """Pages of a PDF file, with the lines they take."""
    import pymupdf  # optional

    with pymupdf.open(stream=data, filetype="pdf") as document:
        texts = [re.sub("\r\n?", "\n", p.get_text("text")).strip() for p in document]
    return _stacked([({"page": n}, t) for n, t in enumerate(texts, 1)])


_BINARY = "item_id STRING, text STRING, spans STRING, status STRING, parser_version STRING"


def read_books(rows: DataFrame) -> DataFrame:
    """Of rows (item_id, suffix, content) of PDF and EPUB files: text, line spans as JSON, status."""
    import json

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for item, suffix, data in zip(f["item_id"], f["suffix"], f["content"], strict=True):
                try:
                    text, spans = _pdf(bytes(data)) if suffix == "pdf" else _epub(bytes(data))
                    status = "available" if text.strip() else "unreadable"
                    out.append((item, text, json.dumps({"pages" if suffix == "pdf" else "chapters": spans}), status, "pymupdf/1" if suffix == "pdf" else "zip-xhtml/1"))
                except ImportError:
                    out.append((item, None, None, "unsupported", None))
                except Exception:  # a broken book is one unreadable item
                    out.append((item, None, None, "unreadable", None))
            yield pd.DataFrame(out, columns=["item_id", "text", "spans", "status", "parser_version"])

    return rows.select("item_id", "suffix", "content").mapInPandas(run, _BINARY)


def file_system(root: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system of a folder, and its path there. Hadoop's names for object stores are not pyarrow's."""
    uri = re.sub("^s3[an]://", "s3://", root)
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.realpath(uri.removeprefix("file:")))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """item_id (the path below root) of all files that do not leave root through a link; hidden files are files."""
    fs, base = file_system(root)
    base = base.rstrip("/") + "/"
    found = [i.path.removeprefix(base) for i in fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)) if i.type == pafs.FileType.File]
    if isinstance(fs, pafs.LocalFileSystem):
        found = [n for n in found if os.path.realpath(base + n).startswith(base)]
    return spark.createDataFrame([(n,) for n in found], "item_id STRING")


def _read(names: DataFrame, root: str, digest_only: bool = False) -> DataFrame:
    """Rows of names with content, length and sha256 of each file; null ones where it cannot be read. digest_only: without content.

    Rows have to begin with item_id. One file is held at a time, and handed on before the next is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(root)
        for b in batches:
            for i, name in enumerate(b.column(0).to_pylist()):
                try:
                    with fs.open_input_stream(f"{base.rstrip('/')}/{name}", compression=None) as stream:
                        data = stream.read()
                except OSError:
                    data = None
                sha = None if data is None else hashlib.sha256(data).hexdigest()
                more = [pa.array([None if digest_only else data], pa.binary()), pa.array([None if data is None else len(data)], pa.int64()), pa.array([sha], pa.string())]
                yield pa.RecordBatch.from_arrays([c.slice(i, 1) for c in b.columns] + more, [*b.schema.names, "content", "length", "sha256"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names.schema.fields)
    return names.repartition("item_id").mapInArrow(run, f"{schema}, content BINARY, length BIGINT, sha256 STRING")


def _documents(rows: DataFrame, source_id: str, suffixes: tuple[str, ...], parser: str) -> DataFrame:
    """Rows (item_id, content, length, source_revision, extra) as raw documents."""
    suffix = F.lower(F.regexp_extract("item_id", r"\.([^./]+)$", 1))
    rows = rows.withColumn("suffix", suffix)
    book = F.col("suffix").isin("pdf", "epub")
    books = read_books(rows.where(book)).select("item_id", F.col("text").alias("book"), "spans", F.col("status").alias("book_status"), F.col("parser_version").alias("book_parser"))
    valid = F.coalesce(F.is_valid_utf8(F.col("content")), F.lit(False))
    body = F.when(book, F.col("book")).when(valid, F.decode("content", "UTF-8"))
    status = F.when(~F.col("suffix").isin(*suffixes), "unsupported").when(book, F.col("book_status")).when(valid, "available").otherwise("unreadable")
    stem = F.regexp_extract("item_id", r"([^/]+?)(?:\.[^./]*)?$", 1)
    media = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in MEDIA.items() for x in kv)), F.col("suffix")), F.lit("application/octet-stream"))
    joined = rows.join(books, "item_id", "left").withColumn("body", body)
    return joined.select(
        F.lit(source_id).alias("source_id"), "item_id", F.col("item_id").alias("source_uri"), media.alias("media_type"), status.alias("status"),
        F.coalesce(T.markdown_title(F.col("body")), stem).alias("title"), F.col("length").alias("size_bytes"), "source_revision", F.when(status == "available", F.col("body")).alias("text"),
        F.coalesce("book_parser", F.lit(parser)).alias("parser_version"), F.current_timestamp().alias("fetched_at"), F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("string").alias("language"),
        F.coalesce("spans", "extra").alias("metadata_json"),
    )


def read_files(spark: SparkSession, source_id: str, root: str, include=FILE_INCLUDE, exclude=(), known: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Raw documents of the files below root that match; the revision is the content's SHA-256.

    With known, files are digested first and only those that differ are read; with a limit, the first paths only.
    """
    names = list_files(spark, root)
    names = names.where(any_of(F.col("item_id"), [glob_regex(p) for p in include]) & ~any_of(F.col("item_id"), [glob_regex(p) for p in exclude]))
    if known is not None:
        names = _chosen(_read(names, root, digest_only=True).select("item_id", F.col("sha256").alias("source_revision")), known, limit).select("item_id")
    else:
        names = _chosen(names, None, limit)
    rows = _read(names, root).withColumnRenamed("sha256", "source_revision").withColumn("extra", F.to_json(F.struct(F.col("item_id").alias("relative_path"))))
    return _documents(rows, source_id, FILE_SUFFIXES, "text-passthrough/1")


def _chosen(names: DataFrame, known: DataFrame | None, limit: int | None) -> DataFrame:
    """Those that are not as known (item_id, source_revision), and of them the first by path."""
    if known is not None:
        names = names.join(known.select("item_id", "source_revision"), ["item_id", "source_revision"], "left_anti")
    return names if limit is None else names.orderBy("item_id").limit(limit)


def git(root: str, *command: str) -> bytes:
    return subprocess.run(["git", "-C", root, *command], check=True, capture_output=True, timeout=30).stdout


def read_git(spark: SparkSession, source_id: str, root: str, include=GIT_INCLUDE, exclude=GIT_EXCLUDE, known: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Raw documents of the tracked files of a working tree that match; the revision is the commit."""
    commit = git(root, "rev-parse", "HEAD").decode().strip()
    fs, base = file_system(root)
    listed = [n.decode("utf-8", "surrogateescape") for n in git(root, "ls-files", "-z").split(b"\0") if n]
    below = [n for n in listed if n.isprintable() and os.path.isfile(f"{base}/{n}") and os.path.realpath(f"{base}/{n}").startswith(f"{base}/")]
    names = spark.createDataFrame([(n,) for n in below], "item_id STRING").where(tracked_match(F.col("item_id"), tuple(include), tuple(exclude)))
    names = names.where(~F.col("item_id").rlike(r"(^/|(^|/)\.\.(/|$))")).withColumn("source_revision", F.lit(commit))
    rows = _read(_chosen(names, known, limit).select("item_id", "source_revision"), root)
    rows = rows.withColumn("extra", F.to_json(F.struct(F.lit(commit).alias("commit"), F.col("item_id").alias("relative_path"))))
    return _documents(rows, source_id, tuple(MEDIA), "git-text/1")
