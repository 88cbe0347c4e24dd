"""WARC archives: writing whole-file gzip streams, and normalising them to a member for each record.

`write_archives` packs rows into WARC files that are one gzip stream each, as crawlers without record
compression leave them. `normalise` inflates such a stream once, in pieces, rewrites every record as
a gzip member of its own, and writes a sidecar index of offsets beside it, so that readers can seek.
Executors write to the shared folder with pyarrow's file systems; a file is written under a temporary
name and then moved, so a task that is repeated after a loss leaves whole files only.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import scratch, shuffle_partitions, small, written

#: Inflated bytes after which a new archive begins.
ARCHIVE_BYTES = 64 << 20
#: Payloads of fewer bytes are never stored as revisits.
LEAST_REVISIT = 1000
LEVEL = 4
PIECE = 1 << 20
CRLF = b"\r\n"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Hadoop's names for object stores are not pyarrow's."""
    uri = re.sub("^s3[an]://", "s3://", uri)
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:/") else "file://" + uri[5:])


class Placed:
    """A file that appears under its name when it is complete."""

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temp, compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.path)


#: The date of all records: the tables have none.
DATE = "2026-01-01T00:00:00Z"


def record(kind: str, uri: str, fields: dict[str, str], block: bytes, place: str = "") -> bytes:
    """One WARC/1.1 record; its id follows from the address, the fields and its place (archive and number), so rows that repeat have ids of their own."""
    rid = uuid.uuid5(uuid.NAMESPACE_URL, f"{kind} {uri} {sorted(fields.items())} {place}")
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{rid}>", "WARC-Date": DATE, "WARC-Target-URI": uri, **fields, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + CRLF + block + CRLF + CRLF


def page_record(page_id: int | None, uri: str, payload: bytes, sha1: str, refers_to: int | None, refers_to_uri: str = "", place: str = "") -> bytes:
    """A response with an HTTP block, or a revisit, which names the response's address and date, and whose block has the HTTP header alone."""
    fields = {"Page-Id": "" if page_id is None else str(page_id), "WARC-Payload-Digest": f"sha1:{sha1}", "Content-Type": "application/http;msgtype=response"}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return record("response", uri, fields, http + payload, place)
    fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Target-URI": refers_to_uri, "WARC-Refers-To-Date": DATE, "Refers-To-Page": str(refers_to)}
    return record("revisit", uri, fields, http, place)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(CRLF + CRLF)
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("a WARC record is cut short")
    return fields, rest[:size]


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, without the two line ends after each, from pieces of an inflated archive; at most one record and one piece are held."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                while held[:2] == CRLF:
                    del held[:2]
                end = held.find(CRLF + CRLF)
                if end < 0:
                    break
                size = next(int(x.partition(b":")[2]) for x in bytes(held[:end]).split(CRLF) if x.lower().startswith(b"content-length:"))
                need = end + 4 + size
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("an archive ends inside a record")


def inflate(stream, chunk: int = PIECE) -> Iterator[bytes]:
    """Pieces of a gzip file's content, whatever the number of its members; ValueError if it ends inside one, its trailer included."""
    z, inside = zlib.decompressobj(31), False
    while data := stream.read(chunk):
        while data := data if inside else data.lstrip(b"\0"):  # members may be padded
            out, inside = z.decompress(data, chunk), True
            if out:
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z, inside = z.unused_data, zlib.decompressobj(31), False
    if inside:
        raise ValueError("a gzip member is cut short")


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write rows (page_id, url, payload, sha1, refers_to, refers_to_uri) as archives of one gzip stream; returns their paths.

    Lazy: the files are written when the result is, and a repeated task writes files of the same names.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, out, z, held = TaskContext.get().partitionId(), 0, None, None, 0
        for b in batches:
            paths = []
            for row in (dict(zip(b.schema.names, x, strict=True)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if out is None:
                    path = f"{folder}/part-{part:06d}-{n:05d}.warc.gz"
                    out, z, held, n, k = Placed(path), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, n + 1, 0
                data = page_record(row["page_id"], row["url"] or "", row["payload"], row["sha1"], row["refers_to"], row["refers_to_uri"] or "", f"{path.rpartition('/')[2]} {k}")
                out.write(z.compress(data))
                held, k = held + len(data), k + 1
                if held >= ARCHIVE_BYTES:
                    out.write(z.flush())
                    out.close()
                    paths.append(path)
                    out = None
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.string())], ["path"])

    return pages.select("page_id", "url", "payload", "sha1", "refers_to", "refers_to_uri").mapInArrow(write, "path string")


def normalise_file(source: str, target: str) -> int:
    """Rewrite one archive with a gzip member for each record, and its index at target + '.idx'; the number of records."""
    fs, path = file_system(source)
    out, index, at, n = Placed(target), Placed(f"{target}.idx"), 0, 0
    with fs.open_input_stream(path, compression=None) as stream:
        for data in split_records(inflate(stream)):
            fields, _ = parse_record(data)
            packed = member(data + CRLF + CRLF)
            out.write(packed)
            index.write(json.dumps({"offset": at, "length": len(packed), "type": fields["warc-type"], "uri": fields["warc-target-uri"], "id": fields["warc-record-id"]}).encode() + b"\n")
            at, n = at + len(packed), n + 1
    out.close()
    index.close()
    return n


def normalise(archives: DataFrame, keep_source: bool = True) -> DataFrame:
    """Normalise the archives at `path`; returns path (of the new file), and its number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                target = path.removesuffix(".warc.gz") + ".records.warc.gz"
                fs, there = file_system(target)
                if fs.get_file_info(f"{there}.idx").type == pafs.FileType.File and not keep_source and fs.get_file_info(file_system(path)[1]).type == pafs.FileType.NotFound:
                    with fs.open_input_stream(f"{there}.idx", compression=None) as stream:  # an earlier attempt has done it
                        n = stream.read().count(b"\n")
                else:
                    n = normalise_file(path, target)
                    if not keep_source:
                        fs.delete_file(file_system(path)[1])
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n], pa.int64())], ["path", "n_records"])

    return archives.select("path").mapInArrow(run, "path string, n_records long")


def read_records(archives: DataFrame) -> DataFrame:
    """Records of normalised archives, by their indexes: path, offset, page_id, record_type, payload_digest, stored_digest, payload_bytes, refers_to.

    payload_digest is recomputed from the payload where the record holds it; a revisit's is the recorded one.
    """
    schema = "path string, offset long, page_id long, record_type string, payload_bytes long, payload_digest string, recorded_digest string, refers_to long"
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, there = file_system(path)
                with fs.open_input_file(there) as data, fs.open_input_stream(f"{there}.idx", compression=None) as index:
                    rows, rest = [], b""
                    while piece := index.read(PIECE):
                        *lines, rest = (rest + piece).split(b"\n")
                        for x in map(json.loads, lines):
                            data.seek(x["offset"])
                            rows.append((path, x["offset"], *_page(zlib.decompress(data.read(x["length"]), 31))))
                            if len(rows) >= 1000:
                                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                                rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archives.select("path").mapInArrow(read, schema)


def _page(data: bytes) -> tuple:
    fields, block = parse_record(data)
    http, _, payload = block.partition(CRLF + CRLF)
    recorded = fields["warc-payload-digest"].partition(":")[2]
    if fields["warc-type"] == "revisit":
        size = next(int(x.partition(b":")[2]) for x in http.split(CRLF) if x.lower().startswith(b"content-length:"))
        digest = recorded
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return int(fields["page-id"]) if fields["page-id"] else None, fields["warc-type"], size, digest, recorded, int(fields["refers-to-page"]) if "refers-to-page" in fields else None


def page_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Write pages as WARC archives, normalise them and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, archive, offset.

    Of pages with equal payloads of at least `least` bytes, that with the largest id is a response and the
    others revisit it; smaller ones are all responses. Null html is an empty payload, null url an empty
    address. Rows that repeat the largest id are all responses. A null id reads back as null, and is never
    what others refer to unless all copies have none; then all are responses. An empty table gives no rows.
    Other columns are not read.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumns({"sha1": F.sha1("payload"), "sha256": F.sha2("payload", 256)})
    large = F.octet_length("payload") >= least
    copies = written(source.where(large).groupBy("sha256").agg(F.max(F.struct("page_id", F.coalesce("url", F.lit("")).alias("url"))).alias("first"), F.count("*").alias("n")).where("n > 1").select("sha256", "first"), "copies")
    again = F.col("first.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    rows = source.join(small(copies), "sha256", "left").withColumns({"refers_to": F.when(again, F.col("first.page_id")), "refers_to_uri": F.when(again, F.col("first.url"))})  # a small payload equals no large one
    folder = scratch(spark, "warc")
    archives = written(write_archives(rows, folder), "archives")
    records = written(normalise(archives, keep_source=False), "normalised")
    return read_records(records.repartition(shuffle_partitions(spark))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("path").alias("archive"), "offset")
