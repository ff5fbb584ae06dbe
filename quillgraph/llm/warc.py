"""WARC archives: writing, normalising of monolithic gzip files, reading by a sidecar index.

Some tools compress a whole WARC file as one gzip stream, which can only be read from its start. The normaliser inflates such a stream once, in
bounded memory, rewrites every record as a gzip member of its own and writes a sidecar index (one JSON line a record: offset, length, id, type,
target, digest), so any record can be read alone. Files of several members, with records in or across them, are read as well.

Files are written under a temporary name and renamed when whole; a task that runs again writes the same bytes and puts them in the place of what an earlier attempt left, also on stores that refuse to rename over a file.
Repeated rows are records of their own; very long payloads are held by one task each; extra columns, whatever their names, are ignored.
Archives are opened through ``pyarrow.fs`` by URI, so the shared folder may be local, HDFS or an object store that it knows.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, tasks_of, tidy, work_dir

LEAST_REVISIT = 1000
READ_BYTES = 1 << 20
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
INDEX = "offset long, length long, record_id string, record_type string, target string, digest string"


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri[5:]
    return pa.fs.FileSystem.from_uri(uri)


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members; READ_BYTES at most at a time."""
    stream, begun = zlib.decompressobj(31), False
    for data in chunks:
        while data:
            begun = True
            out = stream.decompress(data, READ_BYTES)
            if out:
                yield out
            if stream.eof:
                data, stream, begun = stream.unused_data, zlib.decompressobj(31), False
                data = data.lstrip(b"\0") if not data.strip(b"\0") else data
            else:
                data = stream.unconsumed_tail
    if begun and (not stream.eof):
        raise EOFError("the gzip stream ends early")


def records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields by lower-case name, head, block) of each WARC record of a byte stream."""
    buffer, over = bytearray(), False

    def fill() -> bool:
        nonlocal over
        part = next(stream, None)
        over = part is None
        buffer.extend(part or b"")
        return not over

    while True:
        start = 0
        while True:  # blank lines between records
            while start < len(buffer) and buffer[start] in b"\r\n":
                start += 1
            if start < len(buffer) or not fill():
                break
        del buffer[:start]
        if not buffer:
            return
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not fill():
                raise ValueError("a WARC record's head ends early")
        head = bytes(buffer[: end + 4])
        if not head.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {head[:40]!r}")
        fields = {}
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if colon:
                fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        while len(buffer) < end + 4 + size:
            if not fill():
                raise ValueError("a WARC record's block ends early")
        yield fields, head, bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size]


def member(data: bytes, level: int = 4) -> bytes:
    """``data`` as one gzip member without name or time: equal bytes for equal data."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + deflate.compress(data) + deflate.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _replace(fs: pa.fs.FileSystem, source: str, target: str) -> None:
    """Renames a file; one that stands there already, of an earlier attempt, goes first."""
    if fs.get_file_info(target).type != pa.fs.FileType.NotFound:
        try:
            fs.delete_file(target)
        except FileNotFoundError:
            pass  # another attempt was faster
    fs.move(source, target)


def normalise(source: str, target: str, index: str) -> int:
    """Rewrites the archive ``source`` record by record to ``target`` and ``index`` (all URIs); the number of records."""
    fs, path = opened(source)
    out_fs, out_path = opened(target)
    index_path = opened(index)[1]
    for p in (out_path, index_path):
        out_fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    mark, n, offset = f".{uuid.uuid4().hex}.tmp", 0, 0
    with fs.open_input_stream(path, compression=None) as f, out_fs.open_output_stream(out_path + mark, compression=None) as out, out_fs.open_output_stream(index_path + mark, compression=None) as idx:
        for fields, head, block in records(inflated(iter(lambda: f.read(READ_BYTES), b""))):
            data = member(head + block + b"\r\n\r\n")
            out.write(data)
            line = {"offset": offset, "length": len(data), "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")}
            idx.write((json.dumps(line) + "\n").encode())
            offset += len(data)
            n += 1
    _replace(out_fs, out_path + mark, out_path)
    _replace(out_fs, index_path + mark, index_path)
    return n


def normalise_folder(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Normalises every ``*.gz`` of a folder, a file a task at a time; written (archive, index, n_records) rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(source).select("path")

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path in b.column(0).to_pylist():
                name = re.sub(r"(\.txt|\.warc)?\.gz$", "", path.rsplit("/", 1)[1])
                out, idx = f"{target}/archives/{name}.warc.gz", f"{target}/index/{name}.jsonl"
                n = normalise(path, out, idx)
                yield pa.RecordBatch.from_arrays([pa.array([out]), pa.array([idx]), pa.array([n], pa.int64())], ["archive", "index", "n_records"])

    n = max(1, files.count())
    return staged(files.repartition(n, "path").mapInArrow(run, "archive string, index string, n_records long"), "normalised")


def read_records(spark: SparkSession, folder: str, run, schema: str) -> DataFrame:
    """``run(fields, block) -> tuple`` of each record of the normalised archives of ``folder``, read through their indexes."""
    index = spark.read.schema(INDEX).json(f"{folder}/index").select(F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), "/index/([^/]*)$", "/archives/$1"), r"\.jsonl$", ".warc.gz").alias("archive"), "offset", "length")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    @tidy
    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f = None, None
        for b in it:
            out = []
            for archive, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if archive != now:
                    if f:
                        f.close()
                    fs, path = opened(archive)
                    now, f = archive, fs.open_input_file(path)
                data = f.read_at(length, offset)
                fields, _, block = next(records(inflated(iter([data]))))
                out.append(run(fields, block))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], pa.schema([(n, pa.string() if "string" in x else pa.int64()) for n, x in zip(names, schema.split(","), strict=True)]))
        if f:
            f.close()

    return index.mapInArrow(read, schema)


def _sha1_base32(hex_digest):
    """WARC's form of a digest, from its hex form: five bytes are eight letters."""
    bits = F.conv  # five hex digits are 20 bits, so two of them are one group of 40
    groups = []
    for k in range(4):
        value = bits(F.substring(hex_digest, 10 * k + 1, 10), 16, 10).cast("long")
        groups += [F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), (F.shiftright(value, 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for j in range(8)]
    return F.concat(*groups)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> None:
    """Writes a record for each row of ``pages``, as whole-file gzip streams.

    Of rows with equal payloads of at least ``least`` bytes, that with the largest id is a response and the others revisit it.
    Payloads are grouped by their SHA-1, and only digests are joined: the payload of a response goes from the scan to its
    record past one exchange by id. Null html is an empty payload; rows with the largest id of their group are all responses, as are
    groups without any id; a null id is written as ``null``.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    digest, size = F.sha1(F.encode("html", "UTF-8")), F.octet_length("html").cast("long")
    each = staged(base.select("id", "url", digest.alias("digest"), size.alias("size")), "digests")
    largest = each.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
    largest = staged(largest.where("n > 1 and first is not null").select("digest", "size", "first"), "largest")
    revisits = staged(each.join(largest, ["digest", "size"]).where("not (id <=> first)").select("id", "url", "digest", "size", "first"), "revisits")
    mine = revisits.select(F.col("id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    responses = base.withColumn("digest", digest).withColumn("size", size)
    responses = responses.join(mine, F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left_anti")

    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    target = F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"\s", ""), F.lit("\r\n"))).otherwise(F.lit(""))

    def record(kind: str, block, extra):
        head = F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), name(F.col("id")), F.lit(f"\r\nWARC-Date: {DATE}\r\n"), target, F.lit("WARC-Payload-Digest: sha1:"), _sha1_base32(F.col("digest")), F.lit("\r\nX-Payload-Length: "), F.col("size").cast("string"), F.lit("\r\n"), extra, F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
        return F.concat(head, block).alias("value")

    whole = responses.select(record("response", F.concat(F.lit(HTTP_HEAD), F.col("html")), F.lit("")))
    refers = F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))
    again = revisits.select(record("revisit", F.lit(HTTP_HEAD), refers))
    whole.unionAll(again).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 50_000).text(folder)


def page_records(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the normalised archives' records; a response's from its payload, a revisit's from its head."""

    def run(fields: dict[str, str], block: bytes) -> tuple:
        import hashlib

        number = lambda x: None if x is None or ":null>" in x else int(x.rpartition(":")[2].rstrip(">"))
        kind = fields["warc-type"]
        stated = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
            if digest != stated:
                raise ValueError(f"record {fields['warc-record-id']} is damaged")
        else:
            size, digest = int(fields["x-payload-length"]), stated
        return number(fields["warc-record-id"]), size, digest, kind, number(fields.get("warc-refers-to"))

    return read_records(spark, folder, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived_pages(pages: DataFrame, **kw) -> DataFrame:
    """Writes ``pages`` as monolithic archives, normalises them and reads the records back."""
    spark = pages.sparkSession
    folder = work_dir(spark, "warc")
    write_archives(pages, f"{folder}/monolithic", **kw)
    normalise_folder(spark, f"{folder}/monolithic", f"{folder}/normal")
    return page_records(spark, f"{folder}/normal")
