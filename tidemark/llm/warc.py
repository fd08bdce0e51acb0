"""WARC archives of web pages: writing with revisit records, and a sequential reader.

Archives hold one gzip member per record. The reader decompresses a stream piece by piece, frames
each record by its Content-Length, and verifies block and payload digests; it holds one record at
a time. Archives are plain files in a folder that all executors share.

Of pages with equal payloads of ``MIN_REVISIT`` bytes or more, the one with the largest id is a
response, the others are revisits without a payload.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch

#: Payload bytes from which equal payloads are revisits, and bytes after which an archive is closed.
MIN_REVISIT, ARCHIVE_BYTES = 1000, 256 << 20
#: Revisits up to which their ids are broadcast; more are joined by a shuffle of the payloads.
FEW_REVISITS = 1_000_000
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _file_system(path: str):
    """The file system of a qualified path, and the path within it."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    return fs.FileSystem.from_uri(f"file://{'/' + rest.lstrip('/')}" if scheme == "file" else path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark takes it by: without one, that of the default file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, name: str, url: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header, with the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    head += [f"WARC-Payload-Digest: {_digest(payload)}", f"WARC-Block-Digest: {_digest(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return _member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _info() -> bytes:
    body = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return _member(head.encode() + body + b"\r\n\r\n")


def read_records(stream, piece: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a gzip-member stream, in order.

    Raises ValueError for a broken member, a wrong frame or a truncated archive.
    """
    rest = b""
    while True:
        rest = rest or stream.read(piece)
        if not rest:
            return
        z, plain = zlib.decompressobj(31), bytearray()
        headers, body_at, length = None, 0, 0
        while not z.eof:
            if not rest:
                rest = stream.read(piece)
                if not rest:
                    raise ValueError("archive ends inside a member")
            try:
                plain += z.decompress(rest)
            except zlib.error as e:
                raise ValueError(f"broken member: {e}") from e
            rest = z.unused_data
            if headers is None and (end := plain.find(b"\r\n\r\n")) >= 0:
                lines = bytes(plain[:end]).decode("utf-8").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError("no WARC version line")
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                body_at, length = end + 4, int(headers["content-length"])
        if headers is None or len(plain) != body_at + length + 4 or plain[-4:] != b"\r\n\r\n":
            raise ValueError("content length doesn't frame the record")
        yield headers, bytes(plain[body_at : body_at + length])


def _write(folder: str, limit: int):
    def run(batches):
        fs, root = _file_system(folder)
        job = uuid.uuid4().hex  # another attempt of the task writes other files; only the returned names count
        part, number, out, target, done = TaskContext.get().partitionId(), 0, None, None, []
        size = count = 0

        def close():
            out.close()
            fs.move(f"{target}.open", target)
            done.append((f"{folder}/{target.rpartition('/')[2]}", count, size))

        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "html", "payload_sha1", "record_type", "refers_to")]
            for k in range(batch.num_rows):
                page, url, html, _, kind, refers = (c[k].as_py() for c in cols)
                if out is None:
                    fs.create_dir(root, recursive=True)
                    target = f"{root}/part-{part:05d}-{number:03d}-{job}.warc.gz"
                    out, size, count, number = fs.open_output_stream(f"{target}.open"), 0, 0, number + 1
                    out.write(info := _info())
                    size += len(info)
                data = record(kind, f"urn:page:{'null' if page is None else page}", url, html.encode(), None if refers is None else f"urn:page:{refers}")
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= limit:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _, _ in done], pa.string()), pa.array([c for _, c, _ in done], pa.int64()), pa.array([s for _, _, s in done], pa.int64())], ["path", "records", "bytes"])

    return run


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """The pages with ``payload_sha1``, ``record_type`` and ``refers_to``.

    Only ids and digests meet by digest: a hot payload is reduced to its largest id before the
    shuffle, and the answer comes back by id and digest. Null html is an empty payload. Rows
    without an id are responses and never referred to. Rows with equal id and payload get the same type.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    keyed = src.withColumn("payload_sha1", F.sha1(F.col("html").cast("binary")))
    large = keyed.where((F.octet_length("html") >= min_revisit) & F.col("page_id").isNotNull()).select("page_id", "payload_sha1")
    first = large.groupBy("payload_sha1").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_low")).where("refers_to <> _low").drop("_low")
    again = large.join(first, "payload_sha1").where("page_id <> refers_to").distinct()
    again = again.withColumnRenamed("payload_sha1", "_sha1").withColumnRenamed("page_id", "_page")
    again = Scratch(pages.sparkSession, "warc-plan").save(again, "revisits")
    if again.count() <= FEW_REVISITS:  # then the payloads stay where they are read
        again = F.broadcast(again)
    both = keyed.join(again, (F.col("page_id") == F.col("_page")) & (F.col("payload_sha1") == F.col("_sha1")), "left")
    return both.select("page_id", "url", "html", "payload_sha1", F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit")).alias("record_type"), "refers_to")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, **names) -> DataFrame:
    """Writes the pages to archives in ``folder`` (shared by all executors) and returns (path, records, bytes)."""
    scratch = Scratch(pages.sparkSession, "warc-list")
    folder = qualified(pages.sparkSession, folder)
    rows = plan_records(pages, **names)
    return scratch.save(rows.mapInArrow(_write(folder, archive_bytes), "path string, records long, bytes long"), "paths")


_READ = pa.schema([("path", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("valid", pa.bool_())])


def read_archives(paths: DataFrame, payload: bool = True) -> DataFrame:
    """One row per page record of the archives named in ``path``.

    ``payload_digest`` is bare lower-case hex, ``valid`` says that block and payload digests hold
    (a revisit's payload can't be checked). ``payload=False`` leaves the payload null. Null paths
    are skipped; an archive named twice is read twice; a broken archive fails the job.
    """

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, inner = _file_system(path)
                rows, size = [], 0
                with fs.open_input_stream(inner, compression=None) as f:
                    for head, block in read_records(io.BufferedReader(f)):
                        if head.get("warc-type") not in ("response", "revisit"):
                            continue
                        http, _, body = block.partition(b"\r\n\r\n")
                        length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(body))
                        stored = head.get("warc-payload-digest", "")
                        ok = head.get("warc-block-digest") == _digest(block)
                        if head["warc-type"] == "response":
                            ok = ok and stored == _digest(body) and length == len(body)
                        name = lambda x: None if x is None else x.strip("<>")
                        rows.append((path, name(head.get("warc-record-id")), head.get("warc-target-uri"), head["warc-type"], name(head.get("warc-refers-to")), length, base64.b32decode(stored.partition(":")[2]).hex(), body if payload and head["warc-type"] == "response" else None, ok))
                        size += len(block)
                        if size > 8 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ.types, strict=True)], schema=_READ)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ.types, strict=True)], schema=_READ)

    ddl = "path string, record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary, valid boolean"
    return paths.where("path is not null").select("path").repartitionByRange(max(1, paths.count()), "path").mapInArrow(run, ddl)
