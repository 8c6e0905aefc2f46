"""WARC archives with a Zstandard dictionary in a leading skippable frame and one frame per record."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import attach, materialize, new_path

#: Fixed value of the format: the magic number of the skippable frame that holds the dictionary.
DICT_MAGIC = 0x184D2A5D
MIN_SHARED = 100
#: A writer closes an archive at this many bytes of records before compression; this bounds its memory.
ARCHIVE_BYTES = 16 << 20
#: A dictionary is built from records spread over its own archive: this many bytes of them at most.
DICT_BYTES, SAMPLE_BYTES, SAMPLE_RECORD = 16 << 10, 1 << 20, 8 << 10
LEVEL = 3
#: Bytes that a reader hands to the decompressor at a time; what it doesn't use is copied, so not too many.
FEED = 4 << 10
#: Read tasks at most; with more archives a task reads several, one after the other.
MAX_READERS = 20_000
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, records long, raw_bytes long, stored_bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def record_plan(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Rows that become revisits: page_id, digest and refers_to.  Only digests leave the scan; no payload shuffles."""
    digests = pages.select(F.col(id_col).alias("page_id"), F.sha2(_body(html_col), 256).alias("digest"), F.octet_length(_body(html_col)).alias("n")).where(f"n >= {MIN_SHARED}")
    digests = materialize(digests.select("page_id", "digest"), "digests")
    groups = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "refers_to")
    groups = materialize(groups, "groups")
    return attach(digests, groups, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def _body(html_col: str) -> Column:
    return F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")


def header_value(text: str) -> str:
    """No control characters or blanks in a header line; everything else as it is."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(page_id, url: str | None, body: bytes, refers_to) -> bytes:
    digest = hashlib.sha256(body).hexdigest()
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http if revisit else http + body
    name = lambda i: uuid.uuid5(uuid.NAMESPACE_OID, f"page:{i}").urn
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name(page_id)}>", f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response"]
    lines += [f"WARC-Target-URI: {header_value(url)}"] if url is not None else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{name(refers_to)}>", f"X-Refers-To-Page: {refers_to}"]
    lines += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def spread(records: list[bytes]) -> list[bytes]:
    """Records at even distances, whole up to ``SAMPLE_RECORD`` bytes each, ``SAMPLE_BYTES`` in all."""
    cut = [r[:SAMPLE_RECORD] for r in records]
    step = max(1, -(-sum(map(len, cut)) // SAMPLE_BYTES))
    return cut[::step]


def archive(records: list[bytes]) -> bytes:
    samples, known = spread(records), b""
    if len(samples) >= 8:
        try:
            known = zstandard.train_dictionary(DICT_BYTES, samples, k=64, d=8, f=18, steps=1, split_point=1.0).as_bytes()
        except zstandard.ZstdError:  # too little in common: the dictionary is empty, and each record stands alone
            known = b""
    use = zstandard.ZstdCompressionDict(known) if known else None
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=use, write_content_size=True, write_checksum=True)
    return struct.pack("<II", DICT_MAGIC, len(known)) + known + b"".join(map(press.compress, records))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of one archive."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICT_MAGIC:
        raise ValueError("the archive doesn't start with a dictionary frame")
    known, at = data[8 : 8 + size], 8 + size
    inflate = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known) if known else None)
    view = memoryview(data)
    while at < len(data):
        one, got = inflate.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("a frame is cut off")
            got.append(one.decompress(view[at : at + FEED]))
            at = min(len(data), at + FEED)
        at -= len(one.unused_data)
        raw = b"".join(got)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("no WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        if rest[n:] != b"\r\n\r\n" or hashlib.sha256(rest[:n]).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
        yield fields, rest[:n]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row as a record into ``*.warc.zst`` files under ``folder``; returns the written manifest.

    Of rows with equal payloads of at least 100 bytes the one with the smallest page_id is a response and the others
    are revisits; rows that repeat that id and that payload are responses too.  Ids are whole numbers of up to 64 bits, others are
    an error.  A page_id may come with several payloads:
    each is judged by its own digest, so every payload is in some response.  Null html is an empty payload, a null url
    leaves out the target line, a row without an id is a response and never referred to.  Payloads are written whole,
    however long; an empty table gives an empty manifest.  A file's name holds its task attempt, and only files of the
    manifest count, so attempts that were lost leave nothing behind that is read.
    """
    if not isinstance(pages.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} must be a whole number: records are named by it")
    plan = materialize(record_plan(pages, id_col, html_col), "revisits")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    if not plan.isEmpty():
        rows = attach(rows.withColumn("digest", F.sha2(_body("html"), 256)), plan, ("page_id", "digest"), "left").drop("digest")
    else:
        rows = rows.withColumn("refers_to", F.lit(None).cast("long"))
    rows = rows.select("page_id", "url", "html", F.col("refers_to").cast("long").alias("refers_to"))
    manifest = to_arrow_schema(T.StructType.fromDDL(MANIFEST))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, parts = [], 0, 0
        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)

        def flush() -> pa.RecordBatch:
            data = archive(held)
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{parts}.warc.zst"
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": len(held), "raw_bytes": size, "stored_bytes": len(data)}], manifest)

        for b in batches:
            for page_id, url, html, refers in zip(*(b.column(k) for k in range(4)), strict=True):
                one = record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers.as_py())
                held.append(one)
                size += len(one)
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size, parts = [], 0, parts + 1
        if held:
            yield flush()

    return materialize(rows.mapInArrow(write, MANIFEST), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives of ``manifest``, with its digests verified: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url, payload (null for revisits)."""

    schema = to_arrow_schema(T.StructType.fromDDL(RECORDS))

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, inner = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(inner) as f:
                    data = f.read()
                rows, size = [], 0
                for fields, block in parse(data):
                    http, _, body = block.partition(b"\r\n\r\n")
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if not revisit and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                    n = int(http.rpartition(b"Content-Length: ")[2])
                    page = fields.get("X-Page-Id")
                    rows.append((None if page is None else int(page), n, digest, fields["WARC-Type"], int(fields["X-Refers-To-Page"]) if revisit else None, fields.get("WARC-Target-URI"), None if revisit else body))
                    size += len(block)
                    if size > ARCHIVE_BYTES // 4:
                        yield frame(rows)
                        rows, size = [], 0
                if rows:
                    yield frame(rows)

    files = manifest.select("path")
    tasks = max(1, min(MAX_READERS, files.count()))  # a number of its own: the few bytes of paths would else be merged into one task
    return files.repartition(tasks, "path").mapInArrow(read, RECORDS)


def archive_and_read(pages: DataFrame, **names: str) -> DataFrame:
    manifest = write_archives(pages, new_path(pages.sparkSession, "warc"), **names)
    return read_archives(manifest)
