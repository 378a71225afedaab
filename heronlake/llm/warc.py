"""WARC records in ZIP-packaged archives, read without extraction.

Writing: each task writes archives of about ``ARCHIVE_BYTES``: a ZIP whose members are
*stored*, ``archive/data.warc.gz`` (one gzip member per record) and ``indexes/index.cdxj``
(one line per record: page, offset, length).  A file gets its final name only when whole,
so a task that is tried again replaces its archive.

Reading: the end-of-central-directory record, the ZIP64 locator and record where sizes or
offsets overflow, then the central directory with its ZIP64 extra fields give each stored
member's place; the local header gives its first byte.  Index lines then give the byte
ranges of records, which are read and inflated one run at a time.

Of pages with equal payloads (of ``min_bytes`` or more), that of the largest page id is a
*response* record and the others are *revisit* records that refer to it.  Null html is the
empty payload; a null page id is smaller than any other; rows that repeat both id and
payload are all responses; a group of null ids only is all responses.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.llm.common import chunks, few, mapped, new_path, store

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVE_BYTES, RUN = 64 << 20, 500
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it for a URI."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, path: str) -> str:
    """*path* with the scheme and host of Spark's default file system, if it names none."""
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return path
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


# records ---------------------------------------------------------------
def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def name_of(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page: int | None, url: str, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": name_of(page), "WARC-Date": DATE,
        "WARC-Target-URI": quote(url, safe="%/:=&?~#+!$,;'@()*[]"), "WARC-Payload-Digest": f"sha1:{sha1}",
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": name_of(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and body of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if len(block) < int(fields["content-length"]):
        raise ValueError("WARC record is cut short")
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}, body


# ZIP directories -------------------------------------------------------
class ZipDirectory:
    """Places of the members of a ZIP file, by range reads only.  *read* (offset, length) returns bytes."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        tail_at = max(0, size - 65_557)
        tail = read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06", 0, len(tail) - 18)
        while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of central directory: not a ZIP file")
        count, length, at = struct.unpack_from("<HII", tail, end + 10)
        if 0xFFFF == count or 0xFFFFFFFF in (length, at):
            locator = read(tail_at + end - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("ZIP64 locator is missing")
            record64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record64[:4] != b"PK\x06\x06":
                raise ValueError("ZIP64 end of central directory is missing")
            count, length, at = struct.unpack_from("<QQQ", record64, 32)
        directory, self.members, i = read(at, length), {}, 0
        for _ in range(count):
            if directory[i : i + 4] != b"PK\x01\x02":
                raise ValueError("central directory is damaged")
            method, packed, full, n_name, n_extra, n_comment, header = (*struct.unpack_from("<H", directory, i + 10), *struct.unpack_from("<II", directory, i + 20), *struct.unpack_from("<HHH", directory, i + 28), *struct.unpack_from("<I", directory, i + 42))
            name = directory[i + 46 : i + 46 + n_name].decode("utf-8")
            extra = directory[i + 46 + n_name : i + 46 + n_name + n_extra]
            packed, header = self._wide(extra, full, packed, header)
            self.members[name] = (header, packed, method)
            i += 46 + n_name + n_extra + n_comment

    @staticmethod
    def _wide(extra: bytes, full: int, packed: int, header: int) -> tuple[int, int]:
        """Packed size and header offset, from the ZIP64 extra field where 32 bits don't hold them."""
        k = 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                if full == 0xFFFFFFFF:
                    next(values)
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            k += 4 + n
        return packed, header

    def place(self, name: str) -> tuple[int, int]:
        """First byte and length of a stored member."""
        header, packed, method = self.members[name]
        if method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} is compressed; only stored members can be read in ranges")
        local = self.read(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"local header of {name} is damaged")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return header + 30 + n_name + n_extra, packed


# Spark -----------------------------------------------------------------
def revisits(pages: DataFrame, key: str = "page_id", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """``sha1`` (binary), ``first``: the largest page id of each payload that several pages have."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    ids = pages.select(F.col(key).alias("id"), F.unhex(F.sha1(body)).alias("sha1"), F.length(body).alias("n")).where(F.col("n") >= min_bytes)
    return ids.groupBy("sha1").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write *pages* as archives under *path*; the manifest: ``archive``, ``first``, ``count``, one row per run of RUN records.

    *path* belongs to Spark's default file system unless it names another.  The *key* is a
    whole number (it is cast to long: what isn't a number is null); an empty table gives no archive.
    """
    path = qualified(pages.sparkSession, path)
    known = store(revisits(pages, key, html, min_bytes), "payloads")
    source = pages.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    source = source.withColumn("sha1", F.unhex(F.sha1(F.col("html").cast("binary")))).join(few(known), "sha1", "left").select("id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        fs.create_dir(folder, recursive=True)
        rows = (row for part, texts in chunks(batches, "html") for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, part.column(3).to_pylist(), strict=True))
        number, row = 0, next(rows, None)
        while row is not None:
            final = f"part-{TaskContext.get().partitionId():05d}-{number:05d}.wacz"
            draft = f"{folder}/.{final}.{uuid.uuid4().hex}"
            index: list[str] = []
            with fs.open_output_stream(draft) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                with z.open(DATA, "w", force_zip64=True) as member:
                    at = 0
                    while row is not None and at < ARCHIVE_BYTES:
                        page, target, text, first = row
                        payload = text.encode()
                        sha1 = digest(payload)
                        revisit = first is not None and first != page
                        press = zlib.compressobj(6, wbits=31)
                        data = press.compress(record(page, target, payload, sha1, first if revisit else None, revisit)) + press.flush()
                        member.write(data)
                        index.append(f"{'' if page is None else page} {DATE} " + json.dumps({"offset": at, "length": len(data), "digest": f"sha1:{sha1}"}))
                        at += len(data)
                        row = next(rows, None)
                z.writestr(INDEX, "\n".join(index))
            with contextlib.suppress(OSError):
                fs.delete_file(f"{folder}/{final}")
            fs.move(draft, f"{folder}/{final}")
            firsts = list(range(0, len(index), RUN))
            yield pa.RecordBatch.from_pydict({"archive": [f"{path}/{final}"] * len(firsts), "first": pa.array(firsts, pa.int64()), "count": pa.array([min(RUN, len(index) - i) for i in firsts], pa.int64())})
            number += 1

    return store(mapped(source, run, "archive string, first long, count long"), "manifest")


READ = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])


def records(archive: str, first: int, count: int) -> Iterator[tuple]:
    """Records *first* to *first* + *count* of an archive, in READ's order."""
    fs, path = filesystem(archive)
    with fs.open_input_file(path) as f:
        f_read = lambda at, n: f.read_at(n, at)
        directory = ZipDirectory(f_read, f.size())
        data_at, _ = directory.place(DATA)
        lines = f_read(*directory.place(INDEX)).decode().split("\n")[first : first + count]
        for place in (json.loads(x.split(" ", 2)[2]) for x in lines):
            data = zlib.decompress(f_read(data_at + place["offset"], place["length"]), wbits=31)
            fields, http, body = parse(data)
            sha1 = fields["warc-payload-digest"].removeprefix("sha1:")
            revisit = fields["warc-type"] == "revisit"
            if not revisit and digest(body) != sha1:
                raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
            yield (page_of(fields["warc-record-id"]), int(http["content-length"]), sha1, fields["warc-type"], page_of(fields["warc-refers-to"]) if revisit else None, fields["warc-target-uri"], None if revisit else body, archive, place["offset"], place["length"])


def read(manifest: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Records of the archives in *manifest* (``archive``, ``first``, ``count``): READ's *columns*, payload included unless left out."""
    names = columns or READ.names
    schema = T.StructType([READ[n] for n in names])
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary(), "offset": pa.int64(), "length": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held: list[tuple] = []
                for found in records(row["archive"], row["first"], row["count"]):
                    held.append(found)
                    if len(held) >= 64:
                        yield _batch(held, names, types)
                        held = []
                if held:
                    yield _batch(held, names, types)

    # a row stands for RUN records, so tasks are counted by rows: sizes in bytes would put all rows in one task
    runs = manifest.count()
    tasks = max(1, min(runs, max(4 * manifest.sparkSession.sparkContext.defaultParallelism, runs // 64)))
    return mapped(manifest.select("archive", "first", "count").repartition(tasks), run, schema)


def _batch(rows: list[tuple], names: list[str], types: dict) -> pa.RecordBatch:
    columns = dict(zip(READ.names, zip(*rows, strict=True), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[n], types.get(n, pa.string())) for n in names], names)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write *pages* into new archives in the shared folder and read them back, without payloads."""
    manifest = write(pages, new_path(pages.sparkSession, "archives"))
    return read(manifest, [n for n in READ.names if n != "payload"])
