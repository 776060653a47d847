"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Records are WARC/1.1 ``response`` and ``revisit`` records.  A response's
block is an HTTP response whose body is the payload with ``Content-Encoding:
deflate``, so archives can be walked by their headers and ``Content-Length``
without inflating a payload nobody asked for.  A revisit has no body; its
header names the record it repeats and the digest and size of the payload.

Reading plans whole files into partitions of about ``split_bytes``, takes
predicates on the header columns, parses a record's header first, and skips
its block if a predicate fails or payloads are not wanted
(``option("payload", "false")``).
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
                                    StringStartsWith, WriterCommitMessage)

from .common import new_scratch

SCHEMA = ("record_id string, record_type string, target_uri string, date string, refers_to string, "
          "payload_digest string, payload_bytes long, payload binary")
#: Header field of each column; the size of the payload is an extension field.
FIELDS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI",
          "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest",
          "payload_bytes": "WARC-Payload-Length"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Encoding: deflate\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 64 << 20
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 4 << 20


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a URI or a plain local path."""
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _clean(value) -> bytes:
    return re.sub(r"[\r\n]+", " ", str(value)).encode()


def record_bytes(row: dict) -> bytes:
    """One record; null header values are left out."""
    head = [b"WARC/1.1"]
    head += [f"{field}: ".encode() + _clean(row[c]) for c, field in FIELDS.items() if row[c] is not None]
    if row["record_type"] == "revisit":
        head.append(b"WARC-Profile: " + REVISIT_PROFILE.encode())
        block = b""
    else:
        block = HTTP_HEAD + zlib.compress(row["payload"] or b"", 1)
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


# ---------------------------------------------------------------- writing

class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Tasks write to a hidden folder; only files of committed tasks are moved into place."""

    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes, self.job = path, file_bytes, uuid.uuid4().hex

    def _pending(self, base: str) -> str:
        return posixpath.join(base, f"_pending-{self.job}")

    def write(self, iterator):
        files, base = open_fs(self.path)
        folder = self._pending(base)
        files.create_dir(folder, recursive=True)
        names, out = [], None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc")
                    out = files.open_output_stream(posixpath.join(folder, names[-1]))
                out.write(record_bytes(row))
                if out.tell() >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages):
        files, base = open_fs(self.path)
        files.create_dir(base, recursive=True)
        for m in messages:
            for name in m.names if m else ():
                files.move(posixpath.join(self._pending(base), name), posixpath.join(base, name))
        self._drop(files, base)

    def abort(self, messages):
        self._drop(*open_fs(self.path))

    def _drop(self, files, base):
        if files.get_file_info(self._pending(base)).type == fs.FileType.Directory:
            files.delete_dir(self._pending(base))


# ---------------------------------------------------------------- reading

class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


_TESTS = {
    EqualTo: lambda v, f: v == f.value,
    In: lambda v, f: v in f.value,
    GreaterThan: lambda v, f: v > f.value,
    GreaterThanOrEqual: lambda v, f: v >= f.value,
    LessThan: lambda v, f: v < f.value,
    LessThanOrEqual: lambda v, f: v <= f.value,
    StringStartsWith: lambda v, f: v.startswith(f.value),
    IsNotNull: lambda v, f: True,
}


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, split_bytes: int):
        self.path, self.payload, self.split_bytes, self.filters = path, payload, split_bytes, []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and f.attribute[0] in FIELDS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        files, base = open_fs(self.path)
        found = [x for x in files.get_file_info(fs.FileSelector(base, allow_not_found=True))
                 if x.is_file and x.base_name.endswith(".warc")]
        groups, size = [], self.split_bytes
        for x in sorted(found, key=lambda x: x.path):
            if size + x.size > self.split_bytes:
                groups.append([])
                size = 0
            groups[-1].append(x.path)
            size += x.size
        return [Files(g) for g in groups]

    def _wanted(self, row: dict) -> bool:
        return all(row[f.attribute[0]] is not None and _TESTS[type(f)](row[f.attribute[0]], f) for f in self.filters)

    def read(self, partition):
        if partition is None or not getattr(partition, "paths", None):
            return
        files, _ = open_fs(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with files.open_input_file(path) as raw:
                for row in records(raw, self._wanted, self.payload):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 200
                    if size >= BATCH_BYTES:
                        yield as_batch(rows)
                        rows, size = [], 0
        if rows:
            yield as_batch(rows)


READ_AHEAD = 1 << 20


def records(raw, wanted, payload: bool):
    """Header fields of each record of an open file that ``wanted`` accepts, with its payload if asked for."""
    buffer, at, place = b"", 0, 0  # ``buffer[at:]`` is what follows, ``place`` where the buffer ends in the file

    def more(n):
        nonlocal buffer, at, place
        got = raw.read(max(n, READ_AHEAD))
        buffer, at, place = buffer[at:] + got, 0, place + len(got)
        return len(got)

    while True:
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more(0):
                if buffer[at:].strip():
                    raise ValueError("the archive ends inside a record's header")
                return
        lines = buffer[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts here: {lines[0][:40]!r}")
        head = dict(x.split(b": ", 1) for x in lines[1:])
        head = {k.decode().lower(): v.decode() for k, v in head.items()}
        at = end + 4
        size = int(head["content-length"]) + 4  # the block and two line ends
        row = {c: head.get(f.lower()) for c, f in FIELDS.items()}
        row["payload_bytes"] = None if row["payload_bytes"] is None else int(row["payload_bytes"])
        row["payload"] = None
        keep = wanted(row)
        if keep and payload and row["record_type"] != "revisit":
            while len(buffer) - at < size:
                if not more(size - (len(buffer) - at)):
                    raise ValueError("the archive ends inside a record's block")
            block = buffer[at:at + size - 4]
            body = block.find(b"\r\n\r\n") + 4
            row["payload"] = zlib.decompress(block[body:])
        if len(buffer) - at >= size:
            at += size
        else:  # the rest of the block is passed over, not read
            place += size - (len(buffer) - at)
            raw.seek(place)
            buffer, at = b"", 0
        if keep:
            yield row


def as_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    names = [*FIELDS, "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names)


class WarcDataSource(DataSource):
    """Options: ``path``; reading: ``payload`` (true), ``split_bytes``; writing: ``file_bytes``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true",
                          int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_archive(spark: SparkSession, path: str, payload: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of all archives in a folder; filter on header columns to skip blocks."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("split_bytes", split_bytes).load(path)


# ---------------------------------------------------------------- operator

def page_records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
                 min_bytes: int = 1000) -> DataFrame:
    """One record per row, with revisits for repeated payloads of at least ``min_bytes``.

    Of rows with equal payloads (equal SHA-1 and size) the largest id is the
    response and the others revisit it; smaller payloads are always
    responses.  A null payload is empty.  Rows that share the largest id are
    all responses; where all ids of a payload are null, all are.  Other
    columns are not read; an empty table gives an empty one.
    """
    own = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("target_uri"),
                       F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("text")) \
        .select("*", F.sha1("text").alias("payload_digest"), F.octet_length("text").cast("long").alias("payload_bytes"))
    # only repeated payloads are joined back; the page side may be split where a payload is very common
    repeated = own.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes") \
        .agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n").hint("shuffle_hash")
    joined = own.join(repeated, ["payload_digest", "payload_bytes"], "left")
    revisit = F.coalesce(F.col("first") != F.coalesce(F.col("id"), F.col("first") - 1), F.lit(False))
    urn = "urn:x-record:"
    return joined.select(
        F.concat(F.lit(f"<{urn}"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(">")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri", F.lit(DATE).alias("date"),
        F.when(revisit, F.concat(F.lit(f"<{urn}"), F.col("first").cast("string"), F.lit(">"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), F.col("payload_digest")).alias("payload_digest"), "payload_bytes",
        F.when(~revisit, F.encode("text", "UTF-8")).alias("payload"))


def write_archive(records_df: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    register(records_df.sparkSession)
    records_df.write.format("warc").option("file_bytes", file_bytes).mode("append").save(path)


def round_trip(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
               min_bytes: int = 1000) -> DataFrame:
    """Write all pages to archives in the shared folder and read every record back.

    The digest and size of a response are those of the payload read back; of
    a revisit, which has none, those its header states.
    """
    spark = pages.sparkSession
    path = new_scratch(spark, "warc")
    write_archive(page_records(pages, id_col, uri_col, payload_col, min_bytes), path)
    # each kind by its own scan: the predicate is pushed down, and the scan of revisits inflates no payload
    back = read_archive(spark, path).where("record_type = 'response'") \
        .union(read_archive(spark, path, payload=False).where("record_type = 'revisit'"))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, ':([^:>]*)>$', 1) as bigint)")
    here = F.col("payload").isNotNull()
    return back.select(number("record_id").alias(id_col),
                       F.when(here, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
                       F.when(here, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
                       "record_type", number("refers_to").alias("refers_to"))
