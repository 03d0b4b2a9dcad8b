"""WARC archives with a Zstandard dictionary each.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds its dictionary, itself compressed; each record after it is
a frame of its own, compressed with that dictionary, so that any record can be read alone. The dictionary is trained on
the archive's own records (an even sample of at most SAMPLE_BYTES). A task writes archives of at most
ARCHIVE_BYTES of records, so memory doesn't grow with the table; a file gets its name when it is whole. Names hold the task's attempt, and the table of
files that write() returns has those of the attempts that counted: readers go by it, so what a lost or doubled attempt leaves behind is never read, and a file that should be there and isn't is an error.

Of records with equal payloads, the one with the least id is a response, the others revisit it.
Null payloads count as empty. Of rows that share id and payload, each is a record; those rows are
responses if their id is the least, and they share a record id, which names the page. A null id is written as an empty id and is never the one that others revisit, unless all ids are null, when
all of them are responses. An empty table gives an archive folder without files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.llm.common import few, new_path, written

MAGIC_DICTIONARY = 0x184D2A5D
ARCHIVE_BYTES = 16 << 20
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 6
_SCHEMA = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
_FILES = "file string, records bigint, bytes bigint"
#: Most payloads with repeats that are broadcast, about 100 bytes each.
MOST_REPEATED = 200_000


def dedupe(pages: DataFrame, key: str = "page_id", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """`pages` with record_type and refers_to. The least id of each payload is found on digests alone, and only payloads that several rows have are met with
    the rows: a small table of them is broadcast, so that payloads don't move; a large one meets them in a join, which adaptive execution splits where a payload is hot."""
    body = F.coalesce(F.col(payload), F.lit(""))
    digest = F.unhex(F.sha2(body, 256))
    least = pages.select(digest.alias("_digest"), F.col(key).cast("long").alias("id")).groupBy("_digest").agg(F.min("id").alias("first"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    least = few(written(least, "repeated-payloads"), MOST_REPEATED)
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    named = pages.select(F.col(key).cast("long").alias("page_id"), url.alias("url"), body.alias("payload"), digest.alias("digest"))
    revisit = (F.octet_length("payload") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return (
        named.join(least, F.col("digest") == F.col("_digest"), "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .select("page_id", "url", "record_type", F.when(revisit, F.col("first")).alias("refers_to"), "payload")
    )


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, payload: bytes) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head, with the length of the payload, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = "" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {''.join((url or '').splitlines())}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{_digest(payload)}", f"WARC-Block-Digest: sha1:{_digest(block)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP head and payload of one record; the block digest is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if f"sha1:{_digest(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} does not match")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from an even sample; raw content of the sample where it is too small to train on; none without records."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    sample = [r[: 128 << 10] for r in records[::step]]
    if not sample:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 50)), sample)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    out, trained = io.BytesIO(), train(records)
    if trained is not None:
        frame = zstandard.ZstdCompressor(level=19).compress(trained.as_bytes())
        out.write(struct.pack("<II", MAGIC_DICTIONARY, len(frame)) + frame)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained) if trained is not None else zstandard.ZstdCompressor(level=LEVEL)
    for r in records:
        out.write(press.compress(r))
    return out.getvalue()


def records(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == MAGIC_DICTIONARY:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
        trained = raw[:4] == b"\x37\xa4\x30\xec"  # a trained dictionary's magic number; else raw content
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
        at = 8 + size
    expand = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary is not None else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        one = expand.decompressobj()
        yield one.decompress(view[at:])
        at = len(data) - len(one.unused_data)


def _save(folder: str, name: str, data: bytes) -> None:
    """Under a passing name first, then its own: no reader meets half a file. `folder` names its file system."""
    if folder.startswith("file:"):
        root = folder.removeprefix("file://").removeprefix("file:")
        os.makedirs(root, exist_ok=True)
        passing = f"{root}/_{uuid.uuid4().hex}"
        with open(passing, "wb") as f:
            f.write(data)
        os.replace(passing, f"{root}/{name}")
        return
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))
    store.create_dir(root, recursive=True)
    passing = f"{root}/_{uuid.uuid4().hex}"
    with store.open_output_stream(passing) as f:
        f.write(data)
    store.move(passing, f"{root}/{name}")


def _whole_path(spark: SparkSession, folder: str) -> str:
    """`folder` with its file system, so that tasks take it as the driver does: a folder without one is the default file system's, not each machine's own."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def write(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of dedupe() as archives below `folder`; returns file, records, bytes of each, written as a table of its own (`folder`/_files)."""
    folder = _whole_path(rows.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, held, size, count = TaskContext.get(), [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, count
            name, data = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{count:05d}.warc.zst", archive(held)
            _save(folder, name, data)
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([len(data)], pa.int64())], names=["file", "records", "bytes"])
            held, size, count = [], 0, count + 1
            return out

        for b in batches:
            for page_id, url, kind, refers, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(record(page_id, url, kind, refers, body.encode()))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
        if held:
            yield close()

    files = rows.select("page_id", "url", "record_type", "refers_to", "payload").mapInArrow(run, _FILES)
    files.write.mode("append").parquet(f"{folder}/_files")
    return rows.sparkSession.read.schema(_FILES).parquet(f"{folder}/_files")


def read(spark, folder: str, *, with_payload: bool = False) -> DataFrame:
    """One row for each record of the archives that write() has listed for `folder`. Bounded archives make bounded rows of whole files; the driver holds their names, as it does for any files."""
    folder = _whole_path(spark, folder)
    listed = [f"{folder}/{r.file}" for r in spark.read.schema(_FILES).parquet(f"{folder}/_files").select("file").toLocalIterator()]
    if not listed:
        found = spark.createDataFrame([], _SCHEMA)
        return found if with_payload else found.drop("payload")
    files = spark.read.schema(T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])).format("binaryFile").load(listed).select("content")
    names = [x.split(" ")[0] for x in _SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                out: list[tuple] = []
                for raw in records(data.as_py()):
                    fields, http, payload = parse(raw)
                    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None  # noqa: B023, E731
                    length = int(http.split(b"Content-Length: ")[1].split(b"\r\n")[0])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and (len(payload) != length or _digest(payload) != digest):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                    out.append((number("WARC-Record-ID"), fields["WARC-Target-URI"], kind, number("WARC-Refers-To"), length, digest, payload if with_payload else None))
                    if len(out) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    found = files.mapInArrow(run, _SCHEMA)
    return found if with_payload else found.drop("payload")


def round_trip(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """Archives `pages` in the shared folder and reads them back."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    write(dedupe(pages, key, payload), folder)
    return read(spark, folder)
