"""Inventories of files: names, kinds, digests, encodings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.functions.scalars import basename, extension, file_kind
from provenant.sources.messages import BINARY


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """file_id, path (relative to `root`), name, ext, size, mtime, kind of every file below `root`; contents are not read."""
    files = spark.read.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().getPath().rstrip("/") + "/"
    plain = F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?/*", "/")
    relative = F.when(plain.startswith(base), F.substring(plain, len(base) + 1, 2**31 - 1)).otherwise(plain)
    return files.select(F.sha2(F.to_json(F.array(F.lit(root), relative)), 256).alias("file_id"), relative.alias("path"), basename(F.col("path")).alias("name"), extension(F.col("path")).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), file_kind(F.col("path")).alias("kind"))


def content_digest(spark: SparkSession, root: str, max_bytes: int) -> DataFrame:
    """path, sha256, hash_status: whole files or unknown, never part of one. Files over the limit are listed without being read."""
    files = spark.read.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").load(root)  # listed once for both
    small = files.filter(F.col("length") <= max_bytes).select("path", F.sha2("content", 256).alias("sha256"), F.lit("complete").alias("hash_status"))
    large = files.filter(F.col("length") > max_bytes).select("path", F.lit(None).cast("string").alias("sha256"), F.lit("unknown_over_limit").alias("hash_status"))
    return small.unionByName(large)


def _stream_digests(path: str, chunk: int) -> tuple[int | None, str | None, list[str] | None, str | None]:
    """Bytes, SHA-256, SHA-256 of each chunk, what went wrong: a file is read once, a chunk at a time."""
    at = re.sub(r"^file:/*(?=/)", "", path)
    try:
        system, name = FileSystem.from_uri(at)
        whole, parts, size = hashlib.sha256(), [], 0
        with system.open_input_stream(name, buffer_size=None) as stream:
            while block := stream.read(chunk):
                while len(block) < chunk and (more := stream.read(chunk - len(block))):
                    block += more
                whole.update(block)
                parts.append(hashlib.sha256(block).hexdigest())
                size += len(block)
        return size, whole.hexdigest(), parts, None
    except FileNotFoundError:
        return None, None, None, "missing"
    except (OSError, pa.ArrowException) as e:
        return None, None, None, f"unreadable: {type(e).__name__}"


def stream_digests(paths: DataFrame, path: str = "path", chunk: int = 1 << 20) -> DataFrame:
    """All columns of `paths` with size, digest, chunks (of each chunk), failure: of files of any size, 2 GB and more as well, as no row ever holds a file's content.

    A task opens each of its files where the path says (local, hdfs or an object store that pyarrow knows) and holds one chunk of it. A row is a file: a null path fails as `missing`, paths that repeat are read for each row.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema.fields), "size bigint, digest string, chunks array<string>, failure string"])
    at = paths.columns.index(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                name = row.column(at)[0].as_py()
                size, digest, chunks, failure = _stream_digests(name, chunk) if name else (None, None, None, "missing")
                found = [pa.array([size], pa.int64()), pa.array([digest], pa.string()), pa.array([chunks], pa.list_(pa.string())), pa.array([failure], pa.string())]
                yield pa.RecordBatch.from_arrays([*row.columns, *found], names=[*row.schema.names, "size", "digest", "chunks", "failure"])

    # files are dealt out by name: a list of paths is small and would be one task's
    return paths.repartition(F.xxhash64(path)).mapInArrow(run, schema)


def write_files(rows: DataFrame, path: str = "path", content: str = "content") -> int:
    """Writes a file for each row, with its folders; how many. Tasks write where the path says (as stream_digests() reads), under the last name: nothing is moved afterwards, and a task that runs again writes the same files over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                system, at = FileSystem.from_uri(re.sub(r"^file:/*(?=/)", "", name.as_py()))
                system.create_dir(at.rpartition("/")[0], recursive=True)
                with system.open_output_stream(at) as out:
                    out.write(data.as_buffer())
            yield pa.record_batch({"n": [batch.num_rows]})

    return rows.select(path, content).repartition(F.xxhash64(path)).mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def detect_encoding(content: Column) -> Column:
    """utf-16-le/be by byte order mark, utf-8-sig, utf-8 if valid, else unknown."""
    start = F.hex(F.substring(content, 1, 4))
    return F.when(start.startswith("FFFE"), "utf-16-le").when(start.startswith("FEFF"), "utf-16-be").when(start.startswith("EFBBBF"), "utf-8-sig").when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("unknown")
