"""Where queries keep what they write: folders that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from provenant.operators import index

_temporary: dict[str, str] = {}


def shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A temporary one stands in for it on a single machine, as in tests, and nowhere else."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or _temporary.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))).rstrip("/")


def folder(spark: SparkSession, what: str = "round-trip") -> str:
    return f"{shared(spark)}/{what}-{uuid.uuid4().hex}"


def _signature(docs: DataFrame) -> str:
    """Names, sizes and times of the files that a table is read from, as a digest."""
    spark, found = docs.sparkSession, []
    for name in sorted(docs.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        found.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(found).encode()).hexdigest()[:32]


def stored_index(docs: DataFrame, columns: tuple[str, ...]) -> index.Index:
    """The index of a table of texts in the shared folder, built when it is first asked for and opened from then on, as long as the files of the table are the same."""
    spark = docs.sparkSession
    path = f"{shared(spark)}/index-{'-'.join(columns)}-{_signature(docs)}"
    manifest = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if manifest.getFileSystem(spark._jsc.hadoopConfiguration()).exists(manifest):
        return index.open_index(spark, path)
    return index.create_index(docs, path, columns=columns)
