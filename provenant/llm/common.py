"""What the operators of this package share: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text in one Arrow batch; bounds what a Python worker holds at a time.
TEXT_ROWS_PER_BATCH = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of TEXT_ROWS_PER_BATCH rows, unless the session says otherwise: a batch is held in memory several times over."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS_PER_BATCH))


_held: dict = {}


def free() -> None:
    """Gives back to the system what was freed: a worker lives on, and its executor has a limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only this C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def held(name: tuple, make: Callable[[], object]) -> object:
    """What `make` gives, made once in each Python worker, until another name is asked for: workers live on from one operator to the next."""
    if name not in _held:
        if _held:
            _held.clear()
            free()
        _held[name] = make()
    return _held[name]


def let_go() -> None:
    """Frees what this Python worker holds from an earlier operator; for those that hold nothing of their own."""
    if _held:
        _held.clear()
        free()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A name for a column that no column of `df` has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only where nothing names one (a single machine, as in tests) a temporary folder is set.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: writes `df` as Parquet in the shared folder and reads it back."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes what written() stored for these; nothing that is still to run may read them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Applies `fn` to each Arrow batch, in slices of TEXT_ROWS_PER_BATCH rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXT_ROWS_PER_BATCH):
                yield fn(batch.slice(at, TEXT_ROWS_PER_BATCH))

    return df.mapInArrow(run, schema)


#: Most rows of a few integers that are broadcast; about 40 MB as a hash table.
FEW_ROWS = 1_000_000


def few(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """`df`, to be broadcast if it has at most `rows` rows (of a written table; the bound fits their width); else left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
