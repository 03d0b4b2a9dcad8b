"""Incremental import of exports: each file once, each event once, conflicts shown."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from provenant.operators.joins import upsert_events
from provenant.sources.messages import parse_sms_files

#: Buckets of the events table. An export's events are in one bucket, so a batch looks up only the buckets of its exports.
BUCKETS = 64
#: Parts that a batch's rows of a bucket are dealt into by their export: so many tasks write a bucket, a file each.
SLICES = 4
PAYLOAD = ["event_type", "ts_start", "ts_end", "direction", "contact_label", "phone_or_address", "body"]


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, events_path: str) -> DataFrame:
    """batch, buckets: what is committed, a row a batch."""
    path, fs = _path(spark, f"{events_path}/_commits")
    schema = "batch string, buckets array<int>"
    return spark.read.schema(schema).json(f"{events_path}/_commits") if fs.exists(path) else spark.createDataFrame([], schema)


def _commit(spark: SparkSession, events_path: str, batch: str, buckets: list[int]) -> None:
    """From here on the batch's events and conflicts count. The file is created, never overwritten."""
    path, fs = _path(spark, f"{events_path}/_commits/{batch}.json")
    out = fs.create(path, False)
    out.write(bytearray(json.dumps({"batch": batch, "buckets": buckets}).encode()))
    out.close()


def imported(spark: SparkSession, events_path: str, schema: str | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The committed events, of some buckets only if asked for: other folders are not opened. None if nothing is there."""
    wanted = commits(spark, events_path).select("batch", F.explode("buckets").alias("bucket"))
    wanted = wanted if buckets is None else wanted.filter(F.col("bucket").isin(buckets))
    folders = [f"{events_path}/batch={r.batch}/bucket={r.bucket}" for r in wanted.collect()]  # a row a batch and bucket that are asked for
    if not folders:
        return None
    read = spark.read.option("basePath", events_path)
    return (read.schema(schema) if schema else read).parquet(*folders)


def conflicts(spark: SparkSession, events_path: str, conflicts_path: str) -> DataFrame:
    """The committed conflicts, with their batch."""
    return spark.read.option("basePath", conflicts_path).parquet(f"{conflicts_path}/batch=*").withColumn("batch", F.col("batch").cast("string")).join(commits(spark, events_path).select("batch"), "batch", "left_semi")


def stream_ingest(spark: SparkSession, inbox: str, events_path: str, conflicts_path: str, checkpoint: str, glob: str = "*.xml") -> StreamingQuery:
    """Imports what arrives in `inbox` into the table at `events_path`; what is there already is left, what differs goes to `conflicts_path`.

    A batch writes a folder in each table and then one commit for both. A batch that failed between runs again and writes its folders over; one that was committed is passed over. Batches of other streams into the
    same tables have other names.
    """
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).schema("path string, modificationTime timestamp, length bigint, content binary").load(inbox)
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def each(arrived: DataFrame, number: int) -> None:
        batch = f"{stream}-{number}"
        if commits(spark, events_path).filter(F.col("batch") == batch).limit(1).count():
            return
        # elements of no known type have no id of their own: they are issues of the export, not events
        new = parse_sms_files(arrived).filter("external_id is not null").withColumn("artifact_id", F.xxhash64("file")).withColumn("source_id", F.xxhash64("file")).drop("issues")
        new = new.withColumn("bucket", F.pmod("artifact_id", F.lit(BUCKETS)).cast("int")).withColumn("slice", F.pmod(F.xxhash64("artifact_id"), F.lit(SLICES)).cast("int"))
        # of one key within the batch the first row leads; the others meet it as they meet what is known: equal, or in conflict. Rows are dealt once, for the window and for the tasks that write
        own = Window.partitionBy("bucket", "slice", "artifact_id", "source_id", "event_type", "external_id").orderBy("file", "row", F.xxhash64(*PAYLOAD))
        new = new.repartition("bucket", "slice").withColumn("place", F.row_number().over(own)).persist()
        try:
            first, later = new.filter("place = 1").drop("place"), new.filter("place > 1").drop("place", "slice")
            seen = new.groupBy("bucket").agg(F.max("place").alias("places")).collect()  # at most BUCKETS rows
            found = imported(spark, events_path, buckets=sorted(r.bucket for r in seen))
            known = first.drop("slice").limit(0).withColumn("id", F.lit(None).cast("bigint")) if found is None else found.drop("batch")
            met = upsert_events(first, known, PAYLOAD)
            added = met.filter("outcome = 'inserted'").drop("outcome", "known_id").withColumn("id", F.xxhash64("artifact_id", "external_id"))
            added.repartition("bucket", "slice").drop("slice").write.mode("overwrite").partitionBy("bucket").parquet(f"{events_path}/batch={batch}")
            added = added.drop("slice")
            added = spark.read.schema(added.schema).parquet(f"{events_path}/batch={batch}").select(*added.columns)
            odd = met.drop("slice").filter("outcome = 'conflict'")
            if repeated := [r.bucket for r in seen if r.places > 1]:  # what was written is read again for buckets that hold a key twice, not for others
                of = F.col("bucket").isin(repeated)
                odd = odd.unionByName(upsert_events(later, known.select(*added.columns).filter(of).unionByName(added.filter(of)), PAYLOAD).filter("outcome = 'conflict'"))
            odd.write.mode("overwrite").parquet(f"{conflicts_path}/batch={batch}")
            written = [r.bucket for r in added.select("bucket").distinct().collect()]
            _commit(spark, events_path, batch, sorted(written))
        finally:
            new.unpersist()

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
