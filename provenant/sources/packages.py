"""Snapshots of tables in and out: packages, archives, manifests, citation packets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenant.operators.integrity import FLAGS, payload_digest, table_digests


def write_events_csv(events: DataFrame, path: str) -> None:
    """All columns with a header, in order of time: a sort by ranges, a file for each."""
    events.orderBy("ts_start", "id").write.option("header", True).csv(path)


def write_scan_manifest(parts: dict[str, DataFrame], path: str, coverage: DataFrame) -> None:
    """Each part as a table, and `coverage` (one row, as scan_coverage() gives it) beside them."""
    if "coverage" in parts:
        raise ValueError("coverage is a part of its own")
    for name, df in {**parts, "coverage": coverage}.items():
        df.write.parquet(f"{path}/{name}")


#: The core tables of a package and their columns.
SCHEMAS = {
    "cases": "id bigint, name string, created_at string",
    "sources": "id bigint, case_id bigint, kind string, label string, locator string, account string, imported_at string, metadata_json string",
    "artifacts": "id bigint, source_id bigint, parent_artifact_id bigint, sha256 string, original_name string, mime_type string, size_bytes bigint, source_locator string, source_created_at string, source_modified_at string, captured_at string, stored_path string, is_raw bigint, confidence double, metadata_json string, created_at string",
    "source_observations": "id bigint, artifact_id bigint, source_id bigint, source_locator string, observed_at string, acquisition_kind string, original_name string, mime_type string, size_bytes bigint, sha256 string, source_created_at string, source_modified_at string, metadata_json string",
    "events": "id bigint, artifact_id bigint, source_id bigint, event_type string, ts_start string, ts_end string, direction string, sender string, recipients string, contact_label string, phone_or_address string, subject string, body string, external_id string, thread_id string, confidence double, metadata_json string, created_at string",
    "processing_runs": "id bigint, job_id bigint, artifact_id bigint, lease_token string, status string, started_at string, finished_at string, tool string, tool_version string, provider string, model string, model_version string, parameters_json string, provenance_json string, metadata_json string, error string",
    "derived_text": "id bigint, artifact_id bigint, kind string, model string, language string, text string, segments_json string, confidence double, created_at string, run_id bigint",
    "annotations": "id bigint, artifact_id bigint, event_id bigint, derived_text_id bigint, kind string, label string, body string, start_ms bigint, end_ms bigint, created_at string, updated_at string",
    "evidence_anchors": "id bigint, artifact_id bigint, derived_text_id bigint, start_ms bigint, end_ms bigint, quote_text string, quote_sha256 string, selector_json string, created_at string",
    "tags": "id bigint, name string",
    "artifact_tags": "artifact_id bigint, tag_id bigint",
    "event_tags": "event_id bigint, tag_id bigint",
    "links": "id bigint, left_kind string, left_id bigint, right_kind string, right_id bigint, relation string, confidence double, rationale string, created_at string",
    "jobs": "id bigint, kind string, artifact_id bigint, status string, priority bigint, attempts bigint, payload_json string, error string, created_at string, started_at string, finished_at string",
    "audit_log": "id bigint, ts string, actor string, action string, object_kind string, object_id bigint, details_json string",
    "schema_migrations": "version bigint, name string, applied_at string",
}


def export_package(tables: dict[str, DataFrame], keys: dict[str, str], path: str, core: list[str] = tuple(SCHEMAS), schema: str = "v1") -> DataFrame:
    """Writes each table in order of its key, the digests, and an envelope: schema, what a package can't do, and the digest over all. Returns what is in the package, missing tables included."""
    for name, df in tables.items():
        df.orderBy(keys[name]).write.parquet(f"{path}/tables/{name}")
    digests = table_digests(tables, keys)
    digests.write.parquet(f"{path}/digests")
    spark = digests.sparkSession
    missing = F.array(*(F.lit(c) for c in core if c not in tables)).cast("array<string>")
    flags = spark.range(1).select(F.lit(schema).alias("schema"), *(F.lit(v).alias(k) for k, v in FLAGS.items()), missing.alias("missing_tables"))
    flags.crossJoin(payload_digest(spark.read.parquet(f"{path}/digests"), flags)).write.parquet(f"{path}/envelope")  # one row each
    return spark.createDataFrame([(c, c in tables) for c in core], "name string, present boolean")


def read_package(spark: SparkSession, path: str, schemas: dict[str, str] = SCHEMAS) -> dict[str, DataFrame]:
    """Tables of packages that are each one JSON document with an object of arrays; `path` may hold several. Tables that a package lacks have no rows."""
    fields = ", ".join(f"{n}:array<struct<{', '.join(':'.join(f.rsplit(' ', 1)) for f in s.split(', '))}>>" for n, s in schemas.items())
    whole = spark.read.schema(f"schema string, tables struct<{fields}>").option("multiLine", True).json(path)
    return {n: whole.select(F.explode(f"tables.{n}").alias("x")).select("x.*") for n in schemas}


def _numbered(df: DataFrame, key: str, width: int = 100_000) -> DataFrame:
    """ordinal, row_json in order of `key`: counted within ranges of the key, then over the ranges, so no task numbers a whole table."""
    part = F.floor(F.col(key) / width)
    counts = df.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    body = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    rows = df.select(part.alias("_part"), F.row_number().over(Window.partitionBy(part).orderBy(key)).alias("_in"), body.alias("row_json"))
    return rows.join(before, "_part").select((F.col("_in") + F.col("_before") - 1).alias("ordinal"), "row_json")


def archive_rows(tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """table_name, ordinal, row_json: every row as text, numbered within its table in order of key."""
    parts = [_numbered(df, keys[n]).select(F.lit(n).alias("table_name"), "ordinal", "row_json") for n, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, parts)


def write_archive(tables: dict[str, DataFrame], keys: dict[str, str], path: str, schema: str = "v1") -> None:
    """All rows as text below `path`/rows, a folder a table, and `path`/envelope: one row with the schema, the tables, their digests and the digest over all."""
    for name, df in sorted(tables.items()):
        _numbered(df, keys[name]).write.parquet(f"{path}/rows/table_name={name}")
    digests = table_digests(tables, keys)
    flags = digests.sparkSession.range(1).select(F.lit(schema).alias("schema"), *(F.lit(v).alias(k) for k, v in FLAGS.items()))
    tables_said = digests.agg(F.array_sort(F.collect_list(F.struct("table", "rows", "digest"))).alias("tables"))  # a row a table
    flags.crossJoin(tables_said).crossJoin(payload_digest(digests, flags)).write.parquet(f"{path}/envelope")  # one row each


def read_archive(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    rows = spark.read.parquet(f"{path}/rows")
    return {name: rows.filter(F.col("table_name") == name).select(F.from_json("row_json", schema).alias("x")).select("x.*") for name, schema in schemas.items()}


def verify_archive(spark: SparkSession, path: str, schemas: dict[str, str], keys: dict[str, str]) -> DataFrame:
    """table, rows, exact: whether the rows that are read back have the digest that the envelope states; and a row for the payload as a whole."""
    envelope = spark.read.parquet(f"{path}/envelope")
    found = table_digests(read_archive(spark, path, schemas), keys)
    said = envelope.select(F.explode("tables").alias("t")).select("t.table", F.col("t.digest").alias("said"))
    each = said.join(found, "table", "left").select("table", F.coalesce("rows", F.lit(0)).alias("rows"), F.col("digest").eqNullSafe(F.col("said")).alias("exact"))
    whole = envelope.select("payload_sha256").crossJoin(payload_digest(found, envelope.select("schema", *FLAGS)).toDF("found"))  # one row each
    return each.unionByName(whole.select(F.lit("*").alias("table"), F.lit(None).cast("bigint").alias("rows"), F.col("found").eqNullSafe(F.col("payload_sha256")).alias("exact")))


#: Parts of a citation packet, in the order in which they are written.
PARTS = ("artifact", "version", "source", "run", "observations", "anchor", "scope", "unknowns")


def packet_json(packets: DataFrame) -> Column:
    return F.to_json(F.struct(*(c for c in PARTS if c in packets.columns)))


def write_citation_packets(packets: DataFrame, path: str) -> None:
    """One JSON document a line: the payload as text and its digest. Packets with errors aren't written."""
    payload = packets.filter(F.size("errors") == 0).select("anchor_id", packet_json(packets).alias("payload_json"))
    payload.select(F.to_json(F.struct(F.col("anchor_id").alias("packet_id"), "payload_json", F.sha2("payload_json", 256).alias("payload_sha256"))).alias("value")).write.text(path)


def read_citation_packets(spark: SparkSession, path: str) -> DataFrame:
    """packet_id, payload_json, payload_sha256, as inspect_packets() takes them."""
    return spark.read.schema("packet_id bigint, payload_json string, payload_sha256 string").json(path)
