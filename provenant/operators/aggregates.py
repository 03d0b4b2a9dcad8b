"""Counts, coverage and collisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dashboard_counts(artifacts: DataFrame, events: DataFrame, derived: DataFrame, annotations: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row; each table is summed by itself."""
    parts = [
        artifacts.agg(F.count("*").alias("artifacts")), events.agg(F.count("*").alias("events")),
        derived.agg(F.count_if(F.col("kind") == "transcript").alias("transcripts")), annotations.agg(F.count("*").alias("annotations")),
        jobs.agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "failed").alias("failed")),
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # rows: one each


def name_collisions(files: DataFrame) -> DataFrame:
    return files.groupBy("name").agg(F.count("*").alias("files"), F.sort_array(F.collect_list("file_id")).alias("file_ids")).filter("files > 1")


def import_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("source_id").agg(*(F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in ("call", "sms", "mms")))


def count_by_type(events: DataFrame, types: list[str]) -> DataFrame:
    """Source occurrences by type, those already imported included."""
    return events.groupBy("artifact_id").agg(*(F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in types))


def scan_coverage(files: DataFrame, cells: DataFrame, issues: DataFrame) -> DataFrame:
    seen = files.agg(F.count("*").alias("files_seen"), F.count("sha256").alias("files_hashed"), F.count_distinct("folder").alias("directories_seen"))
    read = cells.agg(F.count_distinct("table_id", "row").alias("rows_captured"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("cell_characters_captured"))
    return seen.crossJoin(read).crossJoin(issues.agg((F.count("*") == 0).alias("complete")))  # rows: one each


def issue_counts(issues: DataFrame) -> DataFrame:
    """An issue counts once for each code and path."""
    return issues.dropDuplicates(["code", "path"]).groupBy("code").agg(F.count("*").alias("issues"))


def parse_status_rollup(tables: DataFrame) -> DataFrame:
    """A file is complete if all of its tables are, failed without any rows, else limited."""
    whole = tables.groupBy("file_id").agg(F.bool_and("complete").alias("complete"), F.sum("rows").alias("rows"))
    return whole.withColumn("status", F.when(F.col("complete"), "complete").when(F.coalesce(F.col("rows"), F.lit(0)) == 0, "failed").otherwise("limited"))


def file_coverage(issues: DataFrame, benign: list[str]) -> DataFrame:
    other = ~F.col("code").isin(*benign) if benign else F.lit(True)
    return issues.agg(F.when(F.count_if(other) == 0, "complete_within_scope").otherwise("partial").alias("coverage"))


def word_timing_report(segments: DataFrame, most: int = 10_000) -> DataFrame:
    """Per version: segments with word times, without, and available / partial / unavailable; complete is false where the version has more than `most` segments, of which the rest isn't counted.
    Expects `reason` (null: valid words) and n_words."""
    place = F.row_number().over(Window.partitionBy("derived_text_id").orderBy("segment_index"))
    some = segments.withColumn("place", place).filter(F.col("place") <= most + 1)
    out = some.groupBy("derived_text_id").agg((F.max("place") <= most).alias("complete"), *_word_counts(most))
    return out.withColumn("status", F.when(F.col("available") == F.col("segments"), "available").when(F.col("available") > 0, "partial").otherwise("unavailable"))


def _word_counts(most: int) -> list[Column]:
    inside = F.col("place") <= most
    fine = inside & F.col("reason").isNull()
    return [F.count_if(fine).alias("available"), F.count_if(inside).alias("segments"), F.sum(F.when(fine, F.col("n_words")).otherwise(0)).alias("words")]


def package_counts(tables: dict[str, DataFrame], core: list[str]) -> DataFrame:
    """table, rows: one row for each of the core tables, 0 for those that aren't there; tables are summed each by itself."""
    spark = next(iter(tables.values())).sparkSession
    there = reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("table"), F.count("*").alias("rows")) for name, df in sorted(tables.items()) if name in core])
    return spark.createDataFrame([(c,) for c in core], "table string").join(there, "table", "left").select("table", F.coalesce("rows", F.lit(0)).alias("rows"))


def validity_flags(violations: DataFrame, groups: list[str]) -> DataFrame:
    """One column a group of checks: true if it has no error."""
    errors = F.col("severity") == "error"
    return violations.agg(*((F.count_if(errors & (F.col("group") == g)) == 0).alias(f"{g}_valid") for g in groups))


def provenance_cases(artifacts: DataFrame, observations: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct cases of each artifact, by its own source or by any observation."""
    direct = artifacts.select(F.col("id").alias("artifact_id"), "source_id")
    case = sources.select(F.col("id").alias("source_id"), "case_id")
    return direct.unionByName(observations.select("artifact_id", "source_id")).join(case, "source_id").groupBy("artifact_id").agg(F.array_sort(F.collect_set("case_id")).alias("cases"))


def unknowns(packets: DataFrame, fields: dict[str, str]) -> DataFrame:
    """`packets` with the codes of the fields (column -> code) that are null or blank."""
    codes = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(code)) for c, code in fields.items())))
    return packets.withColumn("unknowns", codes)


def repeated_documents(files: DataFrame) -> DataFrame:
    """Rows of a provider id after the first path."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("path"))
    return files.withColumn("place", place).filter("place > 1")
