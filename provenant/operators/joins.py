"""Catalogues, links and ingest as joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenant.functions.scalars import basename, preview, to_ms


def artifact_with_source(artifacts: DataFrame, sources: DataFrame) -> DataFrame:
    return artifacts.join(sources.select(F.col("id").alias("source_id"), F.col("label").alias("source_label")), "source_id", "left")


def artifact_catalog(artifacts: DataFrame, jobs: DataFrame, derived: DataFrame, limit: int | None = None) -> DataFrame:
    """Media with the state of their transcription: running, queued, the latest job failed, done, none; by priority of the latest job, then id.

    Two sums by artifact and two joins; the newest rows come from max_by, not from a sort of each group.
    """
    media = artifacts.filter(F.col("mime_type").startswith("audio/") | F.col("mime_type").startswith("video/"))
    work = jobs.filter(F.col("kind") == "transcribe").groupBy(F.col("artifact_id").alias("id")).agg(
        F.bool_or(F.col("status") == "running").alias("running"), F.bool_or(F.col("status") == "queued").alias("queued"),
        F.max_by("status", "id").alias("last_status"), F.max_by("priority", "id").alias("priority"),
    )
    texts = derived.filter(F.col("kind") == "transcript").groupBy(F.col("artifact_id").alias("id")).agg(
        F.max_by("language", "id").alias("language"), F.max_by(preview(F.col("text"), 400)["text"], "id").alias("preview"), F.lit(True).alias("has_text")
    )
    state = F.when(F.col("running"), "running").when(F.col("queued"), "queued").when(F.col("last_status") == "failed", "failed").when(F.col("has_text"), "done").otherwise("none")
    found = media.join(work, "id", "left").join(texts, "id", "left").select("id", "original_name", "mime_type", state.alias("status"), "language", "preview", "priority")
    found = found.orderBy(F.desc(F.coalesce("priority", F.lit(-1))), F.desc("id"))
    return found.limit(limit) if limit is not None else found


def latest_transcript(derived: DataFrame) -> DataFrame:
    text = derived.filter(F.col("kind") == "transcript")
    return text.groupBy("artifact_id").agg(F.max_by(F.struct("id", "language", "text"), "id").alias("t")).select("artifact_id", "t.*")


def pinned_transcript(derived: DataFrame, pins: DataFrame) -> DataFrame:
    """The versions that pins (artifact_id, id) name, whatever is newer."""
    return derived.filter(F.col("kind") == "transcript").join(pins, ["artifact_id", "id"], "left_semi")


def transcript_with_run(derived: DataFrame, runs: DataFrame) -> DataFrame:
    known = runs.drop("lease_token").withColumnRenamed("id", "run_id").withColumnRenamed("status", "run_status").drop("artifact_id")
    return derived.join(known, "run_id", "left").withColumn("provenance_status", F.when(F.col("run_status").isNull(), "legacy_unknown").otherwise("recorded"))


def job_with_runs(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Each job with its runs as an array by id."""
    nested = runs.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("id", "status"))).alias("runs"))
    return jobs.join(nested, jobs.id == nested.job_id, "left").drop("job_id")


#: Rows of a name, on each side, that meet in a cell; pairs of a task, about, and the most tasks; rows on the right and on the left that meet at a time.
CELL, TASK_PAIRS, TASKS, RUN, SOME = 2_000, 4_000_000, 2_000, 256, 16


def _met_by_name(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """`left` and `right` joined on `name`. There are as many pairs as a name has, so tasks go with the pairs: the two sides of a name that many rows share are dealt over a grid of cells, each meeting all others once.

    There are TASKS tasks at most; beyond them tasks take more pairs, then cells grow, so that copies of rows are shuffled as the rows grow, not as the pairs. Within a cell a run of the right side meets all of the left before the next run does: left columns stay the
    same for RUN rows while right ones go through the same few values again and again, of which a file of pairs takes a small part of the bytes that it takes in any other order.
    """
    rows = lambda df, n: df.groupBy("name").agg(F.count("*").alias(n))
    both = rows(left, "n_left").join(rows(right, "n_right"), "name")
    pairs = both.agg(F.sum(F.col("n_left") * F.col("n_right"))).first()[0] or 0
    tasks = min(TASKS, pairs // TASK_PAIRS + 1)
    cell = max(CELL, math.isqrt(pairs // tasks) // 2)  # some four cells a task, so that tasks are alike
    grid = both.select("name", *(F.ceil(F.col(f"n_{side}") / cell).cast("int").alias(f"_{side}s") for side in ("left", "right"))).filter("_lefts > 1 or _rights > 1")  # a row for some thousand rows at most

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """A row a cell: the rows of that side, as an array."""
        at = df.join(F.broadcast(grid), "name", "left").withColumn(f"_{own}", F.pmod(F.xxhash64(key), F.coalesce(f"_{own}s", F.lit(1))))
        cells = at.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(f"_{other}s", F.lit(1)).cast("bigint") - 1)))
        met = cells.drop("_lefts", "_rights").repartition(tasks, "name", "_left", "_right")
        return met.groupBy("name", "_left", "_right").agg(F.collect_list(F.struct(*(c for c in df.columns if c != "name"))).alias(f"{own}_rows"))

    pieces = lambda rows, n: F.explode(F.transform(F.sequence(F.lit(1), F.size(rows), F.lit(n)), lambda at: F.slice(rows, at, n)))
    met = dealt(left, left_key, "left", "right").join(dealt(right, right_key, "right", "left"), ["name", "_left", "_right"])
    runs = met.select("name", "left_rows", pieces("right_rows", RUN).alias("_run")).select("name", "_run", pieces("left_rows", SOME).alias("_some"))  # a task holds RUN * SOME pairs at a time
    return runs.select("name", "_run", F.inline("_some")).select(*left.columns, F.inline("_run"))


def _wanted(observations: DataFrame, files: DataFrame) -> DataFrame:
    """Observations that name some file; ambiguous if they name several. Files are counted by name: links aren't made for it."""
    counts = files.groupBy("name").agg(F.count("*").alias("_n"))
    named = observations.withColumn("name", basename(F.col("value"))).join(counts, "name")
    return named.withColumn("ambiguous", F.sum("_n").over(Window.partitionBy("observation_id")) > 1).drop("_n")


def candidate_links(observations: DataFrame, files: DataFrame) -> DataFrame:
    """File references met with all files of that name; ambiguous if there are several."""
    return _met_by_name(_wanted(observations, files), "observation_id", files.select("file_id", "name"), "file_id")


def first_links(observations: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """capped_links() of candidate_links(), from the first `limit` + 1 observations and the first files of their names: each has a link, so no others are needed."""
    wanted = _wanted(observations, files)
    chosen = wanted.select(F.col("observation_id").alias("_id")).distinct().orderBy("_id").limit(limit + 1)
    wanted = wanted.join(F.broadcast(chosen), F.col("observation_id").eqNullSafe(F.col("_id")), "left_semi")
    place = F.row_number().over(Window.partitionBy("name").orderBy("file_id"))
    named = files.select("file_id", "name").join(wanted.select("name").distinct(), "name", "left_semi").withColumn("_place", place).filter(F.col("_place") <= limit + 1).drop("_place")
    return capped_links(wanted.join(named, "name"), limit)


def capped_links(links: DataFrame, limit: int) -> DataFrame:
    """The first `limit` candidate links by observation, then file, with limited: whether there are more. Each task keeps its own first ones, so that no task sees all links."""
    first = links.orderBy("observation_id", "file_id").limit(limit + 1)
    order = Window.orderBy("observation_id", "file_id")  # over limit + 1 rows
    return first.withColumn("_place", F.row_number().over(order)).withColumn("limited", F.count("*").over(Window.partitionBy(F.lit(1))) > limit).filter(F.col("_place") <= limit).drop("_place")


def recording_candidates(recordings: DataFrame, files: DataFrame) -> DataFrame:
    met = _met_by_name(recordings.withColumnRenamed("recording_name", "name"), "recording_id", files.select("uri", "name"), "uri")
    return met.withColumn("recording_name", F.col("name")).withColumnRenamed("name", "file_name")


def linked_count(recordings: DataFrame, files: DataFrame) -> DataFrame:
    return recordings.join(files.select(F.col("name").alias("recording_name")), "recording_name", "left_semi").agg(F.count("*").alias("linked"))


def phone_disagreements(row_phones: DataFrame, file_phones: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose row names phones, and whose file's name others."""
    rows = row_phones.groupBy("row_id").agg(F.array_sort(F.collect_set("phone")).alias("row_phones"))
    files = file_phones.groupBy("file_id").agg(F.array_sort(F.collect_set("phone")).alias("file_phones"))
    return links.join(rows, "row_id").join(files, "file_id").filter(~F.arrays_overlap("row_phones", "file_phones"))


def selected_candidates(recordings: DataFrame, files: DataFrame) -> DataFrame:
    """Files that some chosen recording names, each URI once."""
    return files.join(recordings.select(F.col("recording_name").alias("name")), "name", "left_semi").dropDuplicates(["uri"])


#: What a run should say of its making, and the codes of what a packet doesn't know.
RUN_FIELDS = ("tool", "tool_version", "provider", "model", "model_version")
SCOPE = {"source_bytes_included": False, "media_bytes_included": False, "live_restore_supported": False, "tasks_imported": False, "locators": "literal_inert_metadata", "stored_path_included": False}


def _whole(df: DataFrame, *left_out: str, name: str):
    """All columns of a row but `left_out` as one struct; null columns for those that a shorter table lacks aren't made up."""
    return F.struct(*(F.col(c) for c in df.columns if c not in left_out)).alias(name)


def citation_packets(anchors: DataFrame, artifacts: DataFrame, derived: DataFrame, sources: DataFrame, observations: DataFrame, runs: DataFrame) -> DataFrame:
    """One row an anchor (anchor_id, artifact_id, derived_text_id, what was quoted): the whole artifact, the version it pins, the source, the run and the observations, each as a nested
    record, with unknowns, scope and errors.

    Storage paths and lease tokens stay out. errors names references that lead nowhere (a source or run that isn't there, or a run of another artifact); unknowns what the records
    don't say. A packet with errors must not be written.
    """
    seen = observations.groupBy("artifact_id").agg(F.sort_array(F.collect_list(F.struct("observation_id", *(c for c in observations.columns if c not in ("observation_id", "artifact_id"))))).alias("observations"))
    quoted = [c for c in anchors.columns if c not in ("artifact_id", "derived_text_id")]
    found = (
        anchors.select("artifact_id", "derived_text_id", F.struct(*quoted, "artifact_id", "derived_text_id").alias("anchor"), "anchor_id")
        .join(artifacts.select(F.col("id").alias("artifact_id"), _whole(artifacts, "stored_path", name="artifact")), "artifact_id")
        .join(derived.filter("kind = 'transcript'").select(F.col("id").alias("derived_text_id"), "artifact_id", _whole(derived, name="version")), ["derived_text_id", "artifact_id"])
        .join(sources.select(F.col("id").alias("_source"), _whole(sources, name="source")), F.col("artifact.source_id") == F.col("_source"), "left")
        .join(runs.select(F.col("id").alias("_run"), _whole(runs, "lease_token", name="run")), F.col("version.run_id") == F.col("_run"), "left")
        .join(seen, "artifact_id", "left")
    )
    has = lambda name, column: column in found.schema[name].dataType.fieldNames()
    lost = F.col("artifact.source_id").isNotNull() & F.col("source").isNull()
    foreign = F.col("version.run_id").isNotNull() & (F.col("run").isNull() | ~F.col("run.artifact_id").eqNullSafe(F.col("artifact_id")))
    unknowns = [
        *(F.when(F.col(f"artifact.{c}").isNull(), F.lit(code)) for c, code in (("sha256", "source_content_digest_unknown"), ("size_bytes", "source_size_unknown")) if has("artifact", c)),
        F.when(F.col("source").isNull(), F.lit("source_record_unknown")), F.when(F.col("observations").isNull(), F.lit("acquisition_history_unknown")),
        *([F.when(F.exists("observations", lambda o: o["acquisition_kind"] == "legacy_snapshot"), F.lit("acquisition_history_partial"))] if "acquisition_kind" in observations.columns else []),
        F.when(F.col("run").isNull(), F.lit("processing_run_unknown")),
        F.when(F.col("run").isNotNull() & ~F.col("run.status").eqNullSafe("done"), F.lit("processing_run_success_unconfirmed")),
        *(F.when(F.col("run").isNotNull() & F.coalesce(F.col(f"run.{c}"), F.lit("")).isin("", "unknown"), F.lit(f"processing_run.{c}_unknown")) for c in RUN_FIELDS if has("run", c)),
    ]
    errors = F.array_compact(F.array(F.when(lost, F.lit("missing_source")), F.when(foreign, F.lit("missing_or_foreign_run"))))
    return found.withColumn("errors", errors).withColumn("unknowns", F.array_compact(F.array(*unknowns))).withColumn("scope", F.struct(*(F.lit(v).alias(k) for k, v in SCOPE.items()))).drop("_source", "_run")


def dedupe_ingest(new: DataFrame, known: DataFrame) -> DataFrame:
    """New files by content and place: outcome new, reobserved (the known id) or conflict (same content and place, other size or rawness)."""
    place = lambda side: F.coalesce(F.col(f"{side}.source_locator"), F.lit(""))
    found = new.alias("n").join(known.alias("k"), (F.col("n.sha256") == F.col("k.sha256")) & (place("n") == place("k")), "left")
    same = F.col("n.size_bytes").eqNullSafe(F.col("k.size_bytes")) & F.col("n.is_raw").eqNullSafe(F.col("k.is_raw"))
    outcome = F.when(F.col("k.id").isNull(), "new").when(same, "reobserved").otherwise("conflict")
    return found.select("n.*", F.col("k.id").alias("artifact_id"), outcome.alias("outcome"))


def upsert_events(new: DataFrame, known: DataFrame, payload: list[str]) -> DataFrame:
    """New events by key: inserted, reobserved (equal payload) or conflict. Without an external id all are inserted."""
    keys = ["artifact_id", "source_id", "event_type", "external_id"]
    on = F.col("n.external_id").isNotNull()
    for k in keys:
        on = on & F.col(f"n.{k}").eqNullSafe(F.col(f"k.{k}"))
    same = F.lit(True)
    for c in payload:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}"))
    found = new.alias("n").join(known.alias("k"), on, "left")
    outcome = F.when(F.col("k.id").isNull(), "inserted").when(same, "reobserved").otherwise("conflict")
    return found.select("n.*", F.col("k.id").alias("known_id"), outcome.alias("outcome"))


def ensure_sources(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Each wanted (case_id, kind, label, locator, account) with the least known id, null where it has to be made."""
    keys = ["case_id", "kind", "label", "locator", "account"]
    least = known.groupBy(*keys).agg(F.min("id").alias("known_id")).alias("k")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"w.{k}").eqNullSafe(F.col(f"k.{k}"))
    return wanted.select(*keys).distinct().alias("w").join(least, on, "left").select("w.*", "known_id")


def label_for(phones: DataFrame, contacts: DataFrame) -> DataFrame:
    """The first contact's label, else the phone, else unknown."""
    first = contacts.groupBy("phone").agg(F.min_by("label", "ordinal").alias("contact"))
    return phones.join(first, "phone", "left").withColumn("label", F.coalesce("contact", "phone", F.lit("unknown"))).drop("contact")


def annotation_target_check(annotations: DataFrame, segments: DataFrame, derived: DataFrame) -> DataFrame:
    """Annotations with a reason where their target doesn't hold: no version, another artifact's version, an end after the last segment."""
    ends = segments.groupBy("derived_text_id").agg(F.max(to_ms(F.col("end_s"))).alias("last_ms"))
    versions = derived.select(F.col("id").alias("derived_text_id"), F.col("artifact_id").alias("owner"))
    found = annotations.join(versions, "derived_text_id", "left").join(ends, "derived_text_id", "left")
    ranged = F.col("start_ms").isNotNull() | F.col("end_ms").isNotNull()
    reason = (
        F.when(ranged & F.col("derived_text_id").isNull(), "range_without_version").when(F.col("derived_text_id").isNotNull() & F.col("owner").isNull(), "unknown_version")
        .when(F.col("owner") != F.col("artifact_id"), "foreign_version").when(F.col("end_ms") < F.col("start_ms"), "reversed_range").when(F.col("end_ms") > F.col("last_ms"), "beyond_transcript")
    )
    return found.withColumn("reason", reason).drop("owner", "last_ms")


def queue_all_media(artifacts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Media without an active job."""
    media = artifacts.filter(F.col("mime_type").startswith("audio/") | F.col("mime_type").startswith("video/"))
    active = jobs.filter(F.col("status").isin("queued", "running")).select(F.col("artifact_id").alias("id"))
    return media.join(active, "id", "left_anti").select(F.col("id").alias("artifact_id"), F.lit("transcribe").alias("kind"), F.lit("queued").alias("status"))


def enqueue(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests (artifact_id, priority): insert without an active job, reprioritise if given and different, else keep."""
    active = jobs.filter(F.col("status").isin("queued", "running")).groupBy("artifact_id").agg(F.max_by(F.struct("id", "priority"), "id").alias("job"))
    act = F.when(F.col("job").isNull(), "insert").when(F.col("priority").isNotNull() & (F.col("priority") != F.col("job.priority")), "reprioritise").otherwise("keep")
    return requests.join(active, "artifact_id", "left").select("artifact_id", "priority", F.col("job.id").alias("job_id"), act.alias("action"))


def runnable_jobs(jobs: DataFrame) -> DataFrame:
    """Queued jobs whose artifact has no running one of the same kind."""
    running = jobs.filter(F.col("status") == "running").select(F.col("kind").alias("k"), F.col("artifact_id").alias("a")).distinct()
    same = F.col("kind").eqNullSafe(F.col("k")) & F.col("artifact_id").eqNullSafe(F.col("a"))
    return jobs.filter(F.col("status") == "queued").join(running, same, "left_anti").orderBy(F.desc("priority"), "id")


def backfill_observations(artifacts: DataFrame, observations: DataFrame) -> DataFrame:
    """A legacy row for each artifact nobody observed; its time is not an acquisition time."""
    missing = artifacts.join(observations.select(F.col("artifact_id").alias("id")), "id", "left_anti")
    return missing.select(F.col("id").alias("artifact_id"), "source_id", F.lit("legacy_snapshot").alias("acquisition_kind"), F.lit(False).alias("is_acquisition_time"))
