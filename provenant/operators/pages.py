"""Timelines, lists and pages over record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.functions.scalars import contains_ci, email_domain_match, preview
from provenant.operators.windows import WIDTH, same


def event_time(events: DataFrame) -> Column:
    """When an event began, else when its record was made (imported records often don't say when)."""
    return F.coalesce("ts_start", "created_at") if "created_at" in events.columns else F.col("ts_start")


def timeline(events: DataFrame, phone: str | None = None, event_type: str | None = None, limit: int = 500) -> DataFrame:
    """Newest first by event_time(), ties by id; at most 10,000."""
    found = events
    if phone is not None:
        found = found.filter(F.col("phone_or_address") == phone)
    if event_type is not None:
        found = found.filter(F.col("event_type") == event_type)
    return found.orderBy(event_time(events).desc(), F.desc("id")).limit(max(1, min(limit, 10_000)))


def recent_artifacts(artifacts: DataFrame, n: int = 30) -> DataFrame:
    return artifacts.orderBy(F.desc("id")).limit(n)


def recent_events(events: DataFrame, n: int = 30) -> DataFrame:
    return events.orderBy(event_time(events).desc(), F.desc("id")).limit(n).withColumn("preview", preview(F.col("body"), 240)["text"])


def artifact_events(events: DataFrame, artifact_id: int, n: int = 100) -> DataFrame:
    return limit_with_more(events.filter(F.col("artifact_id") == artifact_id), n, F.col("ts_start"), F.col("id"))


def limit_with_more(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first `n` rows with place and has_more; one row more is fetched to know."""
    some = df.orderBy(*order).limit(n + 1)
    place = F.row_number().over(Window.orderBy(*order))  # over n + 1 rows
    return some.withColumn("place", place).withColumn("has_more", F.count("*").over(Window.partitionBy(F.lit(1))) > n).filter(F.col("place") <= n)


def keyset_page(df: DataFrame, owner: int, limit: int, before_id: int | None = None, snapshot_max_id: int | None = None) -> DataFrame:
    """An owner's page by falling id, within the snapshot that the first page fixed."""
    own = df.filter(F.col("artifact_id") == owner)
    if snapshot_max_id is not None:
        own = own.filter(F.col("id") <= snapshot_max_id)
    if before_id is not None:
        own = own.filter(F.col("id") < before_id)
    return own.orderBy(F.desc("id")).limit(max(1, min(limit, 100)))


def first_pages(df: DataFrame, limit: int) -> DataFrame:
    """The first page of every owner at once, with its snapshot and whether more follow.

    The counts are an aggregate; the ranked filter lets tasks drop all but an owner's first rows before anything is shuffled.
    """
    owners = df.groupBy("artifact_id").agg(F.max("id").alias("snapshot_max_id"), (F.count("*") > limit).alias("has_more"))
    place = F.row_number().over(Window.partitionBy("artifact_id").orderBy(F.desc("id")))
    return df.withColumn("place", place).filter(F.col("place") <= limit).join(owners, "artifact_id")


def budget_prefix(df: DataFrame, size: Column, *, row_cap: int, page_cap: int, item_cap: int | None = None, owner: str = "artifact_id", order: str = "id", width: int = WIDTH) -> DataFrame:
    """Rows of each owner, greatest `order` (an integer) first, until one is over `row_cap` or the sum is over `page_cap` (or a count over `item_cap`); none is skipped.

    cut says what ended the owner's page, null if nothing did. Sums, counts and greatest sizes by ranges of the order tell in which range an owner's page ends: rows of later ranges are dropped unsorted, and an owner
    with all rows is as many tasks as it has ranges.
    """
    rows = df.withColumn("row_bytes", size).withColumn("_range", F.floor(F.col(order) / width))
    before = Window.partitionBy(owner).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    sums = rows.groupBy(owner, "_range").agg(F.sum("row_bytes").alias("_bytes"), F.count("*").alias("_n"), F.max("row_bytes").alias("_most"))
    sums = sums.withColumn("_bytes_before", total("_bytes")).withColumn("_n_before", total("_n"))
    over = (F.col("_most") > row_cap) | (F.col("_bytes_before") + F.col("_bytes") > page_cap)
    over = over | (F.col("_n_before") + F.col("_n") > item_cap) if item_cap is not None else over
    sums = sums.withColumn("_over", F.coalesce(over, F.lit(False))).withColumn("_past", F.coalesce(F.max("_over").over(before), F.lit(False))).filter("not _past").drop("_bytes", "_n", "_most", "_past")

    def placed(ranges: DataFrame) -> DataFrame:
        extra = [f"s.{c}" for c in ranges.columns if c not in (owner, "_range")]
        met = rows.alias("r").join(ranges.alias("s"), same("r", "s", owner, "_range")).select("r.*", *extra)
        along = Window.partitionBy(owner, "_range").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
        return met.withColumn("running", F.col("_bytes_before") + F.coalesce(F.sum("row_bytes").over(along), F.lit(0))).withColumn("place", F.col("_n_before") + F.count("*").over(along))

    why = F.when(F.col("row_bytes") > row_cap, "row_bytes").when(F.col("running") > page_cap, "page_bytes")
    why = why.when(F.col("place") > item_cap, "items") if item_cap is not None else why
    ends = placed(sums.filter("_over")).withColumn("cut", why).filter("cut is not null").groupBy(owner).agg(F.min(F.struct("place", "cut")).alias("_end"))
    known = sums.drop("_over").alias("a").join(ends.alias("b"), same("a", "b", owner), "left").select("a.*", F.col("_end.cut").alias("cut"), F.col("_end.place").alias("_end"))
    return placed(known).filter(F.col("_end").isNull() | (F.col("place") < F.col("_end"))).drop("_range", "_bytes_before", "_n_before", "_end")


def byte_budget_page(df: DataFrame, size: Column, row_cap: int = 1 << 20, page_cap: int = 2 << 20) -> DataFrame:
    return budget_prefix(df, size, row_cap=row_cap, page_cap=page_cap)


def retention_budget(df: DataFrame, size: Column, max_items: int = 1000, max_bytes: int = 4 << 20) -> DataFrame:
    return budget_prefix(df, size, row_cap=max_bytes, page_cap=max_bytes, item_cap=max_items)


def validate_page_chain(pages: DataFrame) -> DataFrame:
    """Violations of a chain of page rows (chain, page, place, id, artifact_id, owner, snapshot_max_id): order, snapshot, owner."""
    along = Window.partitionBy("chain").orderBy("page", "place")
    before, snapshot = F.lag("id").over(along), F.first("snapshot_max_id").over(along)
    codes = F.array_compact(F.array(
        F.when(F.col("id") >= before, F.lit("not_descending")), F.when(F.col("id") > F.col("snapshot_max_id"), F.lit("outside_snapshot")),
        F.when(F.col("artifact_id") != F.col("owner"), F.lit("foreign_row")), F.when(F.col("snapshot_max_id") != snapshot, F.lit("snapshot_changed")),
    ))
    return pages.withColumn("codes", codes).select("chain", "page", "place", "id", F.explode("codes").alias("code"))


def contacts(df: DataFrame, query: str) -> DataFrame:
    hit = contains_ci(F.col("phone"), F.lit(query)) | contains_ci(F.col("label"), F.lit(query)) | contains_ci(F.col("backup_name"), F.lit(query)) | contains_ci(F.col("public_id"), F.lit(query))
    return df.filter(hit).orderBy(F.desc("interactions"), "public_id")


def select_messages(sms: DataFrame, mms: DataFrame, phones: DataFrame, senders: list[str], keywords: list[str]) -> DataFrame:
    """Messages of chosen phones, of chosen short senders or whose contact or sender has a keyword; newest first."""
    both = sms.unionByName(mms)
    chosen = both.join(phones.select("phone").distinct().withColumn("_chosen", F.lit(True)), "phone", "left")
    words = F.array(*map(F.lit, keywords)).cast("array<string>")
    keyed = F.exists(words, lambda k: contains_ci(F.col("contact"), k) | contains_ci(F.col("sender"), k))
    named = F.col("sender").isin(*senders) if senders else F.lit(False)
    return chosen.filter(F.coalesce("_chosen", F.lit(False)) | F.coalesce(named, F.lit(False)) | keyed).drop("_chosen").orderBy(F.desc(F.coalesce("t", F.lit(""))), F.desc("id"))


def _of_phones(rows: DataFrame, phones: DataFrame, keywords: list[str]) -> DataFrame:
    """Rows of chosen phones, or whose contact has a keyword."""
    words = F.array(*map(F.lit, keywords)).cast("array<string>")
    chosen = rows.join(phones.select("phone").distinct().withColumn("_chosen", F.lit(True)), "phone", "left")
    return chosen.filter(F.coalesce("_chosen", F.lit(False)) | F.coalesce(F.exists(words, lambda k: contains_ci(F.col("contact"), k)), F.lit(False))).drop("_chosen")


def select_calls(calls: DataFrame, phones: DataFrame, keywords: list[str] = ()) -> DataFrame:
    return _of_phones(calls, phones, list(keywords)).orderBy(F.desc(F.coalesce("t", F.lit(""))), F.desc("id"))


def select_recordings(recordings: DataFrame, phones: DataFrame, keywords: list[str] = ()) -> DataFrame:
    """Recordings (phone, contact, resolved_time, call_start) by the same rule; newest first by the resolved time, else the call's."""
    return _of_phones(recordings, phones, list(keywords)).orderBy(F.desc(F.coalesce("resolved_time", "call_start", F.lit(""))), F.desc("id"))


def select_emails(identities: DataFrame, explicit: list[str], domains: list[str]) -> DataFrame:
    email = F.col("email")
    named = F.lower(email).isin(*[e.lower() for e in explicit]) if explicit else F.lit(False)
    return identities.filter(F.coalesce(named, F.lit(False)) | email_domain_match(email, domains)).withColumn("email", F.lower(email)).dropDuplicates(["email"])


def scan_files(files: DataFrame, audio_only: bool = False, query: str = "") -> DataFrame:
    found = files.filter(F.col("kind") == "audio") if audio_only else files
    return found.filter(contains_ci(F.col("path"), F.lit(query))) if query else found


def cap_rows(rows: DataFrame, per_file: int, total: int, file: str = "file", order: str = "row") -> tuple[DataFrame, DataFrame]:
    """Rows within both caps, and an issue for each file and cap that cut. Files count in order of name; the running sum is over files, not rows."""
    counts = rows.groupBy(file).agg(F.count("*").alias("n")).withColumn("own", F.least("n", F.lit(per_file)))
    before = F.coalesce(F.sum("own").over(Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("room", F.greatest(F.lit(0), F.least("own", F.lit(total) - before)))
    place = F.row_number().over(Window.partitionBy(file).orderBy(order))
    kept = rows.withColumn("_place", place).join(counts.select(file, "room"), file).filter(F.col("_place") <= F.col("room")).drop("_place", "room")
    codes = F.array_compact(F.array(F.when(F.col("n") > per_file, F.lit("file_row_limit")), F.when(F.col("room") < F.col("own"), F.lit("total_row_limit"))))
    return kept, counts.select(F.col(file), F.explode(codes).alias("code"))


def truncated_cells(cells: DataFrame, max_chars: int, *place: str, value: str = "value") -> DataFrame:
    """An issue for each cell that truncate_cells() cuts: its place, code and how many characters it had."""
    return cells.filter(F.length(value) > max_chars).select(*place, F.lit("cell_character_limit").alias("code"), F.length(value).cast("long").alias("characters"))


def truncate_cells(cells: DataFrame, max_chars: int, value: str = "value") -> DataFrame:
    return cells.withColumn("complete", F.coalesce(F.length(value) <= max_chars, F.lit(True))).withColumn(value, F.substring(value, 1, max_chars))


def cap_columns(cells: DataFrame, max_columns: int = 128, owner: str = "table_id") -> DataFrame:
    """Cells of the first columns; table_complete is false where others were left out."""
    whole = cells.groupBy(owner).agg((F.max("column") <= max_columns).alias("table_complete"))
    return cells.filter(F.col("column") <= max_columns).join(whole, owner)


def row_width_mismatch(cells: DataFrame, owner: str = "table_id") -> DataFrame:
    """Rows whose number of cells isn't the header's (row 0)."""
    width = cells.groupBy(owner, "row").agg(F.count("*").alias("width"))
    header = width.filter("row = 0").select(owner, F.col("width").alias("header_width"))
    return width.filter("row > 0").join(header, owner).filter("width <> header_width")


def list_versions(derived: DataFrame, artifact_id: int) -> DataFrame:
    return derived.filter(F.col("artifact_id") == artifact_id).orderBy(F.desc("id"))


def list_observations(observations: DataFrame, artifact_id: int) -> DataFrame:
    return observations.filter(F.col("artifact_id") == artifact_id).orderBy("id")


def list_citations(anchors: DataFrame, artifact_id: int) -> DataFrame:
    return anchors.filter(F.col("artifact_id") == artifact_id).orderBy("id")


def list_annotations(annotations: DataFrame, artifact_id: int) -> DataFrame:
    return annotations.filter(F.col("artifact_id") == artifact_id).orderBy(F.desc("id"))
