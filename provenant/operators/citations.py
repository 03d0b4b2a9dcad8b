"""Exact quotes from transcript versions, by segments or by words.

Segments are ARRAY<STRUCT<start DOUBLE, end DOUBLE, text STRING, words ARRAY<STRUCT<start DOUBLE, end DOUBLE, word STRING>>>>. A request that
doesn't hold gets a reason and no quote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions.scalars import to_ms
from provenant.operators.windows import contiguous

MOST_WORDS, MOST_SEGMENT_WORDS = 10_000, 100_000
SEGMENT = "struct<start:double,end:double,text:string,words:array<struct<start:double,end:double,word:string>>>"
_ODD_TIME = "({0} is null or isnan({0}) or {0} < 0 or {0} > 9223372036854775.807D)"


def segment_times_ok(segments: str) -> Column:
    odd = " or ".join(_ODD_TIME.format(f"s.{x}") for x in ("start", "end"))
    return F.expr(f"forall({segments}, s -> not ({odd}) and s.end >= s.start)")


def no_overlap(items: str) -> Column:
    """Each item starts no earlier than the one before ends."""
    return F.expr(f"size({items}) < 2 or forall(zip_with(slice({items}, 1, size({items}) - 1), slice({items}, 2, size({items}) - 1), (a, b) -> b.start >= a.end), x -> x)")


def assemble_text(segments: Column) -> Column:
    """A version's text: trimmed segments with one space between; a quote joins them exactly instead."""
    return F.array_join(F.transform(segments, lambda s: F.trim(s["text"])), " ")


def valid_words_reason(s: str) -> Column:
    """Why the words of segment `s` (a struct column) can't be cited; null if they can."""
    odd = " or ".join(_ODD_TIME.format(f"w.{x}") for x in ("start", "end"))
    return F.expr(f"""
        case when {s}.text is null or trim({s}.text) = '' then 'blank_segment'
             when {_ODD_TIME.format(s + '.start')} or {_ODD_TIME.format(s + '.end')} or {s}.end < {s}.start then 'segment_time'
             when {s}.words is null or size({s}.words) = 0 then 'no_words'
             when size({s}.words) > {MOST_SEGMENT_WORDS} then 'too_many_words'
             when exists({s}.words, w -> w.word is null or trim(w.word) = '') then 'blank_word'
             when exists({s}.words, w -> {odd} or w.end < w.start or w.end > {s}.end or w.start < {s}.start) then 'word_time'
             when size({s}.words) > 1 and not forall(zip_with(slice({s}.words, 1, size({s}.words) - 1), slice({s}.words, 2, size({s}.words) - 1), (a, b) -> b.start >= a.end), x -> x) then 'word_time'
             when array_join(transform({s}.words, w -> w.word), '') <> {s}.text then 'text_differs' end
    """)


def cite_segments(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """requests (derived_text_id, indices) met with versions (derived_text_id, segments): quote, digest, times in ms, selector, or a reason."""
    found = requests.join(versions, "derived_text_id", "left")
    picked = found.withColumn("_picked", F.expr("if(size(indices) > 0 and indices[0] >= 0 and element_at(indices, -1) < size(segments) and size(indices) <= size(segments), slice(segments, indices[0] + 1, size(indices)), null)"))
    reason = (
        F.when(F.col("segments").isNull(), "unknown_version").when(F.coalesce(F.size("indices"), F.lit(0)) <= 0, "nothing_selected").when(F.exists("indices", lambda i: i < 0), "negative_index")
        .when(~contiguous(F.col("indices")), "not_contiguous").when(F.expr("element_at(indices, -1) >= size(segments)"), "outside_transcript")
        .when(F.exists("_picked", lambda s: s["text"].isNull() | (F.trim(s["text"]) == "")), "blank_segment").when(~segment_times_ok("_picked"), "segment_time").when(~no_overlap("_picked"), "segments_overlap")
    )
    return _projected(picked.withColumn("reason", reason), F.array_join(F.transform("_picked", lambda s: s["text"]), ""), F.expr("_picked[0].start"), F.expr("element_at(_picked, -1).end"), F.to_json(F.struct(F.col("indices"), F.lit("segments").alias("kind"), F.lit("concatenate_exact").alias("text_join")))).drop("_picked", "segments")


def _projected(df: DataFrame, quote: Column, start: Column, end: Column, selector: Column) -> DataFrame:
    ok = F.col("reason").isNull()
    return (
        df.withColumn("quote_text", F.when(ok, quote)).withColumn("quote_sha256", F.sha2("quote_text", 256)).withColumn("start_ms", F.when(ok, to_ms(start)))
        .withColumn("end_ms", F.when(ok, to_ms(end))).withColumn("selector_json", F.when(ok, selector))
    )


def cite_words(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """requests (derived_text_id, word_refs ARRAY<STRUCT<segment_index INT, word_index INT>>): words in a row, across segments too.

    All words of every touched segment must be valid, not only those selected. Work stays within the row: no explosion.
    """
    found = requests.join(versions, "derived_text_id", "left")
    inside = F.expr("""forall(word_refs, r -> r.segment_index >= 0 and r.word_index >= 0 and r.segment_index < size(segments) and r.word_index < size(segments[r.segment_index].words))""")
    follows = F.expr("""size(word_refs) < 2 or forall(zip_with(slice(word_refs, 1, size(word_refs) - 1), slice(word_refs, 2, size(word_refs) - 1), (a, b) ->
        (b.segment_index = a.segment_index and b.word_index = a.word_index + 1) or
        (b.segment_index = a.segment_index + 1 and b.word_index = 0 and a.word_index = size(segments[a.segment_index].words) - 1)), x -> x)""")
    touched = "transform(array_distinct(transform(word_refs, r -> r.segment_index)), i -> segments[i])"
    checked = found.withColumn("_touched", F.expr(f"if(size(word_refs) > 0 and forall(word_refs, r -> r.segment_index between 0 and size(segments) - 1), {touched}, null)"))
    reasons = F.expr("array_compact(transform(_touched, s -> " + _inline(valid_words_sql("s")) + "))")
    reason = (
        F.when(F.col("segments").isNull(), "unknown_version").when(F.coalesce(F.size("word_refs"), F.lit(0)) <= 0, "nothing_selected").when(F.size("word_refs") > MOST_WORDS, "too_many_words")
        .when(F.col("_touched").isNull(), "outside_transcript").when(F.size(reasons) > 0, F.element_at(reasons, 1)).when(~inside, "outside_segment").when(~follows, "not_contiguous").when(~no_overlap("_touched"), "segments_overlap")
    )
    words = F.expr("transform(word_refs, r -> segments[r.segment_index].words[r.word_index])")
    picked = checked.withColumn("reason", reason).withColumn("_words", F.when(F.col("reason").isNull(), words))
    return _projected(picked, F.array_join(F.transform("_words", lambda w: w["word"]), ""), F.expr("_words[0].start"), F.expr("element_at(_words, -1).end"), F.to_json(F.struct(F.lit("words").alias("kind"), F.lit("concatenate_exact").alias("text_join"), "word_refs"))).drop("_touched", "_words", "segments")


def valid_words_sql(s: str) -> str:
    odd = " or ".join(_ODD_TIME.format(f"w.{x}") for x in ("start", "end"))
    return f"""case when {s}.text is null or trim({s}.text) = '' then 'blank_segment'
        when {s}.words is null or size({s}.words) = 0 then 'no_words'
        when exists({s}.words, w -> w.word is null or trim(w.word) = '') then 'blank_word'
        when exists({s}.words, w -> {odd} or w.end < w.start or w.end > {s}.end or w.start < {s}.start) then 'word_time'
        when size({s}.words) > 1 and not forall(zip_with(slice({s}.words, 1, size({s}.words) - 1), slice({s}.words, 2, size({s}.words) - 1), (a, b) -> b.start >= a.end), x -> x) then 'word_time'
        when array_join(transform({s}.words, w -> w.word), '') <> {s}.text then 'text_differs' end"""


def _inline(sql: str) -> str:
    return " ".join(sql.split())


def create_citations(requests: DataFrame, versions: DataFrame, derived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors with reasons, and audit rows of those made. A request has indices or word_refs, not both; an expected quote must be equal."""
    owners = derived.select(F.col("id").alias("derived_text_id"), F.col("artifact_id").alias("owner"), F.col("kind").alias("text_kind"))
    one = F.col("indices").isNotNull() != F.col("word_refs").isNotNull()
    shared = ["request_id", "artifact_id", "derived_text_id", "expected_quote", "reason", "quote_text", "quote_sha256", "start_ms", "end_ms", "selector_json"]
    by_segments = cite_segments(requests.filter(one & F.col("indices").isNotNull()).drop("word_refs"), versions).select(*shared)
    by_words = cite_words(requests.filter(one & F.col("word_refs").isNotNull()).drop("indices"), versions).select(*shared)
    neither = requests.filter(~one)
    for c, kind in {"reason": "string", "quote_text": "string", "quote_sha256": "string", "start_ms": "bigint", "end_ms": "bigint", "selector_json": "string"}.items():
        neither = neither.withColumn(c, F.lit("one_selection_needed" if c == "reason" else None).cast(kind))
    made = by_segments.unionByName(by_words).unionByName(neither.select(*shared)).join(owners, "derived_text_id", "left")
    reason = F.coalesce("reason", F.when(F.col("owner").isNull() | (F.col("owner") != F.col("artifact_id")), "foreign_version").when(F.col("text_kind") != "transcript", "not_a_transcript").when(F.col("expected_quote").isNotNull() & (F.col("expected_quote") != F.col("quote_text")), "quote_differs"))
    made = made.withColumn("reason", reason).drop("owner", "text_kind")
    audit = made.filter("reason is null").select(F.lit("citation_created").alias("action"), F.lit("artifact").alias("object_kind"), F.col("artifact_id").alias("object_id"), F.to_json(F.struct("derived_text_id", "quote_sha256")).alias("details_json"))
    return made, audit


SELECTOR = "kind string, text_join string, indices array<int>, word_refs array<struct<segment_index:int,word_index:int>>"


def verify_anchors(anchors: DataFrame, versions: DataFrame, derived: DataFrame | None = None) -> DataFrame:
    """id, code: what a quote rebuilt from the stored selector doesn't bear out of anchors (id, artifact_id, derived_text_id, selector_json, quote_text, quote_sha256, start_ms, end_ms).

    Selectors of segments and of words are read from selector_json, which must say just what the rebuilt one says. With `derived` (id, artifact_id, kind) an anchor must
    pin a transcript of its own artifact; nothing else is said of one that doesn't.
    """
    own = ["quote_text", "quote_sha256", "start_ms", "end_ms", "selector_json"]
    stored = anchors.select("id", "derived_text_id", *(["artifact_id"] if derived is not None else []), *(F.col(c).alias(f"stored_{c}") for c in own), F.from_json("selector_json", SELECTOR).alias("_s"))
    lost = None
    if derived is not None:
        pinned = derived.filter("kind = 'transcript'").select(F.col("id").alias("derived_text_id"), F.col("artifact_id").alias("_owner"))
        met = stored.join(pinned, "derived_text_id", "left").withColumn("_fits", F.coalesce(F.col("_owner") == F.col("artifact_id"), F.lit(False)))
        lost, stored = met.filter("not _fits").select("id", F.lit("anchor_version_mismatch").alias("code")), met.filter("_fits").drop("_owner", "_fits", "artifact_id")
    by = lambda kind: stored.filter(F.col("_s.kind") == kind)
    built = cite_segments(by("segments").withColumn("indices", F.col("_s.indices")), versions).drop("indices")
    built = built.unionByName(cite_words(by("words").withColumn("word_refs", F.col("_s.word_refs")), versions).drop("word_refs"))
    neither = stored.filter(~F.coalesce(F.col("_s.kind"), F.lit("")).isin("segments", "words"))
    for c, kind in {"reason": "string", "quote_text": "string", "quote_sha256": "string", "start_ms": "bigint", "end_ms": "bigint", "selector_json": "string"}.items():
        neither = neither.withColumn(c, F.lit("unknown_selector" if c == "reason" else None).cast(kind))
    built = built.unionByName(neither)
    plain = lambda c: F.to_json(F.try_parse_json(c))
    same = plain("selector_json").eqNullSafe(plain("stored_selector_json"))
    for c in ("quote_text", "quote_sha256", "start_ms", "end_ms"):
        same = same & F.col(c).eqNullSafe(F.col(f"stored_{c}"))
    whole = F.col("stored_start_ms").isNotNull() & F.col("stored_end_ms").isNotNull() & (F.col("stored_start_ms") >= 0) & (F.col("stored_end_ms") >= F.col("stored_start_ms"))
    codes = F.array_compact(F.array(
        F.when(~F.sha2("stored_quote_text", 256).eqNullSafe(F.col("stored_quote_sha256")), F.lit("anchor_quote_digest_mismatch")),
        F.when(~whole, F.lit("invalid_anchor_interval")), F.when(F.col("reason").isNotNull(), F.lit("invalid_anchor_selector")),
        F.when(F.col("reason").isNull() & ~same, F.lit("anchor_selector_mismatch")),
    ))
    found = built.select("id", F.explode(codes).alias("code"))
    return found if lost is None else found.unionByName(lost)


def created_matches(expected: DataFrame, saved: DataFrame) -> DataFrame:
    """Per id whether a saved citation equals what was chosen; selectors are compared as JSON values."""
    plain = lambda c: F.to_json(F.try_parse_json(c))
    found = expected.alias("e").join(saved.alias("s"), "id", "left")
    same = F.lit(True)
    for c in ("quote_text", "start_ms", "end_ms"):
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"s.{c}"))
    return found.select("id", (same & plain("e.selector_json").eqNullSafe(plain("s.selector_json"))).alias("matches"))
