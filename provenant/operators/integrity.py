"""Set-based checks of whole snapshots. Each gives rows (code, path, message, group, severity); no rows: nothing wrong."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.sources.files import stream_digests


class Reference(NamedTuple):
    table: str
    column: str
    target: str
    target_column: str = "id"
    optional: bool = False


#: Which columns point at which tables.
REFERENCES = tuple(Reference(*r) for r in [
    ("sources", "case_id", "cases"), ("artifacts", "source_id", "sources", "id", True), ("artifacts", "parent_artifact_id", "artifacts", "id", True),
    ("events", "artifact_id", "artifacts", "id", True), ("events", "source_id", "sources", "id", True), ("derived_text", "artifact_id", "artifacts"), ("derived_text", "run_id", "processing_runs", "id", True),
    ("annotations", "artifact_id", "artifacts", "id", True), ("annotations", "event_id", "events", "id", True), ("annotations", "derived_text_id", "derived_text", "id", True),
    ("artifact_tags", "artifact_id", "artifacts"), ("artifact_tags", "tag_id", "tags"), ("event_tags", "event_id", "events"), ("event_tags", "tag_id", "tags"),
    ("jobs", "artifact_id", "artifacts", "id", True), ("source_observations", "artifact_id", "artifacts"), ("source_observations", "source_id", "sources", "id", True),
    ("processing_runs", "job_id", "jobs", "id", True), ("processing_runs", "artifact_id", "artifacts", "id", True), ("evidence_anchors", "artifact_id", "artifacts"), ("evidence_anchors", "derived_text_id", "derived_text"),
])
#: Kinds of objects that links may name, and their tables.
LINK_TABLES = {"artifact": "artifacts", "event": "events", "derived_text": "derived_text", "annotation": "annotations", "source": "sources", "case": "cases", "job": "jobs", "tag": "tags", "source_observation": "source_observations", "processing_run": "processing_runs", "evidence_anchor": "evidence_anchors", "link": "links"}


def violation(df: DataFrame, code: Column | str, path: Column, message: str, group: str = "relationships", severity: str = "error") -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    return df.select(code.alias("code"), path.alias("path"), F.lit(message).alias("message"), F.lit(group).alias("group"), F.lit(severity).alias("severity"))


def _path(table: str, key: str = "id", column: str | None = None) -> Column:
    return F.concat(F.lit(f"{table}/"), F.coalesce(F.col(key).cast("string"), F.lit("?")), F.lit(f"/{column}" if column else ""))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of the named columns as JSON with nulls kept, in order of name."""
    return F.sha2(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


#: Children of a node in a tree of digests.
FAN = 10_000


def _joined(order: str, fan_digest: str = "d") -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, fan_digest))), lambda x: x[fan_digest]), ""), 256)


def digest_tree(df: DataFrame, key: str = "id", fan: int = FAN) -> DataFrame:
    """level, node, rows, digest, quick: digests of a table's rows by ranges of an integer key, of ranges of ranges, and so on, `fan` wide each; level 1 are ranges of rows, the last level is the root, node 0.

    A node's digest is that of its children's in order; no array is longer than `fan` if keys are unique. Quick ignores order. Levels follow from the least and greatest key, so equal tables have equal trees.
    An empty table has a root over nothing. Rows without a key are in a range of their own, node null, which belongs to the root.
    """
    keyed = df.select(F.col(key).cast("long").alias("k"), row_digest(df.columns).alias("d"))
    least, most = df.agg(F.min(F.col(key).cast("long")), F.max(F.col(key).cast("long"))).first()  # two numbers
    up = lambda c: F.floor(F.col(c) / fan)
    level = keyed.groupBy(up("k").alias("node")).agg(F.count("*").alias("rows"), _joined("k").alias("d"), F.bit_xor(F.xxhash64("d")).alias("q"))
    levels, first, last = [level], *(x // fan if x is not None else 0 for x in (least, most))
    while last - first >= fan:
        level = level.groupBy(up("node").alias("parent")).agg(F.sum("rows").alias("rows"), _joined("node").alias("d"), F.bit_xor("q").alias("q")).withColumnRenamed("parent", "node")
        levels.append(level)
        first, last = first // fan, last // fan
    root = level.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), _joined("node").alias("d"), F.bit_xor("q").alias("q")).withColumn("node", F.lit(0).cast("long"))
    return union([df.select(F.lit(n).alias("level"), "node", "rows", F.col("d").alias("digest"), F.col("q").alias("quick")) for n, df in enumerate([*levels, root], 1)])


def table_digests(tables: dict[str, DataFrame], key: dict[str, str], bucket: int = FAN) -> DataFrame:
    """table, rows, digest, quick: the root of each table's tree of digests."""

    def one(name: str, df: DataFrame) -> DataFrame:
        tree = digest_tree(df, key[name], bucket)
        return tree.groupBy().agg(F.max("level").alias("root"), F.max_by(F.struct("rows", "digest", "quick"), "level").alias("r")).select("r.*").withColumn("table", F.lit(name))

    return union([one(name, df) for name, df in sorted(tables.items())])


def changed_ranges(expected: DataFrame, actual: DataFrame, fan: int = FAN) -> DataFrame:
    """first, last: ranges of keys whose rows differ between two trees. Nodes are compared from the roots down, below a node only where it differs; a tree of other height is compared from where both have nodes.

    Rows without a key differ as the range null.
    """
    heights = [t.agg(F.max("level")).first()[0] or 1 for t in (expected, actual)]
    found: DataFrame | None = None
    for level in range(min(heights) - 1, 0, -1):
        sides = [t.filter(F.col("level") == level).select("node", "digest") for t in (expected, actual)]
        if found is not None:  # children of nodes that differ; null has no children but itself
            parents = found.select(F.col("node").alias("parent"))
            sides = [s.join(parents, F.floor(F.col("node") / fan).eqNullSafe(F.col("parent")), "left_semi") for s in sides]
        e, a = sides[0].alias("e"), sides[1].alias("a")
        met = e.join(a, F.col("e.node").eqNullSafe(F.col("a.node")), "full").filter(~F.col("e.digest").eqNullSafe(F.col("a.digest")))
        found = met.select(F.coalesce("e.node", "a.node").alias("node"))
    return found.select((F.col("node") * fan).alias("first"), ((F.col("node") + 1) * fan - 1).alias("last"))


def changed_rows(expected: DataFrame, actual: DataFrame, ranges: DataFrame, key: str = "id", fan: int = FAN) -> DataFrame:
    """key, change (added, removed, changed): what differs in the ranges that changed_ranges() names. Other rows are dropped before they are digested or shuffled.

    Of rows that share a key all count: their digests are compared as a sorted list.
    """
    wanted = ranges.select(F.col("first").alias("_first"))

    def rows(df: DataFrame, name: str) -> DataFrame:
        at = F.floor(F.col(key).cast("long") / fan) * fan
        near = df.join(wanted, at.eqNullSafe(F.col("_first")), "left_semi")
        return near.select(F.col(key).cast("long").alias("key"), row_digest(df.columns).alias("d")).groupBy("key").agg(F.array_sort(F.collect_list("d")).alias(name))

    e, a = rows(expected, "before").alias("e"), rows(actual, "after").alias("a")
    met = e.join(a, F.col("e.key").eqNullSafe(F.col("a.key")), "full").filter(~F.col("before").eqNullSafe(F.col("after")))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return met.select(F.coalesce("e.key", "a.key").alias("key"), change.alias("change"))


def digest_mismatch(expected: DataFrame, actual: DataFrame) -> DataFrame:
    found = expected.alias("e").join(actual.alias("a"), "table", "full").filter(~F.col("e.digest").eqNullSafe(F.col("a.digest")))
    return violation(found, "table_digest_mismatch", F.col("table"), "rows differ from those that were signed", "digest")


def bad_identity(tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """Keys that are no positive integer, and keys that occur twice."""
    parts = []
    for name, df in sorted(tables.items()):
        own = keys.get(name, ["id"])
        joined = "join_" if len(own) > 1 else ""
        counts = df.groupBy(*own).agg(F.count("*").alias("n"))
        path = F.concat(F.lit(f"{name}/"), F.concat_ws(",", *(F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in own)))
        odd = reduce(lambda a, b: a | b, (F.coalesce(F.col(k).try_cast("bigint"), F.lit(0)) <= 0 for k in own))
        parts += [violation(counts.filter(odd), f"invalid_{joined}identity", path, "a key is a positive integer"), violation(counts.filter("n > 1"), f"duplicate_{joined}identity", path, "a key occurs once")]
    return union(parts)


def broken_references(tables: dict[str, DataFrame], references: tuple[Reference, ...] = REFERENCES, key: dict[str, str] | None = None) -> DataFrame:
    """References to rows that aren't there, and needed ones that are null.

    All references to one table, from whatever columns, go through one anti join with its ids; each table that refers is read once a target.
    """
    key = key or {}
    parts = []
    known = [r for r in references if r.table in tables and r.target in tables]
    for target, column in dict.fromkeys((r.target, r.target_column) for r in known):
        pointers = []
        for table in dict.fromkeys(r.table for r in known if (r.target, r.target_column) == (target, column)):
            own = [r for r in known if (r.table, r.target, r.target_column) == (table, target, column)]
            ends = F.array(*(F.struct(F.col(r.column).cast("long").alias("to"), _path(table, key.get(table, "id"), r.column).alias("path"), F.lit(r.optional).alias("optional")) for r in own))
            pointers.append(tables[table].select(F.explode(ends).alias("p")).select("p.*").filter("to is not null or not optional"))
        pointers = union(pointers)
        there = tables[target].select(F.col(column).cast("long").alias("_there"))
        lost = pointers.join(there, F.col("to") == F.col("_there"), "left_anti")  # a null finds nothing either
        code = F.when(F.col("to").isNull(), "missing_reference").otherwise("broken_reference")
        parts.append(violation(lost, code, F.col("path"), f"a row of {target} is needed"))
    return union(parts)


def content_mismatch(observations: DataFrame, artifacts: DataFrame) -> DataFrame:
    known = artifacts.select(F.col("id").alias("artifact_id"), F.col("sha256").alias("_sha"), F.col("size_bytes").alias("_size"))
    found = observations.join(known, "artifact_id").filter((F.col("sha256") != F.col("_sha")) | (F.col("size_bytes") != F.col("_size")))
    return violation(found, "observation_content_mismatch", _path("source_observations"), "an observation has its artifact's content")


def case_boundaries(artifacts: DataFrame, cases: DataFrame) -> DataFrame:
    """cases (artifact_id, cases ARRAY): artifacts of several cases or none, and parents of another case."""
    of = artifacts.select("id", "parent_artifact_id").join(cases.select(F.col("artifact_id").alias("id"), "cases"), "id", "left")
    parent = cases.select(F.col("artifact_id").alias("parent_artifact_id"), F.col("cases").alias("parent_cases"))
    pairs = of.join(parent, "parent_artifact_id").filter(F.array_sort("cases") != F.array_sort("parent_cases"))
    return union([
        violation(of.filter(F.size("cases") > 1), "cross_case_artifact", _path("artifacts"), "an artifact is of one case"),
        violation(of.filter(F.coalesce(F.size("cases"), F.lit(0)) == 0), "unknown_artifact_case", _path("artifacts"), "no case is known", severity="warning"),
        violation(pairs, "cross_case_parent_artifact", _path("artifacts"), "a parent is of the same case"),
    ])


def event_case_boundaries(events: DataFrame, annotations: DataFrame, sources: DataFrame, derived: DataFrame, cases: DataFrame) -> DataFrame:
    """Events whose source is of another case than their artifact, and annotations whose event's source is of another case than an artifact that they, their event or their text name.

    cases (artifact_id, cases ARRAY) as for case_boundaries(); where a case isn't known nothing is said.
    """
    case = sources.select(F.col("id").alias("source_id"), F.col("case_id").alias("event_case"))
    own = cases.select("artifact_id", "cases")
    cased = events.select(F.col("id").alias("event_id"), "artifact_id", "source_id").join(case.filter("event_case is not null"), "source_id")
    apart = (F.size("cases") > 0) & (F.col("cases") != F.array("event_case"))
    crossed = cased.join(own, "artifact_id").filter(apart)
    texts = derived.select(F.col("id").alias("derived_text_id"), F.col("artifact_id").alias("_text"))
    noted = annotations.select("id", "artifact_id", "event_id", "derived_text_id").join(cased.select("event_id", F.col("artifact_id").alias("_event"), "event_case"), "event_id").join(texts, "derived_text_id", "left")
    named = noted.select("id", "event_case", F.explode(F.array_distinct(F.array_compact(F.array("artifact_id", "_event", "_text")))).alias("artifact_id"))
    noted = named.join(own, "artifact_id").filter(apart).select("id").distinct()
    return union([
        violation(crossed, "cross_case_event", _path("events", "event_id"), "an event's source and artifact are of one case"),
        violation(noted, "cross_case_annotation_event", _path("annotations"), "an annotation's event and artifacts are of one case"),
    ])


def run_consistency(runs: DataFrame, jobs: DataFrame, derived: DataFrame) -> DataFrame:
    of_job = runs.alias("r").join(jobs.alias("j"), F.col("r.job_id") == F.col("j.id")).filter(F.col("j.artifact_id").isNotNull() & ~F.col("r.artifact_id").eqNullSafe(F.col("j.artifact_id"))).select("r.id")
    of_text = derived.alias("d").join(runs.alias("r"), F.col("d.run_id") == F.col("r.id")).filter(~F.col("d.artifact_id").eqNullSafe(F.col("r.artifact_id"))).select("d.id")
    return violation(of_job, "run_job_artifact_mismatch", _path("processing_runs"), "a run is on its job's artifact").unionByName(violation(of_text, "text_run_artifact_mismatch", _path("derived_text"), "a text is of its run's artifact"))


def annotation_targets(annotations: DataFrame, events: DataFrame, derived: DataFrame) -> DataFrame:
    """Annotations whose artifact, event and version are of different artifacts."""
    found = annotations.join(events.select(F.col("id").alias("event_id"), F.col("artifact_id").alias("_event")), "event_id", "left").join(derived.select(F.col("id").alias("derived_text_id"), F.col("artifact_id").alias("_text")), "derived_text_id", "left")
    several = F.size(F.array_distinct(F.array_compact(F.array("artifact_id", "_event", "_text")))) > 1
    return violation(found.filter(several), "annotation_artifact_mismatch", _path("annotations"), "all targets are of one artifact")


def _ends_lost(ends: DataFrame, tables: dict[str, DataFrame], unknown: str, severity: str) -> DataFrame:
    """Of ends (kind, to, path): those of no known kind, and those that aren't there."""
    there = union([df.select(F.lit(kind).alias("kind"), F.col("id").alias("to")) for kind, name in LINK_TABLES.items() if (df := tables.get(name)) is not None])
    known = F.coalesce(F.col("kind").isin(*LINK_TABLES), F.lit(False))
    named = ends.filter(F.col("kind").isNotNull() | F.col("to").isNotNull())
    lost = violation(named.filter(known).join(there, ["kind", "to"], "left_anti"), "broken_object_reference", F.col("path"), "the object isn't there")
    return violation(named.filter(~known), unknown, F.col("path"), "no table holds this kind", severity=severity).unionByName(lost)


def polymorphic_links(links: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Ends of links (left_kind, left_id, right_kind, right_id) of no known kind, or that aren't there."""
    end = lambda side: F.struct(F.col(f"{side}_kind").alias("kind"), F.col(f"{side}_id").alias("to"), F.concat(_path("links"), F.lit(f"/{side}")).alias("path"))
    return _ends_lost(links.select(F.explode(F.array(end("left"), end("right"))).alias("e")).select("e.*"), tables, "unknown_link_target_kind", "error")


def audit_targets(audit: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Objects that audit rows (object_kind, object_id) name: kinds of the domain alone are a warning."""
    return _ends_lost(audit.select(F.col("object_kind").alias("kind"), F.col("object_id").alias("to"), _path("audit_log").alias("path")), tables, "unknown_audit_target_kind", "warning")


def anchor_checks(anchors: DataFrame, versions: DataFrame, derived: DataFrame) -> DataFrame:
    from provenant.operators.citations import verify_anchors

    return violation(verify_anchors(anchors, versions, derived), F.col("code"), _path("evidence_anchors"), "the quote isn't what the version says", "anchors")


def payload_digest(digests: DataFrame, flags: DataFrame) -> DataFrame:
    """payload_sha256 (one row): over the tables' digests in order of name, and the package's flags (one row)."""
    said = F.to_json(F.struct(*sorted(flags.columns)), {"ignoreNullFields": "false"})
    tables = digests.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table", "digest"))), lambda x: F.concat_ws(":", x["table"], x["digest"])), ",").alias("t"))  # a row a table
    return tables.crossJoin(flags.select(said.alias("f"))).select(F.sha2(F.concat("t", F.lit("\n"), "f"), 256).alias("payload_sha256"))  # one row each


def payload_digest_mismatch(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Both have one row (payload_sha256)."""
    found = expected.select(F.col("payload_sha256").alias("e")).crossJoin(actual.select(F.col("payload_sha256").alias("a"))).filter(~F.col("e").eqNullSafe(F.col("a")))
    return violation(found, "payload_digest_mismatch", F.lit("integrity/payload_sha256"), "the package isn't what was signed", "digest")


#: What a package says of itself.
FLAGS = {"metadata_only": True, "source_bytes_included": False, "replay_supported": False, "signed": False}


def package_flags(packages: DataFrame, schema: str, key: str = "id") -> DataFrame:
    """Packages (key, schema, the FLAGS) that claim what they can't do, or are of another schema."""
    codes = F.array_compact(F.array(
        F.when(~F.col("schema").eqNullSafe(schema), F.struct(F.lit("unsupported_schema").alias("code"), F.lit("schema").alias("at"))),
        *(F.when(~F.col(name).eqNullSafe(value), F.struct(F.lit("invalid_capability_flag").alias("code"), F.lit(name).alias("at"))) for name, value in FLAGS.items()),
    ))
    found = packages.select(F.col(key).alias("id"), F.explode(codes).alias("c"))
    return violation(found, F.col("c.code"), F.concat(F.col("id").cast("string"), F.lit("/"), F.col("c.at")), "a package is metadata alone, unsigned and can't be replayed", "digest")


def missing_tables(rows: DataFrame, declared: DataFrame, core: list[str], key: str = "package") -> DataFrame:
    """Of packages: declared (key, name) as missing a table that isn't a core one or that has rows (key, name, rows; errors), or rightly (a warning); core tables with neither rows nor
    declaration are empty, which is fine, if `rows` lists them with 0."""
    there = rows.select(key, "name", F.col("rows").alias("_rows"))
    said = declared.select(key, "name").distinct()
    met = said.join(there, [key, "name"], "left")
    path = F.concat(F.col(key).cast("string"), F.lit("/"), F.coalesce("name", F.lit("?")))
    is_core = F.coalesce(F.col("name").isin(*core), F.lit(False))
    listed = there.select(key).distinct().withColumn("name", F.explode(F.array(*map(F.lit, core))))
    return union([
        violation(met.filter(~is_core), "invalid_missing_tables", path, "only core tables can be declared missing", "schema"),
        violation(met.filter(is_core), "legacy_incomplete_schema", path, "the package is of an older schema", "schema", "warning"),
        violation(met.filter(is_core & (F.col("_rows") > 0)), "contradictory_missing_table", path, "declared missing but there", "schema"),
        violation(listed.join(there, [key, "name"], "left_anti").join(said, [key, "name"], "left_anti"), "missing_or_invalid_table", path, "a core table is there or declared missing", "schema"),
    ])


def inspect_packets(packets: DataFrame) -> DataFrame:
    """Independent re-check of packets (packet_id, payload_json, payload_sha256) by what the payload itself holds.

    Checked are the digest, the ids and references between the parts, the scope, the observations, and the quote rebuilt from the included version by the stored selector.
    """
    from provenant.operators.citations import verify_anchors

    read = packets.select("packet_id", "payload_sha256", F.sha2("payload_json", 256).alias("_sha"), F.from_json("payload_json", PACKET).alias("p"), F.try_parse_json("payload_json").isNotNull().alias("_json"))
    same = lambda a, b: F.col(f"p.{a}").eqNullSafe(F.col(f"p.{b}"))
    positive = lambda c: F.coalesce(F.col(f"p.{c}") > 0, F.lit(False))
    given = lambda c: F.col(f"p.{c}").isNotNull()
    held = lambda f: F.coalesce(F.exists("p.observations", f), F.lit(False))
    claims = F.lit(False)
    for name in ("source_bytes_included", "media_bytes_included", "live_restore_supported", "tasks_imported"):
        claims = claims | ~F.col(f"p.scope.{name}").eqNullSafe(F.lit(False))
    fine = F.col("_json") & given("artifact") & given("version") & given("anchor")
    codes = F.array_compact(F.array(
        F.when(~F.coalesce(fine, F.lit(False)), F.lit("invalid_payload")), F.when(~F.col("_sha").eqNullSafe(F.col("payload_sha256")), F.lit("payload_digest_mismatch")),
        *(F.when(fine & bad, F.lit(code)) for code, bad in (
            ("invalid_identity", ~(positive("artifact.id") & positive("version.id") & positive("anchor.anchor_id"))),
            ("artifact_reference_mismatch", ~(same("artifact.id", "version.artifact_id") & same("artifact.id", "anchor.artifact_id"))),
            ("pinned_version_mismatch", ~same("anchor.derived_text_id", "version.id") | ~F.col("p.version.kind").eqNullSafe("transcript")),
            ("source_reference_mismatch", ~same("artifact.source_id", "source.id")),
            ("run_mismatch", ~same("version.run_id", "run.id") | (given("run") & ~same("artifact.id", "run.artifact_id"))),
            ("observation_mismatch", held(lambda o: F.coalesce(o["observation_id"] <= 0, F.lit(True))) | (F.size(F.array_distinct(F.transform("p.observations", lambda o: o["observation_id"]))) < F.size("p.observations"))),
            ("acquisition_content_mismatch", held(lambda o: (o["sha256"] != F.col("p.artifact.sha256")) | (o["size_bytes"] != F.col("p.artifact.size_bytes")))),
            ("unsupported_scope_claim", claims | ~F.col("p.scope.locators").eqNullSafe("literal_inert_metadata")),
            ("lease_token_included", given("run.lease_token")), ("stored_path_scope_mismatch", given("artifact.stored_path") != F.coalesce(F.col("p.scope.stored_path_included"), F.lit(False))),
        )),
    ))
    path = F.concat(F.lit("packets/"), F.col("packet_id").cast("string"))
    own = violation(read.select("packet_id", F.explode(codes).alias("code")), F.col("code"), path, "the packet doesn't bear itself out", "packets")
    # each packet brings its own version, so packets are told apart by their id, not the version's
    quoted = read.filter(fine).select(F.col("packet_id").alias("id"), F.col("packet_id").alias("derived_text_id"), *(f"p.anchor.{c}" for c in ("quote_text", "quote_sha256", "start_ms", "end_ms", "selector_json")), "p.version.segments_json")
    from provenant.sources.transcripts import parsed_segments

    texts = quoted.select("derived_text_id", F.transform(parsed_segments(F.col("segments_json")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.transform(s["words"], lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["word"].alias("word"))).alias("words"))).alias("segments"))
    rebuilt = verify_anchors(quoted.drop("segments_json"), texts)
    return own.unionByName(violation(rebuilt.withColumnRenamed("id", "packet_id"), F.col("code"), path, "the quote isn't what the included version says", "packets"))


#: The parts of a packet that are checked; others are ignored.
PACKET = (
    "artifact struct<id:bigint,source_id:bigint,sha256:string,size_bytes:bigint,stored_path:string>, version struct<id:bigint,artifact_id:bigint,kind:string,run_id:bigint,segments_json:string>, "
    "source struct<id:bigint>, run struct<id:bigint,artifact_id:bigint,status:string,lease_token:string>, observations array<struct<observation_id:bigint,sha256:string,size_bytes:bigint>>, "
    "anchor struct<anchor_id:bigint,artifact_id:bigint,derived_text_id:bigint,quote_text:string,quote_sha256:string,start_ms:bigint,end_ms:bigint,selector_json:string>, "
    "scope struct<source_bytes_included:boolean,media_bytes_included:boolean,live_restore_supported:boolean,tasks_imported:boolean,locators:string,stored_path_included:boolean>"
)


def fixity_of_files(artifacts: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """Files at stored_path against recorded sha256 and size_bytes: ok, missing, unreadable, bad_record (not read), changed; and digests of chunks. Contents are streamed, so files may have any size."""
    sound = F.coalesce(F.col("sha256"), F.lit("")).rlike("^[0-9a-f]{64}$") & (F.coalesce(F.col("size_bytes"), F.lit(-1)) >= 0)
    rows = artifacts.select("id", "stored_path", "sha256", "size_bytes")
    read = stream_digests(rows.filter(sound), "stored_path", chunk)
    status = F.when(F.col("failure") == "missing", "missing").when(F.col("failure").isNotNull(), "unreadable").when((F.col("digest") == F.col("sha256")) & (F.col("size") == F.col("size_bytes")), "ok").otherwise("changed")
    unread = rows.filter(~sound).select("id", "stored_path", F.lit("bad_record").alias("status"), F.lit(None).cast("array<string>").alias("chunks"))
    return read.select("id", "stored_path", status.alias("status"), "chunks").unionByName(unread)


def fixity_check(files: DataFrame, artifacts: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """Stored bytes (path, content) against recorded sha256 and size: ok, missing, bad_record, changed; and digests of chunks. Contents are in rows, so below 2 GB; fixity_of_files() streams them."""
    found = artifacts.join(files.select(F.col("path").alias("stored_path"), "content"), "stored_path", "left")
    status = F.when(~F.coalesce(F.col("sha256"), F.lit("")).rlike("^[0-9a-f]{64}$"), "bad_record").when(F.col("content").isNull(), "missing").when((F.sha2("content", 256) == F.col("sha256")) & (F.octet_length("content") == F.col("size_bytes")), "ok").otherwise("changed")
    pieces = F.expr(f"transform(sequence(0, greatest(0, octet_length(content) - 1) div {chunk}), i -> sha2(substring(content, cast(i * {chunk} + 1 as int), {chunk}), 256))")
    return found.select("id", "stored_path", status.alias("status"), F.when(F.col("content").isNotNull(), pieces).alias("chunks"))


def append_only_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of `before` that `after` lacks or has changed."""
    return before.exceptAll(after.select(*before.columns))


def audit_rows(ops: DataFrame, action: str, object_kind: str, object_id: str, *details: str) -> DataFrame:
    return ops.select(F.lit(action).alias("action"), F.lit(object_kind).alias("object_kind"), F.col(object_id).alias("object_id"), F.to_json(F.struct(*details)).alias("details_json"))
