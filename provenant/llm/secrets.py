"""Secret scans with an incremental ledger of blobs.

A text is a blob, named by its SHA-256. The ledger (a Parquet folder) has, for each blob and rule version that was ever
scanned, the findings, each named by rule and version (kind@version). A scan looks at the pairs of blob and rule version that the ledger lacks, each blob once (but for rows that
repeat whole) however many paths hold it or held it in earlier versions, appends what it found and joins findings of the versions asked for back to all paths:
what only an older version of a rule found stays in the ledger and is not reported.

Spans are code points, end exclusive. Null texts count as empty. Repeated rows are separate paths to one blob.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm.common import few, map_arrow, new_path, unused, written


class Rule(NamedTuple):
    """`least` is the fewest characters of group `group` (0: of the match); shorter matches are consumed, then dropped.

    `hints`: lower-case strings, one of which any match holds; a quick test only.
    """

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    flags: int = 0
    hints: tuple[str, ...] = ()


#: The base rules. Letters of the key words are ASCII in either case.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, re.IGNORECASE | re.ASCII, ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 18, 0, 0, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]+", 16),
)
#: Further kinds that the scan adds.
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, 0, ("private key-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, 0, 0, ("eyj",)),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]+", 40, 0, 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]+", 20, 0, 0, ("xox",)),
)
RULES = BASE + ADDED
ORDER = {rule.kind: i for i, rule in enumerate(RULES)}
FINDINGS = "array<struct<kind:string,start:int,end:int>>"
#: Most blobs that several rows hold that are broadcast, about 150 bytes each.
MOST_HELD_TWICE = 200_000
LEDGER = f"blob string, versions array<string>, findings {FINDINGS}"


def _matcher(rule: Rule):
    # A run of one class is maximal, so that its least length can stand in the pattern.
    pattern = rule.pattern[:-1] + f"{{{rule.least},}}" if re.fullmatch(r"\[[^\]]*\]\+", rule.pattern) else rule.pattern
    find = re.compile(pattern, rule.flags).finditer

    def spans(text: str, lower: str) -> list[tuple[int, int]]:
        if rule.hints and not any(h in lower for h in rule.hints):
            return []
        return [m.span() for m in find(text) if len(m[rule.group]) >= rule.least]

    return spans


def find(text: str, matchers: list[tuple[str, object]]) -> list[dict]:
    """Findings of the named matchers; a name is a kind or kind@version."""
    lower = text.lower()
    found = [(start, ORDER.get(kind.partition("@")[0], len(ORDER)), kind, end) for kind, spans in matchers for start, end in spans(text, lower)]
    return [{"kind": kind, "start": start, "end": end} for start, _, kind, end in sorted(found)]


def blobs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """path, blob: one row for each row of `docs`."""
    return docs.select(F.col(key).alias("path"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))


def unseen(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """blob, text, kinds: each distinct blob of `docs` that lacks some rule version in the ledger, and the kinds it lacks.

    Which blobs are new, and the least key that holds each, is found on digests alone; only then are texts looked up, those of the holders. So copies aren't scanned again,
    and where little is new few texts move. Of a ledger without rows all blobs are new: then texts stay where they are, and only blobs that several rows hold are looked up.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.sha2(body, 256).alias("blob"), F.col(key).alias("key"))
    texts = docs.select(F.sha2(body, 256).alias("blob"), F.col(key).alias("key"), body.alias("text"))
    versions = F.array(*(F.lit(f"{r.kind}@{r.version}") for r in rules))
    # least key that is not null: a null key may be a great many rows'
    held = named.groupBy("blob").agg(F.min("key").alias("holder"), F.count("*").alias("rows"))
    if not ledger.limit(1).count():
        several = few(written(held.filter("rows > 1").select(F.col("blob").alias("_blob"), "holder"), "held-twice"), MOST_HELD_TWICE)
        met = texts.join(several, F.col("blob") == F.col("_blob"), "left").filter(F.col("_blob").isNull() | F.col("key").eqNullSafe(F.col("holder")))
        return met.select("blob", "text", versions.alias("kinds"))
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("versions"))).alias("seen"))
    wanted = held.join(seen, "blob", "left").withColumn("kinds", F.array_except(versions, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("kinds") > 0)
    wanted = wanted.select(F.col("blob").alias("_blob"), "holder", "kinds")
    return texts.join(wanted, (F.col("blob") == F.col("_blob")) & F.col("key").eqNullSafe(F.col("holder"))).select("blob", "text", "kinds")


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at `path`; one without rows where there is none yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def scan(docs: DataFrame, ledger_path: str, *, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Brings the ledger at `ledger_path` up to date with `docs` (starts it if there is none) and returns path, blob, findings for each row of `docs`.

    Each new blob is scanned once, by the row of its least key. Only rows that repeat whole (key and text) are scanned again, once in each task that holds one.
    """
    spark = docs.sparkSession
    fresh = unseen(docs, _ledger(spark, ledger_path), rules, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = {name: (name, _matcher(r)) for r in rules for name in (f"{r.kind}@{r.version}",)}
        done: set[bytes] = set()
        for batch in batches:
            out = {"blob": [], "versions": [], "findings": []}
            for blob, body, kinds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                short = bytes.fromhex(blob)
                if short in done:
                    continue
                done.add(short)
                out["blob"].append(blob)
                out["versions"].append(kinds)
                out["findings"].append(find(body, [matchers[k] for k in kinds]))
            yield pa.RecordBatch.from_arrays([pa.array(out["blob"], pa.string()), pa.array(out["versions"], pa.list_(pa.string())), pa.array(out["findings"], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))], names=list(out))

    found = fresh.mapInArrow(run, LEDGER)
    found = found.groupBy("blob").agg(F.first("versions").alias("versions"), F.first("findings").alias("findings"))
    found.write.mode("append").parquet(ledger_path)
    return join_back(docs, _ledger(spark, ledger_path), rules, key, text)


def join_back(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """path, blob, findings for each row of `docs`; findings of all rules given, by start, then kind as listed.

    Most blobs hold nothing: only those with findings are joined, so that a text copied a great many times is no hot key unless it has some.
    """
    current = F.array(*(F.lit(f"{r.kind}@{r.version}") for r in rules))
    # ledgers of before have the kind alone: its version is the one that the same row was scanned for
    scanned = F.filter("versions", lambda v: F.substring_index(v, "@", 1) == F.col("f.kind"))
    name = F.when(F.col("f.kind").contains("@"), F.col("f.kind")).otherwise(F.element_at(scanned, 1))
    kind = F.substring_index("f.kind", "@", 1)
    place = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, ORDER.get(r.kind, len(ORDER)))))
    found = (
        ledger.filter(F.size("findings") > 0)
        .select("blob", "versions", F.explode("findings").alias("f"))
        .filter(F.array_contains(current, name))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set(F.struct(F.col("f.start").alias("start"), place[kind].alias("place"), kind.alias("kind"), F.col("f.end").alias("end")))).alias("x"))
        .select("blob", F.transform("x", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("findings"))
    )
    return blobs(docs, key, text).join(found, "blob", "left").select("path", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def kind_count(kind: str, findings: str = "findings") -> Column:
    return F.size(F.filter(findings, lambda f: f["kind"] == kind)).cast("long")


def spans_text(findings: str, kinds: tuple[str, ...] | None = None):
    """kind:start:end, comma-joined."""
    of = F.col(findings) if kinds is None else F.filter(findings, lambda f: f["kind"].isin(*kinds))
    return F.array_join(F.transform(of, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """`docs` with each span (overlapping ones as one) replaced by `mask`; texts without secrets and null texts stay as they are."""
    columns = docs.columns
    at = columns.index(text)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        matchers = [(r.kind, _matcher(r)) for r in rules]
        out = [t if t is None else _masked(t, find(t, matchers), mask) for t in rows.column(at).to_pylist()]
        return rows.set_column(at, rows.schema.field(at), pa.array(out, rows.schema.field(at).type))

    return map_arrow(docs, batch, docs.schema)


def redact_found(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", mask: str = "[secret]") -> DataFrame:
    """As redact(), with blob and findings (one row a blob) from a ledger: a row's text is masked where its blob has findings. Native: no Python.

    Columns of `docs` may have any name.
    """
    blob, spans = unused(docs, "blob"), unused(docs, "findings")
    named = docs.withColumn(blob, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    joined = named.join(found.select(F.col("blob").alias(blob), F.col("findings").alias(spans)), blob, "left")
    # walks the spans from the left: (text so far, position reached)
    masked = F.expr(f"""
        aggregate(`{spans}`, named_struct('out', '', 'at', 0),
          (s, f) -> if(f.start < s.at, named_struct('out', s.out, 'at', greatest(s.at, f.end)),
                       named_struct('out', concat(s.out, substring(`{text}`, s.at + 1, f.start - s.at), '{mask}'), 'at', f.end)),
          s -> concat(s.out, substring(`{text}`, s.at + 1)))
    """)
    return joined.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(masked)).select(*docs.columns)


def _masked(text: str, findings: list[dict], mask: str) -> str:
    out, at = [], 0
    for f in findings:
        if f["start"] >= at:
            out += [text[at : f["start"]], mask]
        at = max(at, f["end"])
    return "".join([*out, text[at:]]) if findings else text


def fresh_ledger(docs: DataFrame) -> str:
    """The path of a ledger that is still to be started."""
    return new_path(docs.sparkSession, "secret-ledger")


def digest_of(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


def oracle_sql() -> str:
    """The same findings in DuckDB's SQL: places come from the lengths of what stands between the matches."""
    any_case = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    words = "|".join(map(any_case, ("password", "passwd", "secret", "token"))) + "|" + any_case("api") + "_?" + any_case("key")
    shown = {rule.kind: rule.pattern for rule in RULES} | {"assign": rf"""({words})["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)"""}
    shown["hex"] = "[0-9a-f]{16,}"  # runs are maximal
    quoted = lambda text: "'" + text.replace("\\'", "'").replace("'", "''") + "'"
    rules = ", ".join(f"({quoted(r.kind)}, {i}, {quoted(shown[r.kind])}, {r.least}, {'true' if r.group else 'false'})" for i, r in enumerate(RULES))
    counts = ", ".join(f"count(*) filter (where kind = {quoted(r.kind)}) as n_{r.kind}" for r in BASE)
    joined = "string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, place)"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
k(kind, place, pattern, least, grouped) as (values {rules}),
m as (select doc_id, kind, place, least, grouped, pattern, regexp_extract_all(t, pattern) as found, regexp_split_to_array(t, pattern) as between_ from d, k),
u as (select *, unnest(range(1, len(found) + 1)) as i from m),
s as (select doc_id, kind, place, length(found[i]) as n, found[i] as hit, pattern, least, grouped,
        cast(list_sum(list_transform(between_[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) as bigint) as a from u),
f as (select * from s where case when grouped then length(regexp_extract(hit, pattern, 2)) else n end >= least),
g as (select doc_id, {counts}, {joined} as spans, {joined.replace(" order by", " order by")} filter (where place < {len(BASE)}) as base from f group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, sha256(d.t) as blob
from d left join g using (doc_id)
"""
