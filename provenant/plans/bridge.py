"""Record-shaped views over the given tables; the same SQL serves Spark and the comparison."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
VIEWS = {
    "ev_events": "select event_id as id, user_id as artifact_id, user_id % 10 as source_id, event_type, ts as ts_start, cast(user_id as varchar(20)) as phone_or_address, value, props as body, concat('e', cast(event_id as varchar(20))) as external_id from {events}",
    "ev_records": "select event_id as id, user_id as artifact_id, event_type, case when event_id % 4 <> 0 then ts end as ts_start, ts as created_at, cast(user_id as varchar(20)) as phone_or_address, props as body from {events}",
    "ev_anchors": "select l_orderkey * 10 + l_linenumber as id, l_orderkey % 1600 as artifact_id, l_returnflag as quote_text from {lineitem}",
    "ev_annotations": "select event_id as id, user_id % 1600 as artifact_id, event_type as kind from {events}",
    "ev_artifacts": "select c_custkey as id, c_name as original_name, case c_mktsegment when 'BUILDING' then 'audio/wav' when 'MACHINERY' then 'video/mp4' else 'text/plain' end as mime_type, c_nationkey as source_id, case when c_custkey % 3 = 0 then c_custkey - 1 end as parent_artifact_id, c_acctbal as size_bytes from {customer}",
    "ev_sources": "select n_nationkey as id, n_name as label, n_regionkey as case_id from {nation} where n_nationkey <> 7",
    "ev_jobs": "select o_orderkey as id, o_custkey as artifact_id, 'transcribe' as kind, case when o_orderpriority like '5%' then 'failed' when o_orderstatus = 'F' then 'done' when o_orderstatus = 'O' then 'queued' else 'running' end as status, cast(substring(o_orderpriority, 1, 1) as int) as priority from {orders}",
    "ev_derived_text": "select o_orderkey as id, o_custkey as artifact_id, 'transcript' as kind, case when o_orderkey % 2 = 0 then 'en' else 'pl' end as language, concat(o_orderpriority, ' ', o_orderstatus) as text, case when o_orderkey % 3 = 0 then o_orderkey end as run_id from {orders} where o_orderstatus = 'F'",
    "ev_runs": "select o_orderkey as id, o_orderkey as job_id, case when o_orderkey % 7 = 0 then o_custkey + 1 else o_custkey end as artifact_id, case when o_orderstatus = 'F' then 'done' else 'failed' end as status, 'x' as lease_token from {orders} where o_orderpriority <> '5-LOW'",
    "ev_segments": "select conv_id + 1 as derived_text_id, turn as segment_index, turn * 1.25e0 as start_s, turn * 1.25e0 + 1.0e0 as end_s, text from {conversations}",
    "ev_docs": "select 'derived_text' as object_kind, doc_id as object_id, source as title, text as content from {documents}",
    "ev_observations": "select l_orderkey * 10 + l_linenumber as observation_id, l_orderkey % 1600 as artifact_id, l_suppkey % 25 as source_id from {lineitem}",
}


def used(sql: str) -> list[str]:
    return [t for t in TABLES if f"{{{t}}}" in sql]


class Bridge:
    """Tables and views of one folder of data; `events` is the view, table("events") what it is made from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        return self.sql(VIEWS[name])

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{t: self.table(t) for t in used(text)})

    def __getattr__(self, name: str) -> DataFrame:
        if f"ev_{name}" in VIEWS:
            return self.view(f"ev_{name}")
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def with_views(body: str) -> str:
    """`body` with the views it names before it, and table names as they are."""
    needed = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    plain = {v: VIEWS[v].format(**{t: t for t in TABLES}) for v in needed}
    views = ", ".join(f"{v} as ({q})" for v, q in plain.items())
    if not views:
        return body
    body = body.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {views}, {body[15:]}"
    return f"with {views}, {body[5:]}" if body.lower().startswith("with ") else f"with {views} {body}"
