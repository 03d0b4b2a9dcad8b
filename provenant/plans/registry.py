"""Queries over the given tables and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenant.functions import scalars as S
from provenant.operators import aggregates as A
from provenant.operators import citations as G
from provenant.operators import index as X
from provenant.operators import integrity as I
from provenant.operators import joins as J
from provenant.operators import pages as P
from provenant.operators import search as H
from provenant.operators import sets, windows
from provenant.plans import folders
from provenant.plans.bridge import Bridge, with_views
from provenant.sources import delimited, messages, packages, transcripts
from provenant.streaming import leases

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a Bridge under its name, with its SQL."""

    def add(f: Callable[[Bridge], DataFrame]) -> Callable[[Bridge], DataFrame]:
        _queries[f.__name__] = lambda spark, sf_dir: f(Bridge(spark, sf_dir))
        _queries[f.__name__].__name__ = f.__name__
        if sql is not None:
            _sql[f.__name__] = with_views(sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from provenant.plans import round_trips  # noqa: F401  registers its own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql) if queries() else {}


# --- sources ---


@query(r"""with x as (select doc_id, regexp_split_to_array(text, '\r\n|[\n\r]')  as l from documents where text is not null),
  u as (select doc_id, unnest(range(1, least(len(l), 5) + 1)) as i, l from x), w as (select doc_id, d, len(string_split(l[i], d)) as w from u, (values (','), (';'), ('|')) v(d)),
  f as (select doc_id, d, min(w) as lo, max(w) as hi from w group by all),
  g as (select doc_id, count(*) filter (where lo = hi and lo > 1) as n, max(case when lo = hi and lo > 1 then d end) as d from f group by doc_id)
  select doc_id, case when n = 1 then d else ',' end as delimiter, case when n = 1 then 'accepted' else 'ambiguous' end as status from g""")
def a04_infer_delimiter(b):
    lines = b.documents.select("doc_id", F.posexplode(F.split("text", r"\r\n|[\n\r]")).alias("i", "line"))
    return delimited.infer_delimiter(delimited.first_lines(lines, 5, "doc_id"), "doc_id", "line", (",", ";", "|"))


CHAT = """select conv_id as file, case when turn % 3 = 2 then text else concat(cast(1 + conv_id % 28 as varchar(3)), '/', cast(1 + turn % 12 as varchar(3)), '/2024, ', cast(10 + turn as varchar(3)), ':30 - ', role, ': ', text) end as line, turn from {conversations}"""


@query(f"""with t as ({CHAT.format(conversations="conversations")}), l as (select file, turn, unnest(regexp_split_to_array(line, '\\r\\n|[\\n\\r]')) as line, unnest(range(len(regexp_split_to_array(line, '\\r\\n|[\\n\\r]')))) as i from t where line is not null), r as (select *, row_number() over (partition by file order by turn, i) as rn from l),
  h as (select *, regexp_matches(line, '^[0-9]+/[0-9]+/2024, ') as header from r), m as (select *, sum(case when header then 1 else 0 end) over (partition by file order by rn) as message_no from h)
  select file, message_no, min(rn) as line_start, max(rn) as line_end, max(case when header then regexp_extract(line, ' - ([^:]+): ', 1) end) as sender,
  string_agg(case when header then regexp_replace(line, '^[^:]+:[0-9]+ - [^:]+: ', '') else line end, chr(10) order by rn) as body from m group by file, message_no""")
def a09_chat_messages(b):
    lines = b.sql(CHAT).filter("line is not null")
    texts = lines.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return messages.chat_messages(texts).select("file", F.col("message_no"), "line_start", "line_end", "sender", "body")


@query("select derived_text_id, cast(segment_index as int) as segment_index, start_s, end_s, text from ev_segments")
def a11_explode_segments(b):
    rows = b.segments.groupBy("derived_text_id").agg(F.array_sort(F.collect_list(F.struct("segment_index", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text"))).alias("s"))
    stored = rows.select(F.col("derived_text_id").alias("id"), F.to_json(F.transform("s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))).alias("segments_json"))
    return transcripts.explode_segments(stored).select("derived_text_id", "segment_index", "start_s", "end_s", "text")


@query("select 'artifacts' as table_name, row_number() over (order by id) - 1 as ordinal, original_name from ev_artifacts union all select 'jobs', row_number() over (order by id) - 1, status from ev_jobs")
def a16_archive_rows(b):
    rows = packages.archive_rows({"artifacts": b.artifacts, "jobs": b.jobs}, {"artifacts": "id", "jobs": "id"})
    value = F.when(F.col("table_name") == "artifacts", F.get_json_object("row_json", "$.original_name")).otherwise(F.get_json_object("row_json", "$.status"))
    return rows.select("table_name", F.col("ordinal").cast("long"), value.alias("original_name"))


# --- scalar functions ---

RAW_MS = "case when id % 11 = 0 then '' when id % 7 = 0 then 'bad' when id % 5 = 0 then '99999999999999999' when id % 13 = 0 then null else concat(' ', cast(id * 86400123 as varchar(30))) end"


@query(f"""with r as (select id, {RAW_MS} as raw from ev_events), n as (select id, raw, try_cast(trim(raw) as bigint) as ms from r)
  select id, case when ms between -62135596800000 and 253402300799999 then epoch_ms(ms) end as ts,
  case when raw is null or trim(raw) = '' then 'missing' when ms between -62135596800000 and 253402300799999 then 'parsed' else 'invalid' end as status from n""")
def b01_epoch_ms_ts(b):
    return b.events.select("id", S.epoch_ms_ts(F.expr(RAW_MS)).alias("t")).select("id", F.col("t.ts").cast("timestamp_ntz").alias("ts"), "t.status")


CHAT_TIME = "select id, id % 33 as d, id % 14 as m, case when id % 4 = 0 then 24 else 2024 end as y, id % 26 as h, id % 61 as mi, case when id % 3 = 0 then 'p.m.' when id % 3 = 1 then 'AM' else '' end as ap from ev_events"


@query(f"""with r as ({CHAT_TIME}), q as (select *, case when ap = '' then h when h between 1 and 12 then h % 12 + case when ap = 'p.m.' then 12 else 0 end end as h24 from r),
  p as (select *, case when h24 <= 23 and mi <= 59 then try_cast(printf('%04d-%02d-%02d %02d:%02d:00', case when y = 24 then 2000 else y end, m, d, h24, mi) as timestamp) end as t from q)
  select id, case when y = 2024 then t end as ts, case when t is null then 'invalid' when y = 24 then 'unknown_century' else 'parsed_local_time' end as status,
  (t is not null and y = 2024 and d <= 12 and m <= 12 and d <> m) as ambiguous from p""")
def b02_chat_ts(b):
    r = b.events.select("id", *(F.expr(e) for e in ("id % 33 as d", "id % 14 as m", "case when id % 4 = 0 then 24 else 2024 end as y", "id % 26 as h", "id % 61 as mi", "case when id % 3 = 0 then 'p.m.' when id % 3 = 1 then 'AM' else '' end as ap")))
    t = S.chat_ts(F.concat_ws("/", "d", "m", "y"), F.format_string("%d:%02d", "h", "mi"), F.col("ap"))
    return r.select("id", F.explode(F.array(t)).alias("t")).select("id", "t.*")  # exploded, so that a text is taken apart once


ISO_TEXT = "case when id % 5 = 0 then cast(cast(ts_start as date) as varchar(10)) when id % 5 = 1 then concat(cast(cast(ts_start as date) as varchar(10)), 'T10:30Z') when id % 5 = 2 then concat(cast(cast(ts_start as date) as varchar(10)), ' 10:30:05+02:00') when id % 5 = 3 then '2024-02-31' else 'soon' end"


@query(f"""with r as (select id, {ISO_TEXT} as raw from ev_events), p as (select id, raw, case when regexp_matches(raw, '^[0-9-]+$') then try_cast(raw as timestamp) when raw <> 'soon' then try_cast(replace(substr(raw, 1, case when raw like '%Z' then 16 else 19 end), 'T', ' ') || case when raw like '%Z' then ':00' else '' end as timestamp) end as local from r)
  select id, local, case when local is null then 'unknown' when raw like '%Z' then '+00:00' when raw like '%+02:00' then '+02:00' else 'unknown' end as timezone, case when local is null then 'unparsed' else 'iso_or_typed_datetime' end as interpretation from p""")
def b03_iso_ts(b):
    return b.events.select("id", S.iso_ts(F.expr(ISO_TEXT)).alias("t")).select("id", "t.*")


DURATION = "case when id % 4 = 0 then concat(cast(id % 30 as varchar(5)), ':', lpad(cast(id % 70 as varchar(5)), 2, '0'), ':05') when id % 4 = 1 then concat(cast(id % 100 as varchar(5)), ',5') when id % 4 = 2 then '-3' else 'long' end"
DURATION_HEAD = "case when id % 3 = 0 then 'Duration (ms)' when id % 3 = 1 then 'Seconds' else 'Length' end"


@query(f"""with r as (select id, {DURATION} as v, {DURATION_HEAD} as h from ev_events), c as (select *, case when v like '%:%' and cast(string_split(v, ':')[2] as int) < 60 then cast(string_split(v, ':')[1] as double) * 3600 + cast(string_split(v, ':')[2] as double) * 60 + 5 end as t,
  case h when 'Duration (ms)' then 'milliseconds' when 'Seconds' then 'seconds' end as u, try_cast(replace(v, ',', '.') as double) as n from r)
  select id, case when t is not null then t when u is not null and n >= 0 then case when u = 'milliseconds' then n / 1000 else n end end as seconds, case when t is not null then 'hh:mm:ss' when u is not null and n >= 0 then u else 'unknown' end as unit from c""")
def b04_duration_view(b):
    return b.events.select("id", S.duration_view(F.expr(DURATION), F.expr(DURATION_HEAD)).alias("d")).select("id", "d.*")


CALL = "case when id % 5 = 0 then null when id % 5 = 1 then '' when id % 5 = 2 then 'x' when id % 5 = 3 then '-4' else cast(id % 4000 as varchar(10)) end"


@query(f"""with r as (select id, ts_start, {CALL} as d from ev_events) select id, case when d is not null and regexp_matches(d, '^[0-9]+$') then date_trunc('millisecond', ts_start) + to_seconds(cast(d as bigint)) end as ts_end,
  case when d is null or d = '' then 'duration_missing' when not regexp_matches(d, '^[0-9]+$') then 'duration_invalid' end as issue from r""")
def b05_call_end(b):
    return b.events.select("id", S.call_end(F.col("ts_start").cast("timestamp"), F.expr(CALL)).alias("c")).select("id", F.col("c.ts_end").cast("timestamp_ntz").alias("ts_end"), "c.issue")


HEADER = "case id % 6 when 0 then 'Phone Number' when 1 then 'Data połączenia' when 2 then 'długość' when 3 then 'Nagranie' when 4 then 'KONTAKT' else 'Café' end"


@query(f"""with r as (select id, {HEADER} as header from ev_events) select id, header, case header when 'Phone Number' then 'phone' when 'Nagranie' then 'file_reference' when 'KONTAKT' then 'contact_label' end as header_kind from r""")
def b06_header_kind(b):
    return S.header_kind(b.events.select("id", F.expr(HEADER).alias("header")), "header").select("id", "header", "header_kind")


@query(r"""with w as (select doc_id, unnest(regexp_split_to_array(text, '[\n]')) as line from documents), c as (select doc_id, line, regexp_replace(line, '[ \t().-]', '', 'g') as s from w)
  select doc_id, count(*) as lines, count(case when not contains(line, '@') and regexp_matches(s, '^\+?[0-9]{6,15}$') then 1 end) as phones from c group by doc_id""")
def b07_phone_candidate(b):
    lines = b.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count(S.phone_candidate(F.col("line"))).alias("phones"))


FILE_NAME = "concat('rec_', cast(2019 + id % 8 as varchar(4)), '-', lpad(cast(id % 14 as varchar(2)), 2, '0'), '-', lpad(cast(id % 32 as varchar(2)), 2, '0'), ' call +48', cast(100000000 + id as varchar(10)))"


@query(f"""with r as (select id, {FILE_NAME} as name from ev_events), x as (select id, name, regexp_extract(name, '20[0-9][0-9]-[0-9][0-9]-[0-9][0-9]') as s from r), d as (select *, try_cast(s as date) as t from x where s like '20%')
  select id, 4 as start, cast(s as varchar) as text, cast(t as varchar) as normalized from d where t is not null""")
def b08_filename_timestamps(b):
    names = b.events.select("id", S.filename_timestamps(F.expr(FILE_NAME)).alias("t"))
    return names.select("id", F.explode("t").alias("t")).select("id", "t.start", "t.text", "t.normalized")


@query(f"""with r as (select id, {FILE_NAME} as name from ev_events), p as (select id, name, regexp_extract(name, '\\+48[0-9]+') as text from r), d as (select *, try_cast(regexp_extract(name, '20[0-9][0-9]-[0-9][0-9]-[0-9][0-9]') as date) as t from p)
  select id, text from d where t is not null""")
def b09_filename_phones(b):
    # no filter between the two: both are read in one step, by one Python worker a task
    r = b.events.select("id", F.expr(FILE_NAME).alias("name")).withColumns({"t": S.filename_timestamps("name"), "spans": S.phone_spans("name")})
    return r.select("id", F.explode(F.when(F.size("t") > 0, S.apart(F.col("spans"), F.col("t")))).alias("p")).select("id", "p.text")


@query("select derived_text_id, segment_index, cast(round_even((start_s + 0.0005) * 1000, 0) as bigint) as start_ms, cast(round_even(end_s * 1000, 0) as bigint) as end_ms, sha256(text) as text_sha256 from ev_segments")
def b10_to_ms(b):
    return b.segments.select("derived_text_id", "segment_index", S.to_ms(F.col("start_s") + F.lit(0.0005)).alias("start_ms"), S.to_ms(F.col("end_s")).alias("end_ms"), S.text_sha256(F.col("text")).alias("text_sha256"))


@query("select doc_id, sha256(text) as text_sha256 from documents")
def b11_text_sha256(b):
    return b.documents.select("doc_id", S.text_sha256(F.col("text")).alias("text_sha256"))


@query("select id, replace(body, ' ', '') as canonical from ev_events")
def b12_canonical_json(b):
    return b.events.select("id", S.canonical_json("body").alias("canonical"))


CODE = "cast(id % 7 as varchar(2))"
CALL_KIND = "case when id % 2 = 0 then 'call' else 'sms' end"


@query(f"select id, case when id % 2 = 0 then case {CODE} when '1' then 'incoming' when '2' then 'outgoing' when '3' then 'missed' when '5' then 'rejected' else {CODE} end else case {CODE} when '1' then 'incoming' when '2' then 'outgoing' else {CODE} end end as direction from ev_events")
def b13_direction(b):
    return b.events.select("id", S.direction(F.expr(CODE), F.expr(CALL_KIND)).alias("direction"))


MEDIA_NAME = "concat(original_name, case id % 5 when 0 then '.WAV' when 1 then '.csv' when 2 then '.mp4' when 3 then '.bin' else '' end)"


@query(f"""select id, case id % 5 when 0 then 'audio' when 1 then 'table' when 2 then 'video' else case when mime_type like 'audio/%' then 'audio' when mime_type like 'video/%' then 'video' else 'other' end end as kind,
  case id % 5 when 0 then 'audio/x-wav' when 1 then 'text/csv' when 2 then 'video/mp4' else 'application/octet-stream' end as mime from ev_artifacts""")
def b14_file_kind(b):
    return b.artifacts.select("id", S.file_kind(F.expr(MEDIA_NAME), F.col("mime_type")).alias("kind"), S.mime_guess(F.expr(MEDIA_NAME)).alias("mime"))


@query("select id, concat_ws(' | ', nullif(event_type, ''), case when id % 2 = 0 then 'x' end, nullif(phone_or_address, '')) as title from ev_events")
def b15_event_title(b):
    return b.events.select("id", S.event_title(F.col("event_type"), F.when(F.col("id") % 2 == 0, "x").otherwise(""), F.col("phone_or_address")).alias("title"))


@query("select doc_id, substr(text, 1, 240) as text, length(text) > 240 as truncated from documents")
def b16_preview(b):
    return b.documents.select("doc_id", S.preview(F.col("text"), 240).alias("p")).select("doc_id", "p.*")


@query("select id, greatest(0, least(100, priority * 30 - 20)) * 10000 + case when id % 3 = 0 then 600 else 0 end + case when id % 4 = 0 then 400 else 0 end + case when id % 7 = 0 then 100 else 0 end + case when artifact_id >= 1200 then 180 when artifact_id >= 300 then 120 when artifact_id >= 60 then 60 else 0 end as score from ev_jobs")
def b17_priority_score(b):
    return b.jobs.select("id", S.priority_score(F.col("priority") * 30 - 20, F.col("artifact_id"), F.col("id") % 7 == 0, F.col("id") % 4 == 0, F.col("id") % 3 == 0).cast("long").alias("score"))


JSON_TEXT = "case when id % 4 = 1 then replace(body, '}', '') when id % 4 = 2 then replace(body, '}', ', \"k\": 1}') when id % 4 = 3 then '[[[[1]]]]' else body end"


@query("select id, case id % 4 when 1 then 'invalid' when 2 then 'invalid' when 3 then 'too_deep' else 'valid' end as status from ev_events")
def b18_strict_json_status(b):
    return b.events.select("id", S.strict_json_status(F.expr(JSON_TEXT), 4).alias("status"))


@query("select page_id, list_extract(string_split(url, '/'), -1) as name from pages")
def b19_basename(b):
    return b.pages.select("page_id", S.basename(F.when(F.col("page_id") % 2 == 0, F.replace("url", F.lit("/"), F.lit("\\"))).otherwise(F.col("url"))).alias("name"))


@query("select doc_id, coalesce(contains(lower(text), 'licensed under'), false) as found from documents")
def b20_contains_ci(b):
    return b.documents.select("doc_id", S.contains_ci(F.col("text"), F.lit("Licensed UNDER")).alias("found"))


@query("select id, id % 3 = 0 as matches from ev_artifacts")
def b21_email_domain(b):
    email = F.concat(F.col("original_name"), F.when(F.col("id") % 3 == 0, "@Example.ORG").when(F.col("id") % 3 == 1, "@sub.example.org").otherwise(""))
    return b.artifacts.select("id", S.email_domain_match(email, ["example.org"]).alias("matches"))


@query("select doc_id, cast(coalesce(strlen(text), 0) + coalesce(strlen(lang), 0) + coalesce(strlen(source), 0) as bigint) as bytes from documents")
def b22_row_bytes(b):
    return b.documents.select("doc_id", S.row_bytes(F.col("text"), F.col("lang"), F.col("source")).alias("bytes"))


ODD = "case when id % 5 = 0 then cast('NaN' as double) when id % 5 = 1 then cast('Infinity' as double) when id % 5 = 2 then cast('-Infinity' as double) else value end"


@query("select id, case when id % 5 > 2 then value end as value, case id % 5 when 0 then 'nan' when 1 then 'inf' when 2 then '-inf' end as representation, id % 5 <= 2 as non_finite from ev_events")
def b23_json_scalar(b):
    return b.events.select("id", S.json_scalar(F.expr(ODD)).alias("v")).select("id", "v.*")


@query("select conv_id, coalesce(string_agg(text, chr(10) order by turn) filter (where role = 'user' and text <> ''), '') as body from conversations group by conv_id")
def b24_mms_body(b):
    part = F.struct("turn", F.when(F.col("role") == "user", "text/plain").otherwise("image/png").alias("ct"), "text")
    parts = b.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return parts.select("conv_id", S.sms_mms_body(F.col("parts")).alias("body"))


@query("select id, case when id % 3 = 0 or id % 3 = 1 then 'unknown' else mime_type end as tool from ev_artifacts")
def b25_unknown_if_blank(b):
    return b.artifacts.select("id", S.unknown_if_blank(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "").otherwise(F.col("mime_type"))).alias("tool"))


# --- lists and pages ---


@query("select id, ts_start from ev_records where event_type = 'click' order by coalesce(ts_start, created_at) desc, id desc limit 500")
def c01_timeline(b):
    return P.timeline(b.records, event_type="click").select("id", "ts_start")


@query("select id, original_name from ev_artifacts order by id desc limit 30")
def c02_recent_artifacts(b):
    return P.recent_artifacts(b.artifacts).select("id", "original_name")


@query("select id, substr(body, 1, 240) as preview from ev_records order by coalesce(ts_start, created_at) desc, id desc limit 30")
def c02_recent_events(b):
    return P.recent_events(b.records).select("id", "preview")


@query("select id, row_number() over (order by ts_start, id) as place, (select count(*) from ev_events where artifact_id = 7) > 10 as has_more from ev_events where artifact_id = 7 order by ts_start, id limit 10")
def c03_artifact_events(b):
    return P.artifact_events(b.events, 7, 10).select("id", "place", "has_more")


@query("select id, row_number() over (order by id) as place, (select count(*) from ev_jobs) > 20 as has_more from ev_jobs order by id limit 20")
def c04_limit_with_more(b):
    return P.limit_with_more(b.jobs, 20, F.col("id")).select("id", "place", "has_more")


@query("select artifact_id, id, place, snapshot_max_id, has_more from (select artifact_id, id, row_number() over (partition by artifact_id order by id desc) as place, max(id) over (partition by artifact_id) as snapshot_max_id, count(*) over (partition by artifact_id) > 5 as has_more from ev_events) where place <= 5")
def c05_first_pages(b):
    return P.first_pages(b.events, 5).select("artifact_id", "id", "place", "snapshot_max_id", "has_more")


@query("select id from ev_events where artifact_id = 3 and id <= 5000 and id < 4000 order by id desc limit 50")
def c05_keyset_page(b):
    return P.keyset_page(b.events, 3, 50, 4000, 5000).select("id")


BUDGET = """with s as (select o_custkey as artifact_id, o_orderkey as id, strlen(o_orderpriority) * 10 as n from orders),
  r as (select *, sum(n) over w as running, count(*) over w as place from s window w as (partition by artifact_id order by id desc rows unbounded preceding)),
  f as (select *, case when n > {row} then 'row_bytes' when running > {page} then 'page_bytes' {items} end as why from r),
  c as (select artifact_id, min(place) as first_bad, arg_min(why, place) as cut from f where why is not null group by artifact_id)
  select f.artifact_id, f.id, cast(f.running as bigint) as running, c.cut from f left join c using (artifact_id) where first_bad is null or place < first_bad"""


@query(BUDGET.format(row=145, page=900, items=""))
def c06_byte_budget_page(b):
    rows = b.orders.select(F.col("o_custkey").alias("artifact_id"), F.col("o_orderkey").alias("id"), "o_orderpriority")
    return P.byte_budget_page(rows, S.row_bytes(F.col("o_orderpriority")) * 10, 145, 900).select("artifact_id", "id", "running", "cut")


@query(BUDGET.format(row=800, page=800, items="when place > 7 then 'items'"))
def c07_retention_budget(b):
    rows = b.orders.select(F.col("o_custkey").alias("artifact_id"), F.col("o_orderkey").alias("id"), "o_orderpriority")
    return P.retention_budget(rows, S.row_bytes(F.col("o_orderpriority")) * 10, 7, 800).select("artifact_id", "id", "running", "cut")


CHAIN = "select o_custkey as chain, cast(1 as int) as page, o_orderkey as place, case when o_orderkey % 5 = 0 then o_orderkey else 100000000 - o_orderkey end as id, o_custkey as artifact_id, case when o_orderkey % 17 = 0 then o_custkey + 1 else o_custkey end as owner, cast(case when o_orderkey % 23 = 0 then 99999000 else 100000000 end as bigint) as snapshot_max_id from {orders}"


@query(f"""with p as ({CHAIN.format(orders="orders")}), q as (select *, lag(id) over w as prev, first_value(snapshot_max_id) over w as snap from p window w as (partition by chain order by page, place))
  select chain, page, place, id, 'not_descending' as code from q where id >= prev union all select chain, page, place, id, 'outside_snapshot' from q where id > snapshot_max_id
  union all select chain, page, place, id, 'foreign_row' from q where artifact_id <> owner union all select chain, page, place, id, 'snapshot_changed' from q where snapshot_max_id <> snap""")
def c08_validate_page_chain(b):
    return P.validate_page_chain(b.sql(CHAIN))


@query("select s_suppkey as public_id, s_name as label from supplier where contains(lower(s_name), '00001') or contains(cast(s_suppkey as varchar), '00001')")
def c09_contacts(b):
    rows = b.supplier.select(F.col("s_suppkey").cast("string").alias("public_id"), F.col("s_name").alias("label"), F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("backup_name"), F.col("s_acctbal").alias("interactions"))
    return P.contacts(rows, "00001").select(F.col("public_id").cast("long"), "label")


MESSAGES = "select id, phone_or_address as phone, case when id % 9 = 0 then 'Bank Info' else event_type end as contact, case when id % 11 = 0 then 'INFO' else null end as sender, cast(ts_start as varchar(30)) as t from ev_events"


@query(f"with m as ({MESSAGES}) select id, phone from m where cast(phone as bigint) % 10 = 3 or sender = 'INFO' or contains(lower(coalesce(contact, '')), 'bank')")
def c10_select_messages(b):
    e = b.events.select("id", F.col("phone_or_address").alias("phone"), F.when(F.col("id") % 9 == 0, "Bank Info").otherwise(F.col("event_type")).alias("contact"), F.when(F.col("id") % 11 == 0, "INFO").alias("sender"), F.col("ts_start").cast("string").alias("t"))
    phones = e.filter(F.col("phone").cast("long") % 10 == 3).select("phone")
    return P.select_messages(e.filter("id % 2 = 0"), e.filter("id % 2 = 1"), phones, ["INFO"], ["bank"]).select("id", "phone")


CALLS = "select id, phone_or_address as phone, case when id % 9 = 0 then 'Bank Info' end as contact, cast(ts_start as varchar(30)) as t from ev_events"


@query(f"with m as ({CALLS}) select id, phone from m where cast(phone as bigint) % 10 = 3 or contact is not null")
def c10_select_calls(b):
    calls = b.events.select("id", F.col("phone_or_address").alias("phone"), F.when(F.col("id") % 9 == 0, "Bank Info").alias("contact"), F.col("ts_start").cast("string").alias("t"))
    return P.select_calls(calls, calls.filter(F.col("phone").cast("long") % 10 == 3).select("phone"), ["bank"]).select("id", "phone")


@query(f"with m as ({CALLS}), r as (select id, phone, row_number() over (order by coalesce(case when id % 3 = 0 then t end, case when id % 5 <> 0 then t end, '') desc, id desc) as place from m where cast(phone as bigint) % 10 = 3 or contact is not null) select id, phone, place from r where place <= 50")
def c10_select_recordings(b):
    t = F.col("ts_start").cast("string")
    rows = b.events.select("id", F.col("phone_or_address").alias("phone"), F.when(F.col("id") % 9 == 0, "Bank Info").alias("contact"), F.when(F.col("id") % 3 == 0, t).alias("resolved_time"), F.when(F.col("id") % 5 != 0, t).alias("call_start"))
    newest = P.select_recordings(rows, rows.filter(F.col("phone").cast("long") % 10 == 3).select("phone"), ["bank"]).limit(50)
    place = F.row_number().over(Window.orderBy(F.desc(F.coalesce("resolved_time", "call_start", F.lit(""))), F.desc("id")))  # over 50 rows
    return newest.select("id", "phone", place.alias("place"))


@query("select lower(original_name || '@' || case when id % 2 = 0 then 'a.org' else 'b.org' end) as email from ev_artifacts where id % 2 = 0 or id = 5")
def c10_select_emails(b):
    rows = b.artifacts.select(F.concat("original_name", F.lit("@"), F.when(F.col("id") % 2 == 0, "A.org").otherwise("b.org")).alias("email"))
    return P.select_emails(rows, ["customer#000000005@b.org"], ["a.org"])


@query("select id, original_name from ev_artifacts where mime_type like 'audio/%' and contains(lower(original_name), '7')")
def c11_scan_files(b):
    files = b.artifacts.withColumn("kind", S.file_kind(F.col("original_name"), F.col("mime_type"))).withColumn("path", F.col("original_name"))
    return P.scan_files(files, True, "7").select("id", "original_name")


@query("""with r as (select source as file, doc_id as row, row_number() over (partition by source order by doc_id) as n from documents), c as (select file, count(*) as n, least(count(*), 40) as own from r group by file),
  k as (select file, greatest(0, least(own, 500 - coalesce(sum(own) over (order by file rows between unbounded preceding and 1 preceding), 0))) as room from c) select r.file, r.row from r join k using (file) where r.n <= k.room""")
def c12_cap_rows(b):
    return P.cap_rows(b.documents.select(F.col("source").alias("file"), F.col("doc_id").alias("row")), 40, 500)[0]


@query("select doc_id, substr(text, 1, 100) as value, length(text) <= 100 as complete from documents")
def c13_truncate_cells(b):
    return P.truncate_cells(b.documents.select("doc_id", F.col("text").alias("value")), 100).select("doc_id", "value", "complete")


@query("select doc_id, 'cell_character_limit' as code, length(text) as characters from documents where length(text) > 100")
def c13_truncated_cells(b):
    return P.truncated_cells(b.documents.select("doc_id", F.col("text").alias("value")), 100, "doc_id")


@query('select l_orderkey as table_id, l_linenumber as "column", max(l_linenumber) over (partition by l_orderkey) <= 4 as table_complete from lineitem qualify l_linenumber <= 4')
def c14_cap_columns(b):
    return P.cap_columns(b.lineitem.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("column")), 4)


@query("""with w as (select o_custkey as table_id, o_orderkey as k, count(*) as width from orders join lineitem on o_orderkey = l_orderkey group by all), r as (select *, row_number() over (partition by table_id order by k) - 1 as row from w)
  select d.table_id, d.row, d.width, h.width as header_width from r d join r h on d.table_id = h.table_id and h.row = 0 where d.row > 0 and d.width <> h.width""")
def c15_row_width_mismatch(b):
    j = b.orders.join(b.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("table_id"), "o_orderkey", F.col("l_linenumber").alias("column"))
    rows = j.select("table_id", "o_orderkey").distinct()
    rows = windows.ordinals(rows, "table_id", "o_orderkey").withColumnRenamed("ordinal", "row")
    return P.row_width_mismatch(j.join(rows, ["table_id", "o_orderkey"])).select("table_id", F.col("row").cast("long"), "width", "header_width")


@query("select id, language, text from ev_derived_text where artifact_id = (select max(artifact_id) from ev_derived_text)")
def c16_list_versions(b):
    newest = b.derived_text.agg(F.max("artifact_id")).first()[0]  # one number
    return P.list_versions(b.derived_text, newest).select("id", "language", "text")


@query("select id, place from (select observation_id as id, row_number() over (order by observation_id) as place from ev_observations where artifact_id = 3)")
def c16_list_observations(b):
    rows = b.observations.withColumnRenamed("observation_id", "id")
    return windows.ordinals(P.list_observations(rows, 3), "artifact_id", "id").select("id", (F.col("ordinal") + 1).cast("long").alias("place"))


@query("select id, quote_text from ev_anchors where artifact_id = 3")
def c16_list_citations(b):
    return P.list_citations(b.anchors, 3).select("id", "quote_text")


@query("select id, kind from ev_annotations where artifact_id = 3")
def c16_list_annotations(b):
    return P.list_annotations(b.annotations, 3).select("id", "kind")


# --- joins ---


@query("select a.id, a.original_name, s.label as source_label from ev_artifacts a left join ev_sources s on a.source_id = s.id")
def d01_artifact_with_source(b):
    return J.artifact_with_source(b.artifacts, b.sources).select("id", "original_name", "source_label")


@query("""select a.id, a.original_name, a.mime_type,
  case when exists (select 1 from ev_jobs j where j.artifact_id = a.id and j.status = 'running') then 'running' when exists (select 1 from ev_jobs j where j.artifact_id = a.id and j.status = 'queued') then 'queued'
  when (select status from ev_jobs j where j.artifact_id = a.id order by j.id desc limit 1) = 'failed' then 'failed' when exists (select 1 from ev_derived_text d where d.artifact_id = a.id) then 'done' else 'none' end as status,
  (select language from ev_derived_text d where d.artifact_id = a.id order by d.id desc limit 1) as language, (select substr(text, 1, 400) from ev_derived_text d where d.artifact_id = a.id order by d.id desc limit 1) as preview,
  (select priority from ev_jobs j where j.artifact_id = a.id order by j.id desc limit 1) as priority from ev_artifacts a where a.mime_type like 'audio/%' or a.mime_type like 'video/%'""")
def d02_artifact_catalog(b):
    return J.artifact_catalog(b.artifacts, b.jobs, b.derived_text)


@query("select artifact_id, max(id) as id, arg_max(language, id) as language, arg_max(text, id) as text from ev_derived_text group by artifact_id")
def d03_latest_transcript(b):
    return J.latest_transcript(b.derived_text)


@query("select id, artifact_id, language from ev_derived_text where id in (select min(id) from ev_derived_text group by artifact_id)")
def d03_pinned_transcript(b):
    pins = b.derived_text.groupBy("artifact_id").agg(F.min("id").alias("id"))
    return J.pinned_transcript(b.derived_text, pins).select("id", "artifact_id", "language")


@query("select d.id, r.status as run_status, case when r.id is null then 'legacy_unknown' else 'recorded' end as provenance_status from ev_derived_text d left join ev_runs r on d.run_id = r.id")
def d04_transcript_with_run(b):
    return J.transcript_with_run(b.derived_text, b.runs).select("id", "run_status", "provenance_status")


@query("select j.id, j.status, string_agg(r.id || ':' || r.status, ',' order by r.id) as runs from ev_jobs j left join ev_runs r on j.id = r.job_id group by j.id, j.status")
def d05_job_with_runs(b):
    found = J.job_with_runs(b.jobs, b.runs)
    return found.select("id", "status", F.when(F.col("runs").isNotNull(), F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["id"], r["status"])), ",")).alias("runs"))


@query("""with o as (select page_id * 2 as observation_id, list_extract(string_split(url, '/'), -1) as name from pages), f as (select page_id as file_id, list_extract(string_split(url, '/'), -1) as name from pages)
  select observation_id, file_id, count(*) over (partition by observation_id) > 1 as ambiguous from o join f using (name)""")
def d06_candidate_links(b):
    return J.candidate_links(*_observed(b)).select("observation_id", "file_id", "ambiguous")


def _observed(b):
    files = b.pages.select(F.col("page_id").alias("file_id"), S.basename(F.col("url")).alias("name"))
    return b.pages.select((F.col("page_id") * 2).alias("observation_id"), F.col("url").alias("value")), files


@query("""with o as (select page_id * 2 as observation_id, list_extract(string_split(url, '/'), -1) as name from pages), f as (select page_id as file_id, list_extract(string_split(url, '/'), -1) as name from pages),
  l as (select observation_id, file_id, count(*) over (partition by observation_id) > 1 as ambiguous, row_number() over (order by observation_id, file_id) as place, count(*) over () > 150 as limited from o join f using (name))
  select observation_id, file_id, ambiguous, limited from l where place <= 150""")
def d06_link_limit(b):
    return J.first_links(*_observed(b), 150).select("observation_id", "file_id", "ambiguous", "limited")


NAMES = "with f as (select page_id as uri, list_extract(string_split(url, '/'), -1) as name from pages), r as (select o_orderkey as recording_id, o_custkey as k from orders), n as (select r.recording_id, p.name from r join f p on p.uri = r.k)"


def _recordings(b):
    """Recordings named as the page of their customer's number is; a name that several pages have gives several candidates."""
    files = b.pages.select(F.col("page_id").alias("uri"), S.basename(F.col("url")).alias("name"))
    return b.orders.join(files, F.col("o_custkey") == F.col("uri")).select(F.col("o_orderkey").alias("recording_id"), F.col("name").alias("recording_name")), files


@query(f"{NAMES} select recording_id, f.uri from n join f using (name)")
def d07_recording_candidates(b):
    return J.recording_candidates(*_recordings(b)).select("recording_id", "uri")


@query(f"{NAMES} select count(*) as linked from n where name in (select name from f)")
def d07_linked_count(b):
    return J.linked_count(*_recordings(b))


@query(f"{NAMES} select distinct f.uri from n join f using (name)")
def d07_selected_candidates(b):
    return J.selected_candidates(*_recordings(b)).select("uri")


@query("""with r as (select l_orderkey as row_id, list_sort(list_distinct(list(l_suppkey % 7))) as row_phones from lineitem group by all), f as (select o_custkey as file_id, list_sort(list_distinct(list(o_orderkey % 7))) as file_phones from orders group by all)
  select row_id, file_id, row_phones, file_phones from (select o_orderkey as row_id, o_custkey as file_id from orders) join r using (row_id) join f using (file_id) where not list_has_any(row_phones, file_phones)""")
def d08_phone_disagreements(b):
    rows = b.lineitem.select(F.col("l_orderkey").alias("row_id"), (F.col("l_suppkey") % 7).alias("phone"))
    files = b.orders.select(F.col("o_custkey").alias("file_id"), (F.col("o_orderkey") % 7).alias("phone"))
    return J.phone_disagreements(rows, files, b.orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("file_id"))).select("row_id", "file_id", "row_phones", "file_phones")


PACKETS = """with o as (select artifact_id, count(*) as n, min(observation_id) as lo from ev_observations group by artifact_id),
  x as (select d.id as anchor_id, a.original_name, d.language, d.run_id, a.source_id, s.label, r.id as run, r.status, r.artifact_id = d.artifact_id as own, coalesce(o.n, 0) as n, o.lo from ev_derived_text d join ev_artifacts a on d.artifact_id = a.id
    left join ev_sources s on a.source_id = s.id left join ev_runs r on d.run_id = r.id left join o on o.artifact_id = a.id)
  select anchor_id, original_name, language, label as source_label, status as run_status, n as n_observations, lo as first_observation,
  concat_ws(',', case when source_id is not null and label is null then 'missing_source' end, case when run_id is not null and (run is null or not own) then 'missing_or_foreign_run' end) as errors,
  concat_ws(',', case when label is null then 'source_record_unknown' end, case when n = 0 then 'acquisition_history_unknown' end, case when run is null then 'processing_run_unknown' end, case when run is not null and status is distinct from 'done' then 'processing_run_success_unconfirmed' end) as unknowns from x"""


def _packets(b):
    anchors = b.derived_text.select(F.col("id").alias("anchor_id"), F.col("id").alias("derived_text_id"), "artifact_id")
    return J.citation_packets(anchors, b.artifacts, b.derived_text, b.sources, b.observations, b.runs)


@query(PACKETS)
def d09_citation_packets(b):
    return _packets(b).select(
        "anchor_id", "artifact.original_name", "version.language", F.col("source.label").alias("source_label"), F.col("run.status").alias("run_status"), F.coalesce(F.size("observations"), F.lit(0)).cast("long").alias("n_observations"),
        F.get("observations", F.lit(0))["observation_id"].alias("first_observation"), F.array_join("errors", ",").alias("errors"), F.array_join("unknowns", ",").alias("unknowns"),
    )


@query("""with k as (select sha256(text) as h, source, min(doc_id) as id, arg_min(n_chars, doc_id) as size from documents where doc_id % 2 = 0 group by all)
  select d.doc_id, k.id as artifact_id, case when k.id is null then 'new' when d.n_chars + case when d.doc_id % 10 = 1 then 1 else 0 end = k.size then 'reobserved' else 'conflict' end as outcome from documents d left join k on sha256(d.text) = k.h and d.source = k.source""")
def d10_dedupe_ingest(b):
    d = b.documents.select("doc_id", F.sha2("text", 256).alias("sha256"), F.col("source").alias("source_locator"), (F.col("n_chars") + F.when(F.col("doc_id") % 10 == 1, 1).otherwise(0)).alias("size_bytes"), F.lit(True).alias("is_raw"))
    known = b.documents.filter("doc_id % 2 = 0").groupBy(F.sha2("text", 256).alias("sha256"), F.col("source").alias("source_locator")).agg(F.min("doc_id").alias("id"), F.min_by("n_chars", "doc_id").alias("size_bytes"), F.lit(True).alias("is_raw"))
    return J.dedupe_ingest(d, known).select("doc_id", "artifact_id", "outcome")


@query("""select n.id, k.id as known_id, case when k.id is null then 'inserted' when n.id % 4 <> 0 then 'reobserved' else 'conflict' end as outcome from ev_events n left join ev_events k
  on n.id % 5 <> 0 and k.id % 2 = 0 and n.external_id = k.external_id and n.artifact_id = k.artifact_id and n.source_id = k.source_id and n.event_type = k.event_type""")
def d11_upsert_events(b):
    new = b.events.withColumn("external_id", F.when(F.col("id") % 5 != 0, F.col("external_id"))).withColumn("body", F.when(F.col("id") % 4 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return J.upsert_events(new, b.events.filter("id % 2 = 0"), ["ts_start", "phone_or_address", "body"]).select("id", "known_id", "outcome")


@query("""with w as (select distinct c_nationkey as case_id, c_mktsegment as kind, case when c_custkey % 2 = 0 then 'x' end as locator from customer), k as (select c_nationkey as case_id, c_mktsegment as kind, case when c_custkey % 2 = 0 then 'x' end as locator, min(c_custkey) as known_id from customer where c_custkey % 5 = 1 and c_mktsegment <> 'BUILDING' group by all)
  select w.case_id, w.kind, w.locator, k.known_id from w left join k on w.case_id = k.case_id and w.kind = k.kind and w.locator is not distinct from k.locator""")
def d12_ensure_sources(b):
    c = b.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("case_id"), F.col("c_mktsegment").alias("kind"), F.lit("l").alias("label"), F.when(F.col("c_custkey") % 2 == 0, "x").alias("locator"), F.lit(None).cast("string").alias("account"))
    return J.ensure_sources(c, c.filter("id % 5 = 1 and kind <> 'BUILDING'")).select("case_id", "kind", "locator", "known_id")


@query("""with c as (select user_id, arg_min(event_type, event_id) as label from events where user_id % 3 = 0 group by user_id) select distinct cast(e.user_id as varchar) as phone, coalesce(c.label, cast(e.user_id as varchar)) as label from events e left join c on e.user_id = c.user_id""")
def d13_label_for(b):
    phones = b.events.select(F.col("phone_or_address").alias("phone")).distinct()
    return J.label_for(phones, b.events.filter("artifact_id % 3 = 0").select(F.col("phone_or_address").alias("phone"), F.col("event_type").alias("label"), F.col("id").alias("ordinal")))


@query("""with a as (select c_custkey as id, c_custkey % 30 as artifact_id, case when c_custkey % 7 = 0 then null else c_custkey % 160 end as derived_text_id, cast(case when c_custkey % 5 = 0 then null else c_custkey end as bigint) as start_ms, cast(case when c_custkey % 5 = 0 then null else c_custkey * 7 - 500 end as bigint) as end_ms from customer),
  v as (select distinct derived_text_id as id, derived_text_id % 30 as owner from ev_segments), m as (select derived_text_id as id, max(cast(round_even(end_s * 1000, 0) as bigint)) as last_ms from ev_segments group by 1)
  select a.id, case when (start_ms is not null or end_ms is not null) and derived_text_id is null then 'range_without_version' when derived_text_id is not null and owner is null then 'unknown_version' when owner <> artifact_id then 'foreign_version' when end_ms < start_ms then 'reversed_range' when end_ms > last_ms then 'beyond_transcript' end as reason
  from a left join v on v.id = a.derived_text_id left join m on m.id = a.derived_text_id""")
def d14_annotation_target_check(b):
    k = F.col("c_custkey")
    notes = b.customer.select(k.alias("id"), (k % 30).alias("artifact_id"), F.when(k % 7 != 0, k % 160).alias("derived_text_id"), F.when(k % 5 != 0, k).alias("start_ms"), F.when(k % 5 != 0, k * 7 - 500).alias("end_ms"))
    versions = b.segments.select(F.col("derived_text_id").alias("id"), (F.col("derived_text_id") % 30).alias("artifact_id")).distinct()
    return J.annotation_target_check(notes, b.segments, versions).select("id", "reason")


@query("select id as artifact_id from ev_artifacts where (mime_type like 'audio/%' or mime_type like 'video/%') and id not in (select artifact_id from ev_jobs where status in ('queued', 'running'))")
def d15_queue_all_media(b):
    return J.queue_all_media(b.artifacts, b.jobs).select("artifact_id")


@query("""with r as (select id as artifact_id, case when id % 4 = 0 then null else cast(id % 5 + 1 as int) end as priority from ev_artifacts), j as (select artifact_id, max(id) as id, arg_max(priority, id) as p from ev_jobs where status in ('queued', 'running') group by 1)
  select r.artifact_id, j.id as job_id, case when j.id is null then 'insert' when r.priority is not null and r.priority <> j.p then 'reprioritise' else 'keep' end as action from r left join j using (artifact_id)""")
def d15_enqueue(b):
    requests = b.artifacts.select(F.col("id").alias("artifact_id"), F.when(F.col("id") % 4 != 0, (F.col("id") % 5 + 1).cast("int")).alias("priority"))
    return J.enqueue(requests, b.jobs).select("artifact_id", "job_id", "action")


@query("select id, priority from ev_jobs where status = 'queued' and artifact_id not in (select artifact_id from ev_jobs where status = 'running')")
def d16_runnable_jobs(b):
    return J.runnable_jobs(b.jobs).select("id", "priority")


@query("select id as artifact_id, 'legacy_snapshot' as acquisition_kind from ev_artifacts where id not in (select artifact_id from ev_observations where artifact_id % 3 = 0)")
def d17_backfill_observations(b):
    return J.backfill_observations(b.artifacts, b.observations.filter("artifact_id % 3 = 0")).select("artifact_id", "acquisition_kind")


# --- aggregates ---


@query("select (select count(*) from ev_artifacts) as artifacts, (select count(*) from ev_events) as events, (select count(*) from ev_derived_text) as transcripts, (select count(*) from labels) as annotations, (select count(*) from ev_jobs where status = 'queued') as queued, (select count(*) from ev_jobs where status = 'failed') as failed")
def e01_dashboard_counts(b):
    return A.dashboard_counts(b.artifacts, b.events, b.derived_text, b.labels, b.jobs)


@query("select list_extract(string_split(url, '/'), -1) as name, count(*) as files, list(page_id order by page_id) as file_ids from pages group by 1 having count(*) > 1")
def e02_name_collisions(b):
    return A.name_collisions(b.pages.select(F.col("page_id").alias("file_id"), S.basename(F.col("url")).alias("name")))


@query("select artifact_id, count(*) filter (where event_type = 'click') as n_click, count(*) filter (where event_type = 'view') as n_view, count(*) filter (where event_type = 'error') as n_error from ev_events group by artifact_id")
def e03_import_counts(b):
    return A.count_by_type(b.events, ["click", "view", "error"])


@query("""select count(*) as files_seen, count(case when doc_id % 5 <> 0 then 1 end) as files_hashed, count(distinct source) as directories_seen, (select count(distinct (l_orderkey, l_linenumber)) from lineitem) as rows_captured,
  (select cast(sum(length(l_returnflag)) as bigint) from lineitem) as cell_characters_captured, (select count(*) = 0 from labels where toxic = 1) as complete from documents""")
def e04_scan_coverage(b):
    files = b.documents.select(F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")).alias("sha256"), F.col("source").alias("folder"))
    cells = b.lineitem.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), F.col("l_returnflag").alias("value"))
    return A.scan_coverage(files, cells, b.labels.filter("toxic = 1"))


@query("select event_type as code, count(distinct user_id) as issues from events group by 1")
def e05_issue_counts(b):
    return A.issue_counts(b.events.select(F.col("event_type").alias("code"), F.col("artifact_id").alias("path")))


@query("""select o_custkey as file_id, bool_and(o_orderstatus <> 'F') as complete, cast(sum(case when o_orderstatus = 'P' then 1 else 0 end) as bigint) as rows, case when bool_and(o_orderstatus <> 'F') then 'complete' when sum(case when o_orderstatus = 'P' then 1 else 0 end) = 0 then 'failed' else 'limited' end as status from orders group by 1""")
def e06_parse_status_rollup(b):
    return A.parse_status_rollup(b.orders.select(F.col("o_custkey").alias("file_id"), (F.col("o_orderstatus") != "F").alias("complete"), F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("rows")))


@query("select case when count(*) filter (where event_type not in ('click', 'view')) = 0 then 'complete_within_scope' else 'partial' end as coverage from events")
def e07_file_coverage(b):
    return A.file_coverage(b.events.select(F.col("event_type").alias("code")), ["click", "view"])


@query("""with s as (select derived_text_id, segment_index, trim(text) = '' as blank, len(string_split(text, ' ')) as n from ev_segments) select derived_text_id, count(*) <= 10000 as complete, count(*) filter (where not blank) as available, count(*) as segments, cast(coalesce(sum(case when not blank then n end), 0) as bigint) as words,
  case when count(*) filter (where blank) = 0 then 'available' when count(*) filter (where not blank) > 0 then 'partial' else 'unavailable' end as status from s group by 1""")
def e08_word_timing_report(b):
    rows = b.segments.select("derived_text_id", "segment_index", F.when(F.trim("text") == "", "blank_segment").alias("reason"), F.size(F.split("text", " ")).alias("n_words"))
    return A.word_timing_report(rows)


@query("select 'artifacts' as \"table\", (select count(*) from ev_artifacts) as rows union all select 'jobs', (select count(*) from ev_jobs) union all select 'tags', 0")
def e09_package_counts(b):
    return A.package_counts({"artifacts": b.artifacts, "jobs": b.jobs}, ["artifacts", "jobs", "tags"])


@query("select true as digest_valid, count(*) filter (where toxic = 1) = 0 as relationships_valid from labels")
def e09_validity_flags(b):
    found = b.labels.select(F.when(F.col("toxic") == 1, "relationships").otherwise("anchors").alias("group"), F.lit("error").alias("severity"))
    return A.validity_flags(found, ["digest", "relationships"])


@query("""with p as (select id as artifact_id, source_id from ev_artifacts union all select artifact_id, source_id from ev_observations) select artifact_id, list_sort(list_distinct(list(case_id))) as cases from p join ev_sources s on p.source_id = s.id group by 1""")
def e10_provenance_cases(b):
    return A.provenance_cases(b.artifacts, b.observations, b.sources)


@query("select d.id, case when d.run_id is null and d.id % 4 = 0 then 'run_unknown,model_unknown' when d.run_id is null then 'run_unknown' when d.id % 4 = 0 then 'model_unknown' else '' end as unknowns from ev_derived_text d")
def e11_unknowns(b):
    rows = b.derived_text.withColumn("model", F.when(F.col("id") % 4 == 0, "").otherwise("m"))
    return A.unknowns(rows, {"run_id": "run_unknown", "model": "model_unknown"}).select("id", F.array_join("unknowns", ",").alias("unknowns"))


@query("select document_id, path, place from (select sha256(text) as document_id, doc_id as path, row_number() over (partition by sha256(text) order by doc_id) as place from documents) where place > 1")
def e12_repeated_documents(b):
    return A.repeated_documents(b.documents.select(F.sha2("text", 256).alias("document_id"), F.col("doc_id").alias("path")))


# --- windows ---


@query("select artifact_id, max(id) as id, arg_max(event_type, id) as event_type from ev_events group by 1")
def f01_latest_per(b):
    return windows.latest_per(b.events.select("artifact_id", "id", "event_type"), "artifact_id", "id")


@query("select l_orderkey as id, list(l_linenumber order by l_partkey, l_linenumber) = range(list_extract(list(l_linenumber order by l_partkey, l_linenumber), 1), list_extract(list(l_linenumber order by l_partkey, l_linenumber), 1) + count(*)) as contiguous from lineitem group by 1")
def f02_contiguous(b):
    rows = b.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber"))), lambda x: x["l_linenumber"]).alias("i"))
    return rows.select("id", windows.contiguous(F.col("i")).alias("contiguous"))


@query("""select artifact_id, id from (select artifact_id, id, value, lag(value + 20) over (partition by artifact_id order by id) as p from ev_events) where value < p""")
def f03_overlaps(b):
    return windows.overlaps(b.events.withColumn("end", F.col("value") + 20), "artifact_id", "id", "value", "end").select("artifact_id", "id")


@query("select artifact_id, id, cast(sum(strlen(body)) over (partition by artifact_id order by id desc rows unbounded preceding) as bigint) as running from ev_events")
def f04_running_budget(b):
    return windows.running_budget(b.events, "artifact_id", "id", S.row_bytes(F.col("body"))).select("artifact_id", "id", "running")


@query("select artifact_id, id, cast(sum(case when event_type = 'login' or event_type = 'view' then 1 else 0 end) over (partition by artifact_id order by id rows unbounded preceding) as bigint) as group_no from ev_events")
def f05_group_by_marker(b):
    return windows.group_by_marker(b.events, "artifact_id", "id", F.col("event_type").isin("login", "view")).select("artifact_id", "id", "group_no")


@query("select artifact_id, id, row_number() over (partition by artifact_id order by ts_start, id) - 1 as ordinal from ev_events")
def f06_ordinals(b):
    return windows.ordinals(b.events, "artifact_id", "ts_start", "id").select("artifact_id", "id", F.col("ordinal").cast("long"))


# --- citations ---


def _versions(b):
    return transcripts.nest_segments(b.segments)


G1_SQL = """with v as (select derived_text_id, count(*) as n from ev_segments group by 1), r as (select derived_text_id, n, derived_text_id % 4 as k from v),
  q as (select derived_text_id, case when k = 3 then 'outside_transcript' when k = 2 and n > 2 then 'not_contiguous' end as reason, case when k = 2 and n <= 2 then 1 when k = 1 then least(2, n) else 1 end as take from r)
  select q.derived_text_id, q.reason, string_agg(text, '' order by segment_index) filter (where q.reason is null) as quote_text, cast(min(round_even(start_s * 1000, 0)) filter (where q.reason is null) as bigint) as start_ms, cast(max(round_even(end_s * 1000, 0)) filter (where q.reason is null) as bigint) as end_ms
  from q join (select *, row_number() over (partition by derived_text_id order by segment_index) - 1 as place from ev_segments) s on s.derived_text_id = q.derived_text_id and s.place < q.take group by all"""


def _segment_requests(b):
    n = b.segments.groupBy("derived_text_id").agg(F.count("*").cast("int").alias("n"))
    k = F.col("derived_text_id") % 4
    indices = F.when(k == 3, F.array(F.col("n"))).when((k == 2) & (F.col("n") > 2), F.array(F.lit(0), F.lit(2))).when((k == 1) & (F.col("n") > 1), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return n.select("derived_text_id", indices.cast("array<int>").alias("indices"))


@query(G1_SQL)
def g01_cite_segments(b):
    return G.cite_segments(_segment_requests(b), _versions(b)).select("derived_text_id", "reason", "quote_text", "start_ms", "end_ms")


@query("select derived_text_id, string_split(text, ' ')[1] as quote_text from ev_segments where segment_index = 0")
def g02_cite_words(b):
    one = F.array(F.struct(F.lit(0).alias("segment_index"), F.lit(0).alias("word_index")))
    return G.cite_words(b.segments.select("derived_text_id", one.alias("word_refs")).distinct(), _versions(b)).select("derived_text_id", "quote_text")


@query("""with c as (select derived_text_id from ev_segments where segment_index = 0) select derived_text_id as request_id, case when derived_text_id % 3 = 0 then 'foreign_version' when derived_text_id % 3 = 1 then 'quote_differs' end as reason from c""")
def g03_create_citations(b):
    requests = b.segments.select("derived_text_id").distinct().select(F.col("derived_text_id").alias("request_id"), F.when(F.col("derived_text_id") % 3 == 0, -1).otherwise(F.col("derived_text_id")).alias("artifact_id"), "derived_text_id", F.array(F.lit(0)).alias("indices"), F.lit(None).cast("array<struct<segment_index:int,word_index:int>>").alias("word_refs"), F.when(F.col("derived_text_id") % 3 == 1, "\0").alias("expected_quote"))
    derived = b.segments.select(F.col("derived_text_id").alias("id"), F.col("derived_text_id").alias("artifact_id"), F.lit("transcript").alias("kind")).distinct()
    return G.create_citations(requests, _versions(b), derived)[0].select("request_id", "reason")


@query("select derived_text_id, segment_index, case when trim(text) = '' then 'blank_segment' end as reason from ev_segments")
def g04_valid_words(b):
    s = _versions(b).select("derived_text_id", F.posexplode("segments").alias("segment_index", "s"))
    return s.select("derived_text_id", F.col("segment_index").cast("long"), G.valid_words_reason("s").alias("reason"))


def _anchors(b):
    """Anchors as created: of the first segment of each version, and (negative ids) of its first word; some spoiled, some that pin what they must not."""
    one = F.array(F.struct(F.lit(0).alias("segment_index"), F.lit(0).alias("word_index")))
    versions = b.segments.select("derived_text_id").distinct()
    made = G.cite_segments(versions.withColumn("indices", F.array(F.lit(0))), _versions(b)).drop("indices").withColumn("id", F.col("derived_text_id"))
    words = G.cite_words(versions.withColumn("word_refs", one), _versions(b)).drop("word_refs").withColumn("id", -F.col("derived_text_id"))
    k = F.abs("id")
    return (
        made.unionByName(words).filter("reason is null").drop("reason")
        .withColumn("artifact_id", F.when(k % 11 == 0, -1).otherwise(F.col("derived_text_id")))
        .withColumn("quote_sha256", F.when(k % 3 == 0, "0").otherwise(F.col("quote_sha256"))).withColumn("end_ms", F.when(k % 5 == 0, F.col("end_ms") + 1).otherwise(F.col("end_ms")))
        .withColumn("selector_json", F.when(k % 7 == 0, F.lit('{"kind": "pages"}')).otherwise(F.col("selector_json")))
    )


def _owners(b):
    return b.segments.select(F.col("derived_text_id").alias("id"), F.col("derived_text_id").alias("artifact_id"), F.lit("transcript").alias("kind")).distinct()


ANCHORS = """with k as (select derived_text_id as k from ev_segments where segment_index = 0), i as (select k, k as id from k union all select k, -k from k),
  c as (select id, 'anchor_version_mismatch' as code from i where k % 11 = 0 union all select id, 'anchor_quote_digest_mismatch' from i where k % 11 <> 0 and k % 3 = 0
  union all select id, 'invalid_anchor_selector' from i where k % 11 <> 0 and k % 7 = 0 union all select id, 'anchor_selector_mismatch' from i where k % 11 <> 0 and k % 7 <> 0 and (k % 3 = 0 or k % 5 = 0))"""


@query(f"{ANCHORS} select id, code from c")
def g05_verify_anchors(b):
    return G.verify_anchors(_anchors(b), _versions(b), _owners(b))


@query("select id, id % 3 <> 0 as matches from ev_events")
def g06_created_matches(b):
    chosen = b.events.select("id", F.col("body").alias("quote_text"), F.lit(1).alias("start_ms"), F.lit(2).alias("end_ms"), F.lit('{"a": 1, "b": [1, 2]}').alias("selector_json"))
    saved = chosen.withColumn("selector_json", F.when(F.col("id") % 3 == 0, '{"a": 1, "b": [2, 1]}').otherwise('{"b":[1,2],"a":1}'))
    return G.created_matches(chosen, saved)


@query("select derived_text_id, string_agg(trim(text, ' '), ' ' order by segment_index) as text from ev_segments group by 1")
def g07_assemble_text(b):
    return _versions(b).select("derived_text_id", G.assemble_text(F.col("segments")).alias("text"))


# --- search ---

POSTINGS = r"""select object_id as doc, 'content' as "column", unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) as term, unnest(range(len(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')))) as pos from ev_docs"""
FOLDED = rf"""p as (select doc, "column", strip_accents(term) as term, pos from ({POSTINGS}))"""


def _stored(b):
    return folders.stored_index(b.docs, ("content",))


@query("select 'artifact' as object_kind, id as object_id, original_name as title from ev_artifacts union all select 'event', id, event_type from ev_events union all select 'derived_text', id, kind from ev_derived_text")
def h01_search_docs(b):
    return H.search_docs(b.artifacts, b.events, b.derived_text).select("object_kind", "object_id", "title")


@query(f"with {FOLDED} select term, count(*) as tf, count(distinct doc) as df from p group by term")
def h02_build_index(b):
    """Builds and stores an index anew, and reads its dictionary."""
    return X.dictionary(X.create_index(b.docs, folders.folder(b.spark, "index"), columns=("content",)))


@query(f"with {FOLDED} select term, count(*) as tf, count(distinct doc) as df from p where doc % 10 <> 3 group by term")
def h02_index_in_batches(b):
    """An index of half the texts, then the other half and a tenth of them again, then a tenth is deleted: what is left is what an index of the rest says."""
    docs = b.docs
    half = F.col("object_id") % 2 == 0
    stored = X.create_index(docs.filter(half), folders.folder(b.spark, "index"), columns=("content",))
    stored = X.add(stored, docs.filter(~half | (F.col("object_id") % 10 == 4)))
    return X.dictionary(X.delete(stored, docs.filter("object_id % 10 = 3").select(F.col("object_id").alias("doc"))))


@query("select object_id, strip_accents(lower(content)) as folded from ev_docs")
def h03_fold(b):
    return b.docs.select("object_id", H.fold(F.col("content")).alias("folded"))


@query(f"with {FOLDED} select doc from p where term in ('the', 'of') group by doc having count(distinct term) = 2 except select doc from p where term = 'by'")
def h04_match(b):
    return H.match(X.documents_with(_stored(b), ["the", "of", "by"]), all=["the", "of"], none=["by"])


@query(f'with {FOLDED} select distinct a.doc, a.pos as start from p a join p c on a.doc = c.doc and c.pos = a.pos + 1 where a.term = \'of\' and c.term = \'the\'')
def h05_match_phrase(b):
    return H.match_phrase(X.tokens(_stored(b), ["of", "the"]), ["of", "the"]).select("doc", F.col("start").cast("long"))


@query(f"with {FOLDED} select distinct doc from p where term like 'anre%'")
def h06_match_prefix(b):
    return H.match_prefix(X.documents_with(_stored(b), [], ["anre"]), "anre")


@query(f"with {FOLDED} select distinct a.doc from p a join p c on a.doc = c.doc where a.term = 'que' and c.term = 'de' and abs(a.pos - c.pos) - 1 <= 3")
def h07_match_near(b):
    return H.match_near(X.tokens(_stored(b), ["que", "de"]), "que", "de", 3)


@query(f"with {FOLDED} select distinct doc from p where term = 'the' and pos = 0")
def h08_initial_token(b):
    return H.initial_token(H.column_filter(X.tokens(_stored(b), ["the"]), "content"), "the").select("doc")


BM25 = """, l as (select d.object_id as doc, count(p.term) as len from ev_docs d left join p on p.doc = d.object_id group by 1), s as (select count(*) as n, avg(len) as mean from l), c as (select term, doc, count(*) as tf from p where term in ({terms}) group by all),
  f as (select term, count(*) as df from c group by term), r as (select c.doc, {group} sum(-greatest(ln((s.n - f.df + 0.5) / (f.df + 0.5)), 1e-6) * c.tf * 2.2 / (c.tf + 1.2 * (0.25 + 0.75 * l.len / s.mean))) as rank from c join f using (term) join l using (doc) {join} cross join s group by all)"""


@query(f"with {FOLDED} {BM25.format(terms=chr(39) + 'licensed' + chr(39) + ', ' + chr(39) + 'license' + chr(39), group='', join='')} select doc, round(rank, 8) as rank from r")
def h09_bm25(b):
    return X.bm25(_stored(b), ["licensed", "license"]).select("doc", F.round("rank", 8).alias("rank"))


@query(r"""with w as (select object_id, string_split(trim(regexp_replace(content, '\s+', ' ', 'g')), ' ') as w from ev_docs where content is not null),
  h as (select object_id, w, list_transform(w, lambda x: cast(len(list_intersect(regexp_extract_all(strip_accents(lower(x)), '[\p{L}\p{N}]+'), ['licensed', 'license'])) > 0 as int)) as h, greatest(0, len(w) - 24) as last from w),
  s as (select object_id, w, last, h, unnest(range(0, last + 1)) as i from h), c as (select object_id, w, i, coalesce(list_sum(h[i + 1:i + 24]), 0) as n from s where i = 0 or i = last or h[i + 1] = 1),
  b as (select object_id, arg_min({'w': w, 'i': i}, (-n, i)) as x from c group by object_id)
  select object_id, case when x.i > 0 then '…' else '' end || array_to_string(x.w[x.i + 1:x.i + 24], ' ') || case when x.i + 24 < len(x.w) then '…' else '' end as snippet from b""")
def h10_snippet(b):
    return H.snippet(b.docs.filter("content is not null"), ["licensed", "license"])


COMPOSED = """, a as (select p.doc, count(*) as tf from p join p q on p.doc = q.doc and q.pos = p.pos + 1 where p.term = 'licensed' and q.term = 'under' group by 1), c as (select doc, count(*) as tf from p where term like 'vers%' group by 1),
  d as (select doc, count(*) as tf from p where term = 'mit' group by 1), e as (select doc, count(*) as tf from p where term = 'license' group by 1),
  near as (select distinct m.doc from p m join p l on m.doc = l.doc and m.term = 'mit' and l.term = 'license' and abs(m.pos - l.pos) - 1 <= 2), bad as (select distinct doc from p where term = 'gnu'),
  t as (select 1 as i, doc, tf from a union all select 2, doc, tf from c union all select 3, doc, tf from d union all select 4, doc, tf from e), f as (select i, count(*) as n from t group by i),
  l as (select d.object_id as doc, count(p.term) as len from ev_docs d left join p on p.doc = d.object_id group by 1), s as (select count(*) as n_docs, avg(len) as mean from l),
  r as (select t.doc, sum(-greatest(ln((n_docs - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) as rank from t join f using (i) join l using (doc) cross join s group by 1),
  o as (select r.doc, rank, row_number() over (order by round(rank, 9), r.doc) as place, count(*) over () > 10 as has_more from r where r.doc in (select doc from a) and (r.doc in (select doc from c) or r.doc in (select doc from near)) and r.doc not in (select doc from bad))"""


@query(f"with {FOLDED} {COMPOSED} select doc, place, has_more from o where place <= 10")
def h11_search_page(b):
    """licensed under, as a phrase, with vers* or mit and license near each other, without gnu."""
    near = H.Near((H.Phrase(("mit",)), H.Phrase(("license",))), 2)
    return X.search_page(_stored(b), 10, all=(H.Phrase(("licensed", "under")),), any=(H.Phrase(("vers",), prefix=True), near), none=(H.Phrase(("gnu",)),)).select("doc", "place", "has_more")


@query(f"with {FOLDED} , q(query_id, term) as (values (1, 'licensed'), (1, 'license'), (2, 'password'), (2, 'token'), (3, 'rights')) {BM25.format(terms='select term from q', group='q.query_id,', join='join q using (term)')} select query_id, doc, place from (select query_id, doc, row_number() over (partition by query_id order by rank, doc) as place from r) where place <= 20")
def h12_search_many(b):
    asked = b.spark.createDataFrame([(1, "licensed"), (1, "license"), (2, "password"), (2, "token"), (3, "rights")], "query_id int, term string")
    return X.search_many(_stored(b), asked, 20).select("query_id", "doc", "place")


# --- integrity ---


def _tables(b):
    return {"cases": b.region.select(F.col("r_regionkey").alias("id")), "sources": b.sources, "artifacts": b.artifacts, "events": b.events.drop("source_id").withColumn("source_id", F.col("artifact_id") % 25), "derived_text": b.derived_text, "jobs": b.jobs, "processing_runs": b.runs, "source_observations": b.observations.withColumnRenamed("observation_id", "id")}


@query("""with r as (select id, sha256('{"id":"' || id || '","status":"' || status || '"}') as d from ev_jobs), p as (select cast(floor(id / 10000) as bigint) as part, count(*) as n, sha256(string_agg(d, '' order by id, d)) as d from r group by 1)
  select 'jobs' as "table", cast(sum(n) as bigint) as rows, sha256(string_agg(d, '' order by part)) as digest from p""")
def i01_table_digests(b):
    return I.table_digests({"jobs": b.jobs.select("id", "status")}, {"jobs": "id"}).select("table", "rows", "digest")


def _signed(b, jobs):
    digests = I.table_digests({"artifacts": b.artifacts, "jobs": jobs}, {"artifacts": "id", "jobs": "id"})
    return digests, I.payload_digest(digests, b.spark.range(1).select(*(F.lit(v).alias(k) for k, v in I.FLAGS.items())))


# some row of status running has another priority: where there is one, table and payload differ
@query("select code, path from (values ('table_digest_mismatch', 'jobs'), ('payload_digest_mismatch', 'integrity/payload_sha256')) v(code, path) where (select count(*) from ev_jobs where status = 'running' and priority <> 9) > 0")
def i02_digest_mismatch(b):
    (before, signed), (after, found) = _signed(b, b.jobs), _signed(b, b.jobs.withColumn("priority", F.when(F.col("status") == "running", 9).otherwise(F.col("priority"))))
    return I.digest_mismatch(before, after).unionByName(I.payload_digest_mismatch(signed, found)).select("code", "path")


@query("""select id as key, 'changed' as change from ev_jobs where id % 97 = 5 and id % 1000 <> 7 and priority <> 9 union all select id, 'removed' from ev_jobs where id % 1000 = 7 union all select -id, 'added' from ev_jobs where id % 1000 = 1""")
def i02_changed_rows(b):
    """Two trees of digests are stored, of a table and of its later state; rows are read where the trees differ."""
    before = b.jobs
    after = before.filter("id % 1000 <> 7").withColumn("priority", F.when(F.col("id") % 97 == 5, 9).otherwise(F.col("priority"))).unionByName(before.filter("id % 1000 = 1").withColumn("id", -F.col("id")))
    trees = []
    for df in (before, after):
        path = folders.folder(b.spark, "digests")
        I.digest_tree(df, fan=100).write.parquet(path)
        trees.append(b.spark.read.parquet(path))
    return I.changed_rows(before, after, I.changed_ranges(*trees, fan=100), fan=100)


@query("""select 'invalid_identity' as code, 'artifacts/' || id as path from ev_artifacts where id <= 0 union all select 'invalid_identity', 'jobs/' || (id % 500) from ev_jobs where id % 500 = 0 group by all union all select 'duplicate_identity', 'jobs/' || (id % 500) from ev_jobs group by all having count(*) > 1""")
def i03_bad_identity(b):
    return I.bad_identity({"artifacts": b.artifacts, "jobs": b.jobs.withColumn("id", F.col("id") % 500)}, {}).select("code", "path")


@query("""select 'broken_reference' as code, 'artifacts/' || id || '/source_id' as path from ev_artifacts where source_id not in (select id from ev_sources) union all select 'broken_reference', 'artifacts/' || id || '/parent_artifact_id' from ev_artifacts where parent_artifact_id is not null and parent_artifact_id not in (select id from ev_artifacts)
  union all select 'broken_reference', 'events/' || id || '/artifact_id' from ev_events where artifact_id not in (select id from ev_artifacts) union all select 'broken_reference', 'events/' || id || '/source_id' from ev_events where artifact_id % 25 not in (select id from ev_sources)
  union all select 'broken_reference', 'derived_text/' || id || '/artifact_id' from ev_derived_text where artifact_id not in (select id from ev_artifacts) union all select 'broken_reference', 'derived_text/' || id || '/run_id' from ev_derived_text where run_id is not null and run_id not in (select id from ev_runs)
  union all select 'broken_reference', 'jobs/' || id || '/artifact_id' from ev_jobs where artifact_id not in (select id from ev_artifacts) union all select 'broken_reference', 'processing_runs/' || id || '/job_id' from ev_runs where job_id not in (select id from ev_jobs) union all select 'broken_reference', 'processing_runs/' || id || '/artifact_id' from ev_runs where artifact_id not in (select id from ev_artifacts)
  union all select 'broken_reference', 'source_observations/' || observation_id || '/artifact_id' from ev_observations where artifact_id not in (select id from ev_artifacts) union all select 'broken_reference', 'source_observations/' || observation_id || '/source_id' from ev_observations where source_id not in (select id from ev_sources)
  union all select 'broken_reference', 'sources/' || id || '/case_id' from ev_sources where case_id not in (select r_regionkey from region)""")
def i04_broken_references(b):
    return I.broken_references(_tables(b)).select("code", "path")


@query("select 'observation_content_mismatch' as code, 'source_observations/' || doc_id as path from documents where doc_id % 9 = 0")
def i05_content_mismatch(b):
    files = b.documents.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("size_bytes"))
    seen = files.select("id", F.col("id").alias("artifact_id"), "sha256", F.when(F.col("id") % 9 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"))
    return I.content_mismatch(seen, files).select("code", "path")


CASES = """with p as (select id as artifact_id, source_id from ev_artifacts union all select artifact_id, case when artifact_id % 40 = 0 then artifact_id % 25 end from ev_observations), c as (select artifact_id, list_sort(list_distinct(list(case_id))) as cases from p join ev_sources s on p.source_id = s.id group by 1)"""


def _cases(b):
    """Cases by the artifacts' own sources, and by another source where observations know one."""
    seen = b.observations.select("artifact_id", F.when(F.col("artifact_id") % 40 == 0, F.col("artifact_id") % 25).alias("source_id"))
    return A.provenance_cases(b.artifacts, seen, b.sources)


@query(f"""{CASES}
  select 'cross_case_artifact' as code, 'artifacts/' || a.id as path from ev_artifacts a join c on c.artifact_id = a.id where len(cases) > 1 union all select 'unknown_artifact_case', 'artifacts/' || a.id from ev_artifacts a left join c on c.artifact_id = a.id where c.cases is null
  union all select 'cross_case_parent_artifact', 'artifacts/' || a.id from ev_artifacts a join c on c.artifact_id = a.id join c p on p.artifact_id = a.parent_artifact_id where c.cases <> p.cases""")
def i06_case_boundaries(b):
    return I.case_boundaries(b.artifacts, _cases(b)).select("code", "path")


@query(f"""{CASES}, e as (select e.id, e.artifact_id, s.case_id from ev_events e join ev_sources s on e.source_id = s.id), n as (select l.doc_id as id, l.doc_id % 50 as artifact_id, e.artifact_id as of_event, e.case_id from labels l join e on e.id = l.doc_id)
  select 'cross_case_event' as code, 'events/' || e.id as path from e join c using (artifact_id) where cases <> [case_id]
  union all select distinct 'cross_case_annotation_event', 'annotations/' || n.id from n join c on c.artifact_id in (n.artifact_id, n.of_event) where cases <> [n.case_id]""")
def i06_event_cases(b):
    notes = b.labels.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("artifact_id"), F.col("doc_id").alias("event_id"), F.lit(None).cast("long").alias("derived_text_id"))
    return I.event_case_boundaries(b.events, notes, b.sources, b.derived_text, _cases(b)).select("code", "path")


@query("""select 'run_job_artifact_mismatch' as code, 'processing_runs/' || r.id as path from ev_runs r join ev_jobs j on r.job_id = j.id where r.artifact_id <> j.artifact_id union all select 'text_run_artifact_mismatch', 'derived_text/' || d.id from ev_derived_text d join ev_runs r on d.run_id = r.id where d.artifact_id <> r.artifact_id""")
def i07_run_consistency(b):
    return I.run_consistency(b.runs, b.jobs, b.derived_text).select("code", "path")


@query("""select 'annotation_artifact_mismatch' as code, 'annotations/' || doc_id as path from labels l join ev_events e on e.id = l.doc_id where case when l.doc_id % 2 = 0 then e.artifact_id else l.doc_id % 50 end <> e.artifact_id""")
def i08_annotation_targets(b):
    events = b.events
    notes = b.labels.join(events.select(F.col("id").alias("doc_id"), F.col("artifact_id").alias("a")), "doc_id").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("a")).otherwise(F.col("doc_id") % 50).alias("artifact_id"), F.col("doc_id").alias("event_id"), F.lit(None).cast("long").alias("derived_text_id"))
    return I.annotation_targets(notes, events, b.derived_text).select("code", "path")


@query("""with l as (select doc_id as id, case when doc_id % 10 = 0 then 'page' else 'artifact' end as left_kind, doc_id as left_id, doc_id * 40 as right_id from labels) select 'unknown_link_target_kind' as code, 'links/' || id || '/left' as path from l where left_kind = 'page'
  union all select 'broken_object_reference', 'links/' || id || '/left' from l where left_kind = 'artifact' and left_id not in (select id from ev_artifacts) union all select 'broken_object_reference', 'links/' || id || '/right' from l where right_id not in (select id from ev_events)""")
def i09_polymorphic_links(b):
    links = b.labels.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 0, "page").otherwise("artifact").alias("left_kind"), F.col("doc_id").alias("left_id"), F.lit("event").alias("right_kind"), (F.col("doc_id") * 40).alias("right_id"))
    return I.polymorphic_links(links, {"artifacts": b.artifacts, "events": b.events}).select("code", "path")


@query(f"{ANCHORS} select code, 'evidence_anchors/' || id as path from c")
def i10_anchor_checks(b):
    return I.anchor_checks(_anchors(b), _versions(b), _owners(b)).select("code", "path")


@query("""with r as (select l_orderkey as package, l_returnflag as name, count(*) as rows from lineitem group by all), d as (select o_orderkey as package, case when o_orderkey % 7 = 0 then 'X' else 'N' end as name from orders where o_orderkey % 3 = 0)
  select 'invalid_missing_tables' as code, package || '/' || name as path from d where name = 'X' union all select 'legacy_incomplete_schema', package || '/N' from d where name = 'N' union all select 'contradictory_missing_table', package || '/N' from d where name = 'N' and package in (select package from r where name = 'N')
  union all select 'missing_or_invalid_table', p.package || '/' || t.name from (select distinct package from r) p cross join (values ('A'), ('N'), ('R')) t(name) where not exists (select 1 from r where r.package = p.package and r.name = t.name) and not exists (select 1 from d where d.package = p.package and d.name = t.name)""")
def i11_missing_tables(b):
    rows = b.lineitem.groupBy(F.col("l_orderkey").alias("package"), F.col("l_returnflag").alias("name")).agg(F.count("*").alias("rows"))
    declared = b.orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("package"), F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise("N").alias("name"))
    return I.missing_tables(rows, declared, ["A", "N", "R"]).select("code", "path")


@query("""select 'unsupported_schema' as code, o_orderkey || '/schema' as path from orders where o_orderstatus = 'P' union all select 'invalid_capability_flag', o_orderkey || '/signed' from orders where o_orderkey % 4 = 0 union all select 'invalid_capability_flag', o_orderkey || '/metadata_only' from orders where o_orderkey % 9 = 0""")
def i11_package_flags(b):
    k = F.col("o_orderkey")
    packages_ = b.orders.select(k.alias("id"), F.when(F.col("o_orderstatus") != "P", "v1").alias("schema"), (k % 9 != 0).alias("metadata_only"), F.lit(False).alias("source_bytes_included"), F.lit(False).alias("replay_supported"), F.when(k % 4 != 0, False).alias("signed"))
    return I.package_flags(packages_, "v1").select("code", "path")


def _written_packets(b):
    """Packets of the first segment of each version, as they are written, each with its digest."""
    versions = b.segments.groupBy("derived_text_id").agg(F.array_sort(F.collect_list(F.struct("segment_index", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text"))).alias("s"))
    derived = versions.select(F.col("derived_text_id").alias("id"), F.col("derived_text_id").alias("artifact_id"), F.lit("transcript").alias("kind"), F.to_json(F.transform("s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))).alias("segments_json"), F.when(F.col("derived_text_id") % 2 == 0, F.col("derived_text_id") + 5).alias("run_id"))
    anchors = G.cite_segments(b.segments.select("derived_text_id").distinct().withColumn("indices", F.array(F.lit(0))), _versions(b)).filter("reason is null").drop("reason", "indices").withColumn("artifact_id", F.col("derived_text_id")).withColumn("anchor_id", F.col("derived_text_id"))
    artifacts = derived.select("id", F.lit("sha").alias("sha256"), F.lit(7).cast("long").alias("size_bytes"), (F.col("id") % 25).alias("source_id"))
    sources = derived.select((F.col("id") % 25).alias("id")).distinct()
    runs = derived.filter("run_id is not null").select(F.col("run_id").alias("id"), "artifact_id", F.lit("done").alias("status"), F.lit("t").alias("lease_token"))
    seen = derived.select((F.col("id") * 10).alias("observation_id"), F.col("id").alias("artifact_id"), F.when(F.col("id") % 13 == 0, "other").otherwise("sha").alias("sha256"), F.lit(7).cast("long").alias("size_bytes"))
    made = J.citation_packets(anchors, artifacts, derived, sources, seen, runs)
    return made.select(F.col("anchor_id").alias("packet_id"), packages.packet_json(made).alias("payload_json"))


@query("""with k as (select derived_text_id as k, text from ev_segments where segment_index = 0 and trim(text) <> '')
  select 'payload_digest_mismatch' as code, 'packets/' || k as path from k where k % 6 = 0 union all select 'acquisition_content_mismatch', 'packets/' || k from k where k % 13 = 0
  union all select 'artifact_reference_mismatch', 'packets/' || k from k where k % 7 = 0 union all select 'unsupported_scope_claim', 'packets/' || k from k where k % 11 = 0""")
def i12_inspect_packets(b):
    p, k = F.col("payload_json"), F.col("packet_id")
    spoiled = F.when(k % 7 == 0, F.regexp_replace(p, r'"version":\{"id":(\d+),"artifact_id":\d+', r'"version":{"id":$1,"artifact_id":0')).otherwise(p)
    spoiled = F.when(k % 11 == 0, F.regexp_replace(spoiled, '"tasks_imported":false', '"tasks_imported":true')).otherwise(spoiled)
    rows = _written_packets(b).select("packet_id", spoiled.alias("payload_json")).withColumn("payload_sha256", F.when(k % 6 == 0, "0").otherwise(F.sha2("payload_json", 256)))
    return I.inspect_packets(rows).select("code", "path")


@query("""with a as (select event_id as id, case event_id % 3 when 0 then 'artifact' when 1 then 'screen' end as object_kind, case when event_id % 3 < 2 then user_id * 4 end as object_id from events)
  select 'unknown_audit_target_kind' as code, 'audit_log/' || id as path from a where object_kind = 'screen' union all select 'broken_object_reference', 'audit_log/' || id from a where object_kind = 'artifact' and object_id not in (select id from ev_artifacts)""")
def i09_audit_targets(b):
    k = F.col("event_id") % 3
    audit = b.table("events").select(F.col("event_id").alias("id"), F.when(k == 0, "artifact").when(k == 1, "screen").alias("object_kind"), F.when(k < 2, F.col("user_id") * 4).alias("object_id"))
    return I.audit_targets(audit, {"artifacts": b.artifacts}).select("code", "path")


@query("select doc_id as id, case when doc_id % 8 = 0 then 'bad_record' when doc_id % 7 = 0 then 'missing' when doc_id % 6 = 0 then 'changed' else 'ok' end as status, case when doc_id % 7 = 0 then null else cast(greatest(1, ceil(strlen(text) / 1000.0)) as int) end as n_chunks from documents")
def i13_fixity_check(b):
    content = F.col("text").cast("binary")
    d = b.documents
    files = d.filter("doc_id % 7 <> 0").select(F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    known = d.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("stored_path"), F.when(F.col("doc_id") % 8 == 0, "?").otherwise(F.sha2(content, 256)).alias("sha256"), (F.octet_length(content) + F.when(F.col("doc_id") % 6 == 0, 1).otherwise(0)).alias("size_bytes"))
    return I.fixity_check(files, known, 1000).select("id", "status", F.when(F.col("chunks").isNotNull(), F.size("chunks")).alias("n_chunks"))


@query("select id, status from ev_jobs where id % 50 = 0 or status = 'failed'")
def i14_append_only_audit(b):
    before = b.jobs.select("id", "status")
    return I.append_only_audit(before, before.filter("id % 50 <> 0").withColumn("status", F.when(F.col("status") == "failed", "queued").otherwise(F.col("status"))))


@query("select 'job_finished' as action, 'artifact' as object_kind, artifact_id as object_id, '{\"id\":' || id || ',\"status\":\"' || status || '\"}' as details_json from ev_jobs where status in ('done', 'failed')")
def i15_audit_rows(b):
    return I.audit_rows(b.jobs.filter("status in ('done', 'failed')"), "job_finished", "artifact", "artifact_id", "id", "status")


# --- sets ---


@query("select source_id from ev_artifacts union select source_id from ev_observations")
def j01_union_cases(b):
    return sets.union_cases(b.artifacts.select("source_id"), b.observations.select("source_id"))


@query("select id, event_type from ev_events where event_type = 'click' union all select id, event_type from ev_events where event_type = 'view'")
def j02_union_messages(b):
    e = b.events.select("id", "event_type")
    return sets.union_messages(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"))


@query("(select distinct phone_or_address as phone from ev_events where artifact_id % 3 = 0 union select phone_or_address from ev_events where artifact_id % 5 = 0) except select phone_or_address from ev_events where artifact_id % 10 = 0")
def j03_selected_phones(b):
    p = b.events.select(F.col("phone_or_address").alias("phone"), "artifact_id")
    return sets.selected_phones(p.filter("artifact_id % 3 = 0").select("phone"), p.filter("artifact_id % 5 = 0").select("phone"), p.filter("artifact_id % 10 = 0").select("phone").distinct())


@query("select l_orderkey as id, list_distinct(list(l_returnflag order by l_linenumber) filter (where l_returnflag in ('A', 'R'))) is null as none_left, coalesce(len(list_distinct(list(l_returnflag) filter (where l_returnflag in ('A', 'R')))), 0) as n, min_by(l_returnflag, (l_linenumber, l_returnflag)) filter (where l_returnflag in ('A', 'R')) as first from lineitem group by 1")
def j04_default_presets(b):
    rows = b.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"]).alias("d"))
    kept = rows.select("id", sets.default_presets(F.col("d"), F.array(F.lit("R"), F.lit("A"))).alias("k"))
    return kept.select("id", (F.size("k") == 0).alias("none_left"), F.size("k").cast("long").alias("n"), F.get("k", F.lit(0)).alias("first"))


@query("select l_orderkey as id, list_sort(list_filter(['A', 'N', 'R'], lambda x: not list_contains(list(distinct l_returnflag), x))) as missing from lineitem group by 1")
def j05_table_set_difference(b):
    rows = b.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_returnflag").alias("have"))
    return rows.select("id", sets.table_set_difference(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("have"))["missing"].alias("missing"))


# --- leases ---


def _lease_events(b):
    e = b.events
    return e.select(F.col("artifact_id").alias("job_id"), F.col("id").alias("seq"), F.expr("case event_type when 'click' then 'claim' when 'view' then 'renew' when 'error' then 'fail' else 'finish' end").alias("event"), F.concat(F.lit("t"), F.expr("id % 2")).alias("token"), F.lit(36000.0).alias("lease_seconds"), F.col("ts_start").cast("timestamp").alias("ts"))


@query("""with recursive e as (select artifact_id as job_id, case event_type when 'click' then 'claim' when 'view' then 'renew' when 'error' then 'fail' else 'finish' end as event, 't' || (id % 2) as by_token, epoch(ts_start) as ts,
    row_number() over (partition by artifact_id order by ts_start, id) as n from ev_events),
  f(job_id, n, status, attempts, token, expires, abandoned) as (
    select distinct job_id, 0::bigint, 'queued', 0::int, null::varchar, null::double, 0::int from e
    union all
    select job_id, n, case when event = 'claim' and st = 'queued' then 'running' when held and event = 'finish' then 'done' when held and event = 'fail' then 'failed' else st end, case when event = 'claim' and st = 'queued' then a + 1 else a end,
      case when event = 'claim' and st = 'queued' then by_token when held and event in ('finish', 'fail') then null else tok end, case when event = 'claim' and st = 'queued' or held and event = 'renew' then ts + 36000 when held and event in ('finish', 'fail') then null else ex end, ab
    from (select *, coalesce(tok = by_token and ex > ts, false) as held from (
      select f.job_id, e.n, e.event, e.by_token, e.ts, f.attempts as a, case when o.past then 'queued' else f.status end as st, case when not o.past then f.token end as tok, case when not o.past then f.expires end as ex, f.abandoned + cast(o.past as int) as ab
      from f join e on e.job_id = f.job_id and e.n = f.n + 1, lateral (select coalesce(f.status = 'running' and f.expires <= e.ts, false) as past) o))),
  l as (select job_id, unnest(arg_max({'status': status, 'attempts': attempts, 'token': token, 'expires': expires, 'abandoned': abandoned}, n)) from f group by job_id), now as (select max(ts) as now from e),
  x as (select l.*, coalesce(status = 'running' and expires <= now, false) as past from l, now)
  select job_id, case when past then 'queued' else status end as status, attempts, case when not past then token end as token, case when not past then expires end as expires, abandoned + cast(past as int) as abandoned from x""")
def k02_lease_state(b):
    log = _lease_events(b)
    last = log.agg(F.max(F.col("ts").cast("double"))).first()[0] or 0.0  # one number
    return leases.lease_state(log, last)


@query("""with r as (select id, artifact_id as job_id, 't' || (id % 2) as token, ts_start as published from ev_events), l as (select c_custkey as job_id, 't0' as token, timestamp '2024-01-15' as expires from customer where c_custkey % 3 <> 0)
  select r.id, case when l.job_id is null then 'no_lease' when r.token <> l.token then 'stale_token' when published >= expires then 'expired' end as rejected, l.job_id is not null and r.token = l.token and published < expires as accepted from r left join l using (job_id)""")
def k03_fence_results(b):
    results = b.events.select("id", F.col("artifact_id").alias("job_id"), F.concat(F.lit("t"), F.expr("id % 2")).alias("token"), F.col("ts_start").cast("timestamp").alias("published"))
    held = b.customer.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("job_id"), F.lit("t0").alias("token"), F.lit("2024-01-15").cast("timestamp").cast("double").alias("expires"))
    return leases.fence_results(results, held).select("id", "rejected", "accepted")


@query("""select artifact_id as job_id, case event_type when 'click' then 'claim' else 'finish' end as event, cast(sum(case when event_type = 'click' then 1 else 0 end) over w as bigint) as run_no, cast(sum(case when event_type = 'click' then 0 else 1 end) over w as bigint) as version_no from ev_events where event_type not in ('view', 'error') window w as (partition by artifact_id order by ts_start, id rows unbounded preceding)""")
def k04_run_history(b):
    return leases.run_history(_lease_events(b)).select("job_id", "event", "run_no", "version_no")
