"""Queries that write what they derive from the given tables in a source's format and read it back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.operators import aggregates as A
from provenant.operators import integrity
from provenant.plans import registry
from provenant.plans.folders import folder
from provenant.plans.registry import query
from provenant.sources import corpus, delimited, files, messages, packages, wav, xlsx
from provenant.streaming import ingest


def _page_files(b, path: str) -> None:
    """A text file a page, in a folder a name: many small files, dealt by page."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    content = F.concat(F.coalesce(F.col("html"), F.lit("")), F.lit("\x1e"))
    files.write_files(b.pages.select(F.concat(F.lit(f"{path}/kind=page/page_id="), page, F.lit("/part-"), F.hex(F.xxhash64("html")), F.lit(".txt")).alias("path"), content.cast("binary").alias("content")))


@query("select 'kind=page/page_id=' || page_id as folder, 'other' as kind, 'txt' as ext, cast(octet_length(encode(coalesce(html, ''))) + 1 as bigint) as size from pages")
def a01_file_inventory(b):
    path = folder(b.spark)
    _page_files(b, path)
    found = files.file_inventory(b.spark, path).filter("ext = 'txt'")
    return found.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "kind", "ext", "size")


@query("select sha256(coalesce(html, '') || chr(30)) as sha256, 'complete' as hash_status from pages where octet_length(encode(coalesce(html, ''))) < 2000 union all select null, 'unknown_over_limit' from pages where octet_length(encode(coalesce(html, ''))) >= 2000")
def a02_content_digest(b):
    path = folder(b.spark)
    _page_files(b, path)
    return files.content_digest(b.spark, path, 2000).filter(F.col("path").endswith(".txt")).select("sha256", "hash_status")


@query("""select page_id as id, case when page_id % 8 = 0 then 'bad_record' when page_id % 7 = 0 then 'missing' when page_id % 6 = 0 then 'changed' else 'ok' end as status,
  case when page_id % 8 = 0 or page_id % 7 = 0 then null else cast(ceil((octet_length(encode(coalesce(html, ''))) + 1) / 1000.0) as int) end as n_chunks from pages""")
def i13_fixity_of_files(b):
    """A file a page; records of some say another digest, or none, and some name files that aren't there."""
    path = folder(b.spark)
    _page_files(b, path)
    stored = files.file_inventory(b.spark, path).filter("ext = 'txt'").select(F.concat(F.lit(f"{path}/"), "path").alias("stored_path"), F.regexp_extract("path", "page_id=([0-9]+)", 1).cast("long").alias("page_id"))
    content = F.concat(F.coalesce("html", F.lit("")), F.lit("\x1e"))
    known = b.pages.join(stored, "page_id").select(
        F.col("page_id").alias("id"), F.when((F.col("page_id") % 7 == 0), F.concat("stored_path", F.lit(".gone"))).otherwise(F.col("stored_path")).alias("stored_path"),
        F.when(F.col("page_id") % 8 == 0, "?").otherwise(F.sha2(F.concat(content, F.when(F.col("page_id") % 6 == 0, "x").otherwise("")), 256)).alias("sha256"), F.octet_length(content).cast("long").alias("size_bytes"),
    )
    return integrity.fixity_of_files(known, 1000).select("id", "status", F.when(F.col("chunks").isNotNull(), F.size("chunks")).alias("n_chunks"))


def _order_files(b):
    line = F.concat_ws(";", F.col("o_orderkey").cast("string"), F.concat(F.lit('"'), "o_orderpriority", F.lit('"')), F.concat("o_orderstatus", F.lit("\u2028x\f")))
    body = F.concat(F.lit("Numer;Priority;Status\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]), "\n"), F.lit("\n"))
    return b.orders.groupBy("o_custkey").agg(body.alias("body")).select(F.concat(F.col("o_custkey").cast("string"), F.lit(".csv")).alias("path"), F.col("body").cast("binary").alias("content"))


@query("""select o_custkey || '.csv' as file, n as row, unnest([0, 1, 2]) as "column", unnest([cast(o_orderkey as varchar), o_orderpriority, o_orderstatus || chr(8232) || 'x' || chr(12)]) as value, true as complete from (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders)
  union all select distinct o_custkey || '.csv', 0, unnest([0, 1, 2]), unnest(['Numer', 'Priority', 'Status']), true from orders""")
def a03_delimited_cells(b):
    return delimited.delimited_cells(_order_files(b)).select("file", "row", "column", "value", "complete")


@query("select doc_id, case doc_id % 4 when 0 then 'utf-8-sig' when 1 then 'utf-16-be' when 2 then 'utf-8' else 'unknown' end as encoding from documents where text is not null")
def a05_detect_encoding(b):
    text = F.col("text")
    content = F.when(F.col("doc_id") % 4 == 0, F.concat(F.unhex(F.lit("EFBBBF")), text.cast("binary"))).when(F.col("doc_id") % 4 == 1, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))).when(F.col("doc_id") % 4 == 2, text.cast("binary")).otherwise(F.concat(F.unhex(F.lit("C3")), F.unhex(F.lit("28"))))
    return b.documents.filter("text is not null").select("doc_id", files.detect_encoding(content).alias("encoding"))


_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


@F.pandas_udf(T.BinaryType())
def _workbook(rows: pd.Series) -> pd.Series:
    def one(text: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook {_MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
            z.writestr("xl/worksheets/s.xml", f"<worksheet {_MAIN}><sheetData>{text}</sheetData></worksheet>")
        return out.getvalue()

    return rows.map(one)


@query("""with c as (select *, cast(floor(c_custkey / 100) as bigint) as book from customer), r as (select *, row_number() over (partition by book order by c_custkey) as n from c)
  select book || '.xlsx' as file, 'S' as sheet, n as row, 1 as "column", cast(c_custkey as varchar) as value from r union all select book || '.xlsx', 'S', n, 2, c_mktsegment from r""")
def a06_xlsx_cells(b):
    book = F.floor(F.col("c_custkey") / 100)  # a workbook has a hundred keys at most, at any size of the table
    rows = b.customer.groupBy(book.alias("book")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_mktsegment"))).alias("rows"))
    cell = F.transform("rows", lambda r, i: F.format_string('<row r="%d"><c r="A%d"><v>%d</v></c><c r="B%d" t="inlineStr"><is><t>%s</t></is></c></row>', i + 1, i + 1, r["c_custkey"], i + 1, r["c_mktsegment"]))
    books = rows.select(F.concat(F.col("book").cast("string"), F.lit(".xlsx")).alias("path"), F.array_join(cell, "").alias("x")).select("path", _workbook("x").alias("content"))
    return xlsx.xlsx_cells(books).select("file", "sheet", "row", "column", "value")


@query("""select cast(event_id as varchar) as file, case when event_id % 5 = 0 then 'unsupported' when event_id % 7 = 0 then 'malformed' else 'observed' end as status, case when event_id % 5 <> 0 and event_id % 7 <> 0 then (event_id % 100) * 2 / 16000.0 end as declared_duration_sec from events""")
def a07_wav_headers(b):
    little = lambda c: F.concat(*(F.substring(F.lpad(F.hex(c), 8, "0"), at, 2) for at in (7, 5, 3, 1)))
    size = (F.col("event_id") % 100) * 2
    head = F.when(F.col("event_id") % 5 == 0, F.lit("52494658")).otherwise(F.lit("52494646"))
    rate = F.when(F.col("event_id") % 7 == 0, F.lit("01000000")).otherwise(little(F.lit(16000)))
    text = F.concat(head, little(size + 36), F.lit("57415645666D74201000000001000100"), little(F.lit(8000)), rate, F.lit("0200100064617461"), little(size), F.repeat(F.lit("00"), size.cast("int")))
    rows = b.table("events").select(F.col("event_id").cast("string").alias("path"), F.unhex(text).alias("content"))
    return wav.wav_headers(rows.withColumn("length", F.octet_length("content").cast("long"))).select("file", "status", "declared_duration_sec")


@query("""select cast(user_id as varchar) || '.xml' as file, n as row, case when event_type = 'view' then null else 'sms' end as event_type, case when event_type <> 'view' then 'sms_backup:row:' || n end as external_id, case when event_type <> 'view' then epoch_ms(event_id * 1000) end as ts_start, case when event_type <> 'view' then case event_id % 3 when 1 then 'incoming' when 2 then 'outgoing' else '0' end end as direction
  from (select *, row_number() over (partition by user_id order by event_id) as n from events)""")
def a08_sms_backup(b):
    return messages.parse_sms_files(_sms_files(b)).select("file", "row", "event_type", "external_id", F.col("ts_start").cast("timestamp_ntz").alias("ts_start"), "direction")


def _sms_files(b):
    e = b.table("events")
    tag = F.when(F.col("event_type") == "view", "note").otherwise("sms")
    line = F.format_string('<%s date="%d" type="%d" address="%d" body="%s"/>', tag, F.col("event_id") * 1000, F.col("event_id") % 3, F.col("user_id"), F.col("event_type"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "")
    return e.groupBy("user_id").agg(F.concat(F.lit("<smses>"), body, F.lit("</smses>")).alias("x")).select(F.concat(F.col("user_id").cast("string"), F.lit(".xml")).alias("path"), F.col("x").cast("binary").alias("content"))


@query("select cast(c_custkey as varchar) as \"publicId\", c_name as label, c_nationkey as interactions from customer")
def a10_corpus_seed(b):
    """Catalogues of a hundred contacts each, many in one folder."""
    path = folder(b.spark)
    contact = F.struct(F.col("c_custkey").cast("string").alias("publicId"), F.col("c_name").alias("label"), F.col("c_nationkey").alias("interactions"), F.lit(1).alias("unused"))
    books = b.customer.groupBy(F.floor(F.col("c_custkey") / 100).alias("book")).agg(F.collect_list(contact).alias("contacts"))
    books.select("book", F.to_json(F.struct("contacts")).alias("value")).repartition("book").write.partitionBy("book").text(path)
    return corpus.read_corpus_seed(b.spark, path)["contacts"].select("publicId", "label", F.col("interactions").cast("int").alias("interactions"))


@query("select 'artifacts' as part, id, original_name as name from ev_artifacts union all select 'jobs', id, status from ev_jobs union all select 'sources', id, label from ev_sources")
def a12_read_package(b):
    """Packages of one JSON document each, dealt by range of ids; 13 of the 16 tables are missing in each."""
    path = folder(b.spark)
    part = lambda df, name: df.groupBy(F.floor(F.col("id") / 500).alias("package")).agg(F.collect_list(F.struct(*df.columns)).alias(name))
    rows = part(b.artifacts, "artifacts").join(part(b.jobs, "jobs"), "package", "full").join(part(b.sources, "sources"), "package", "full")
    rows.select("package", F.to_json(F.struct(F.lit("v1").alias("schema"), F.struct("artifacts", "jobs", "sources").alias("tables"))).alias("value")).repartition("package").write.partitionBy("package").text(path)
    found = packages.read_package(b.spark, path)
    one = lambda name, column: found[name].select(F.lit(name).alias("part"), "id", F.col(column).alias("name"))
    return one("artifacts", "original_name").unionByName(one("jobs", "status")).unionByName(one("sources", "label"))


@query("select cast(id as varchar) as id, event_type, phone_or_address from ev_events")
def a13_events_csv(b):
    path = folder(b.spark)
    packages.write_events_csv(b.events, path)
    return b.spark.read.option("header", True).csv(path).select("id", "event_type", "phone_or_address")


@query("select 'files' as part, count(*) as rows from documents union all select 'issues', count(*) from labels where toxic = 1 union all select 'coverage', (select count(*) from documents)")
def a14_scan_manifest(b):
    path = folder(b.spark)
    listed = b.documents.select(F.col("doc_id").alias("sha256"), F.col("source").alias("folder"))
    cells = b.lineitem.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), F.col("l_returnflag").alias("value"))
    issues = b.labels.filter("toxic = 1")
    packages.write_scan_manifest({"files": listed, "issues": issues}, path, A.scan_coverage(listed, cells, issues))
    part = lambda name: b.spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("part"), F.count("*").alias("rows"))
    return part("files").unionByName(part("issues")).unionByName(b.spark.read.parquet(f"{path}/coverage").select(F.lit("coverage").alias("part"), F.col("files_seen").alias("rows")))


@query("""select 'jobs' as name, true as present, (select count(*) from ev_jobs) as rows, true as metadata_only, false as signed, 'tags' as missing union all select 'artifacts', true, (select count(*) from ev_artifacts), true, false, 'tags' union all select 'tags', false, null, true, false, 'tags'""")
def a15_export_package(b):
    path = folder(b.spark)
    there = packages.export_package({"jobs": b.jobs, "artifacts": b.artifacts}, {"jobs": "id", "artifacts": "id"}, path, ["jobs", "artifacts", "tags"])
    envelope = b.spark.read.parquet(f"{path}/envelope").select("metadata_only", "signed", F.array_join("missing_tables", ",").alias("missing"))
    return there.join(b.spark.read.parquet(f"{path}/digests").select(F.col("table").alias("name"), "rows"), "name", "left").crossJoin(envelope)  # one row


JOB = "id bigint, artifact_id bigint, kind string, status string, priority int"


@query("select id, artifact_id, kind, status, priority from ev_jobs")
def a16_archive(b):
    path = folder(b.spark)
    packages.write_archive({"jobs": b.jobs}, {"jobs": "id"}, path)
    return packages.read_archive(b.spark, path, {"jobs": JOB})["jobs"]


@query("select 'jobs' as \"table\", count(*) as rows, true as exact from ev_jobs union all select '*', null, true")
def a16_archive_is_exact(b):
    path = folder(b.spark)
    packages.write_archive({"jobs": b.jobs}, {"jobs": "id"}, path)
    return packages.verify_archive(b.spark, path, {"jobs": JOB}, {"jobs": "id"})


@query("select d.id as packet_id, a.original_name, d.language, r.status as run_status from ev_derived_text d join ev_artifacts a on d.artifact_id = a.id join ev_sources s on a.source_id = s.id left join ev_runs r on d.run_id = r.id where d.run_id is null or r.artifact_id = d.artifact_id")
def a17_citation_packets(b):
    path = folder(b.spark)
    packages.write_citation_packets(registry._packets(b), path)
    found = packages.read_citation_packets(b.spark, path).filter(F.sha2("payload_json", 256) == F.col("payload_sha256"))
    of = lambda at, name: F.get_json_object("payload_json", f"$.{at}").alias(name)
    return found.select("packet_id", of("artifact.original_name", "original_name"), of("version.language", "language"), of("run.status", "run_status"))


@query("select user_id % 40 as account, 'sms' as event_type, count(*) as events from events group by 1")
def k01_stream_ingest(b):
    """Files of messages, one an account, go into an inbox; the stream imports them, twice, and each message is there once."""
    path = folder(b.spark)
    rows = b.table("events").withColumn("account", F.col("user_id") % 40)
    line = F.format_string('<sms date="%d" type="1" address="%d" body="%s"/>', F.col("event_id") * 1000, F.col("account"), F.col("event_type"))
    rows = rows.groupBy("account", F.floor(F.col("event_id") / 50_000).alias("part")).agg(F.concat(F.lit("<smses>"), F.array_join(F.array_sort(F.collect_list(line)), ""), F.lit("</smses>")).alias("value"))
    name = F.concat_ws("-", *(F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ("account", "part")))
    # all files in one folder: a listing is one look, not one for each of many folders
    files.write_files(rows.select(F.concat(F.lit(f"{path}/out/"), name, F.lit(".txt")).alias("path"), F.col("value").cast("binary").alias("content")))
    for _ in range(2):
        ingest.stream_ingest(b.spark, f"{path}/out", f"{path}/events", f"{path}/conflicts", f"{path}/state", "*.txt").awaitTermination()
    return ingest.imported(b.spark, f"{path}/events").groupBy(F.col("phone_or_address").cast("long").alias("account"), "event_type").agg(F.count("*").alias("events"))
