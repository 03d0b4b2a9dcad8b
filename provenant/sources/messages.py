"""Message and call exports: SMS/call XML and chat text."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenant.functions.scalars import call_end, chat_ts, direction, epoch_ms_ts, sms_mms_body

BINARY = "path string, modificationTime timestamp, length bigint, content binary"
_RAW = "file string, row int, tag string, attrs map<string,string>, parts array<struct<ct:string,text:string>>, error string"


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


#: Elements, and bytes of their files, of an Arrow batch that the reader gives, about: of one file or of many small ones.
BATCH_ELEMENTS = 10_000
BATCH_BYTES = 8_000_000
Element = tuple[str, int | None, str | None, list[tuple[str, str]] | None, list[dict[str, str | None]] | None, str | None]
_ARROW = [pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.struct([("ct", pa.string()), ("text", pa.string())])), pa.string()]


class _Export:
    """What the parser tells of a file: its root and a row for each of the root's children; no tree is built."""

    def __init__(self, path: str):
        self.path, self.root, self.depth, self.rows = path, None, 0, []

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        self.depth += 1
        if self.depth == 1:
            self.root = tag.lower()
        elif self.depth == 2:
            self.attrs, self.parts = list(attrs.items()), []
        elif self.depth == 3:
            self.in_parts = tag == "parts"
        elif self.depth == 4 and self.in_parts and tag == "part":
            self.parts.append({"ct": attrs.get("ct"), "text": attrs.get("text")})

    def end(self, tag: str) -> None:
        self.depth -= 1
        if self.depth == 1:
            self.rows.append((self.path, len(self.rows) + 1, f"{self.root}/{tag.lower()}", self.attrs, self.parts, None))


def _file_elements(path: str, content: bytes) -> list[Element]:
    export, error = _Export(path), None
    try:
        parser = ET.XMLParser(target=export)
        parser.feed(content)
        parser.close()
    except ET.ParseError as bad:
        error = str(bad)
    if error or export.root not in ("calls", "smses"):
        return [(path, None, None, None, None, error or "unsupported_root")]
    return export.rows


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Children of an export's root with their place among all children."""
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=["file", "row", "tag", "attrs", "parts", "error"])
    rows: list[Element] = []
    size = 0
    for b in batches:
        for path, content in zip(b.column("path"), b.column("content"), strict=True):
            data = content.as_py()
            rows += _file_elements(path.as_py(), data)
            size += len(data)
            if rows and (parts := max(len(rows) // BATCH_ELEMENTS, size // BATCH_BYTES)):
                step = -(-len(rows) // parts)
                for at in range(0, len(rows), step):
                    yield batch(rows[at : at + step])
                rows, size = [], 0
    if rows:
        yield batch(rows)


def parse_sms_files(files: DataFrame) -> DataFrame:
    """Events with issues from files (path, content): a row for each child of the root; unsupported ones and broken files have issues alone."""
    raw = files.select("path", "content").mapInArrow(_elements, _RAW)
    a = lambda name: F.col("attrs")[name]
    known = F.col("tag").isin("calls/call", "smses/sms", "smses/mms")
    kind = F.when(known, F.element_at(F.split("tag", "/"), 2))
    t = epoch_ms_ts(a("date"))
    call = F.col("event_type") == "call"
    found = raw.withColumn("event_type", kind).withColumn("_t", F.when(known, t)).withColumn("_end", F.when(known, call_end(F.col("_t.ts"), a("duration"))))
    issues = F.array_compact(F.array(
        F.when(F.col("error").isNotNull(), F.lit("unreadable_file")), F.when(F.col("error").isNull() & ~F.coalesce(known, F.lit(False)), F.lit("unsupported_record_type")),
        F.when(known & (F.col("_t.status") != "parsed"), F.concat(F.lit("timestamp_"), F.col("_t.status"))), F.when(call, F.col("_end.issue")),
    ))
    return found.select(
        "file", "row", "event_type", F.when(known, F.concat(F.lit("sms_backup:row:"), F.col("row"))).alias("external_id"), F.col("_t.ts").alias("ts_start"), F.when(call, F.col("_end.ts_end")).alias("ts_end"),
        F.when(F.col("event_type") != "mms", direction(a("type"), F.col("event_type"))).alias("direction"), a("contact_name").alias("contact_label"), F.when(call, a("number")).otherwise(a("address")).alias("phone_or_address"),
        F.when(F.col("event_type") == "sms", a("body")).when(F.col("event_type") == "mms", sms_mms_body(F.col("parts"))).alias("body"), "attrs", issues.alias("issues"),
    )


def read_sms_backup(spark: SparkSession, path: str) -> DataFrame:
    return parse_sms_files(read_files(spark, path, "*.xml"))


#: Line ends, white space and line heads as the exporting apps write them.
LINE_ENDS = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
HEADER = r"^[\x{200e}\x{200f}]*(\[)?(\d{1,2}[./-]\d{1,2}[./-]\d{2,4}),?[\s\x{202f}\x{a0}]+(\d{1,2}:\d{2}(?::\d{2})?)(?:[\s\x{202f}\x{a0}]*([aApP]\.?[mM]\.?))?[\x{200e}\x{200f}]*(\])?\s*([-–])?\s*(.*)$"
MESSAGE = r"^([^:]{1,120}):\s(.*)$"


def chat_messages(texts: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """Messages of chat exports (`key`, `text`): a header line starts one, lines after it belong to it; message_no 0 holds lines before the first header."""
    lines = texts.select(key, F.posexplode(F.split(text, LINE_ENDS)).alias("i", "raw"))
    g = lambda n: F.regexp_extract("raw", HEADER, n)
    header = F.col("raw").rlike(HEADER) & ((g(6) != "") | ((g(1) != "") & (g(5) != "")))
    marked = lines.withColumn("header", header).withColumn("message_no", F.sum(F.col("header").cast("int")).over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    head = F.struct(g(2).alias("date"), g(3).alias("time"), g(4).alias("ampm"), g(7).alias("rest"))
    marked = marked.withColumn("head", F.when(F.col("header"), head)).withColumn("body_line", F.when(F.col("header"), F.coalesce(F.nullif(F.regexp_extract("head.rest", MESSAGE, 2), F.lit("")), F.when(F.col("head.rest").rlike(MESSAGE), "").otherwise(F.col("head.rest")))).otherwise(F.col("raw")))
    messages = marked.groupBy(key, "message_no").agg(F.first("head", ignorenulls=True).alias("head"), F.min("i").alias("first"), F.max("i").alias("last"), F.array_sort(F.collect_list(F.struct("i", "body_line"))).alias("lines"))
    t = chat_ts(F.col("head.date"), F.col("head.time"), F.col("head.ampm"))
    sender = F.when(F.col("head.rest").rlike(MESSAGE), F.regexp_extract("head.rest", MESSAGE, 1))
    return messages.withColumn("t", t).select(
        key, "message_no", (F.col("first") + 1).alias("line_start"), (F.col("last") + 1).alias("line_end"), F.when(F.col("message_no") > 0, F.concat(F.lit("whatsapp_txt:line:"), F.col("first") + 1)).alias("external_id"),
        F.col("t.ts").alias("ts_start"), F.when(F.col("message_no") > 0, F.col("t.status")).alias("status"), F.col("t.ambiguous").alias("ambiguous"), sender.alias("sender"), F.array_join(F.transform("lines", lambda x: x["body_line"]), "\n").alias("body"),
    )


def read_whatsapp(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^\\x{feff}", "").alias("text"))
    return chat_messages(texts)
