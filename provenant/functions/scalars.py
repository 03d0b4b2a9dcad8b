"""Column functions over raw record fields. A bad value gives null and a reason, never a guess."""

from __future__ import annotations

import json
import re
import unicodedata
from datetime import date, datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The years 1 to 9999 in milliseconds.
LEAST_MS, MOST_MS = -62135596800000, 253402300799999
#: Header names by what their cells hold.
HEADER_KINDS = {
    "phone": {"phone", "phonenumber", "phoneoraddress", "number", "numer", "numertelefonu", "telefon", "address", "caller", "callee", "sender", "recipient", "from", "to", "numerabonenta", "numerdocelowy"},
    "timestamp": {"date", "datetime", "timestamp", "time", "data", "datapolaczenia", "dataczas", "czaspolaczenia", "start", "startedat", "tsstart"},
    "duration": {"duration", "durationseconds", "durationsec", "durationms", "czasrozmowy", "dlugosc", "dlugoscrozmowy", "seconds", "sekundy"},
    "file_reference": {"file", "filename", "recording", "recordingfile", "nagranie", "plik", "nazwapliku", "path", "filepath"},
    "contact_label": {"name", "contact", "contactname", "kontakt", "nazwa", "osoba"},
}
#: File kinds and types by extension.
FILE_KINDS = {"table": {"csv", "tsv", "xls", "xlsx"}, "audio": {"wav", "mp3", "m4a", "aac", "amr", "3gp", "ogg", "opus", "flac", "wma"}, "video": {"mp4", "mkv", "mov", "avi", "webm"}}
MIME_TYPES = {"csv": "text/csv", "tsv": "text/tab-separated-values", "txt": "text/plain", "xml": "text/xml", "json": "application/json", "html": "text/html", "pdf": "application/pdf", "wav": "audio/x-wav", "mp3": "audio/mpeg", "mp4": "video/mp4", "png": "image/png", "jpg": "image/jpeg"}


def epoch_ms_ts(c: Column) -> Column:
    """struct(ts, status): UTC time of epoch milliseconds; missing, invalid or parsed."""
    text = F.trim(c)
    ms = F.when(text.rlike(r"^[+-]?\d{1,18}$"), text.try_cast("bigint"))
    ok = ms.between(LEAST_MS, MOST_MS)
    status = F.when(c.isNull() | (text == ""), "missing").when(F.coalesce(ok, F.lit(False)), "parsed").otherwise("invalid")
    return F.struct(F.when(ok, F.timestamp_millis(ms)).alias("ts"), status.alias("status"))


CHAT_DATE = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{2}|\d{4})$"
CHAT_TIME = r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$"


def chat_ts(day_text: Column, time_text: Column, ampm: Column) -> Column:
    """struct(ts, status, ambiguous): day-first local time; two-digit years keep their century unknown."""
    part = lambda c, p, n: F.regexp_extract(c, p, n).try_cast("int")
    day, month, year = (part(day_text, CHAT_DATE, n) for n in (1, 2, 3))
    short = F.length(F.regexp_extract(day_text, CHAT_DATE, 3)) == 2
    hour, minute, second = part(time_text, CHAT_TIME, 1), part(time_text, CHAT_TIME, 2), F.coalesce(part(time_text, CHAT_TIME, 3), F.lit(0))
    mark = F.upper(F.replace(ampm, F.lit("."), F.lit("")))
    read = F.struct(day.alias("day"), month.alias("month"), year.alias("year"), short.alias("short"), hour.alias("hour"), minute.alias("minute"), second.alias("second"), mark.alias("mark"))
    return F.get(F.transform(F.array(read), _chat_ts), F.lit(0))  # an element of an array is worked out once, however often its parts are used


def _chat_ts(p: Column) -> Column:
    day, month, year, short, hour, minute, second, mark = (p[n] for n in ("day", "month", "year", "short", "hour", "minute", "second", "mark"))
    marked = F.coalesce(mark, F.lit("")) != ""
    hour24 = F.when(marked, F.when(hour.between(1, 12), hour % 12 + F.when(mark == "PM", 12).otherwise(0))).otherwise(hour)
    fine = (hour24 <= 23) & (minute <= 59) & (second <= 59)
    at = lambda y: F.when(fine & month.between(1, 12) & day.between(1, 31), F.try_make_timestamp_ntz(y, month, day, hour24, minute, second))
    full, checked = F.when(~short & (year >= 1), at(year)), F.when(short, at(F.lit(2000)))
    status = F.when(checked.isNotNull(), "unknown_century").when(full.isNotNull(), "parsed_local_time").otherwise("invalid")
    return F.struct(full.alias("ts"), status.alias("status"), (full.isNotNull() & (day <= 12) & (month <= 12) & (day != month)).alias("ambiguous"))


ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)(Z|[+-]\d{2}:?\d{2})?)?$"


def iso_ts(c: Column) -> Column:
    """struct(local, timezone, interpretation): the wall time as written and the offset if there is one, else unknown."""
    text = F.trim(c)
    day, clock, zone = (F.regexp_extract(text, ISO, n) for n in (1, 2, 3))
    local = F.when(text.rlike(ISO), F.concat(day, F.lit(" "), F.when(clock == "", "00:00:00").when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)).try_cast("timestamp_ntz"))
    offset = F.when(zone == "Z", "+00:00").when(F.length(zone) == 5, F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))).when(zone != "", zone)
    return F.struct(local.alias("local"), F.when(local.isNotNull(), F.coalesce(offset, F.lit("unknown"))).otherwise("unknown").alias("timezone"), F.when(local.isNotNull(), "iso_or_typed_datetime").otherwise("unparsed").alias("interpretation"))


def plain_header(c: Column) -> Column:
    """Letters and digits of a header that is ASCII apart from case and signs."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def duration_view(value: Column, header: Column) -> Column:
    """struct(seconds, unit): H:MM:SS, or a number whose unit the header names."""
    text, name = F.trim(value), plain_header(header)
    clock = r"^(\d+):(\d{2}):(\d{2})$"
    h, m, s = (F.regexp_extract(text, clock, n).try_cast("double") for n in (1, 2, 3))
    timed = F.when(text.rlike(clock) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)
    unit = F.when(name == "durationms", "milliseconds").when(name.isin("durationseconds", "durationsec", "seconds", "sekundy"), "seconds")
    number = F.when(F.replace(text, F.lit(","), F.lit(".")).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.replace(text, F.lit(","), F.lit(".")).try_cast("double"))
    number = F.when((number >= 0) & (number < float("inf")), number)
    named = F.when(unit == "milliseconds", number / 1000).when(unit == "seconds", number)
    return F.struct(F.coalesce(timed, named).alias("seconds"), F.when(timed.isNotNull(), "hh:mm:ss").when(named.isNotNull(), unit).otherwise("unknown").alias("unit"))


def call_end(start: Column, duration: Column) -> Column:
    """struct(ts_end, issue): an end only from whole seconds that are not negative."""
    seconds = F.when(F.trim(duration).rlike(r"^\+?\d{1,12}$"), F.trim(duration).try_cast("bigint"))
    end = F.timestamp_millis(F.unix_millis(start) + seconds * 1000)
    issue = F.when(duration.isNull() | (duration == ""), "duration_missing").when(seconds.isNull(), "duration_invalid").when(F.year(end) > 9999, "end_timestamp_out_of_range")
    return F.struct(F.when(F.year(end) <= 9999, end).alias("ts_end"), issue.alias("issue"))


@F.pandas_udf(T.StringType())
def _folded_header(values: pd.Series) -> pd.Series:
    return values.map(lambda v: re.sub("[^a-z0-9]", "", unicodedata.normalize("NFKD", (v or "").lower()).encode("ascii", "ignore").decode()))


def header_kind(df, header: str):
    """`df` with header_kind: what cells under this header hold, by name; null if the name says nothing. Names are folded once each."""
    kinds = [(name, kind) for kind, names in HEADER_KINDS.items() for name in sorted(names)]
    known = F.broadcast(df.sparkSession.createDataFrame(kinds, "_folded string, header_kind string"))
    names = df.select(header).distinct().withColumn("_folded", _folded_header(header)).join(known, "_folded").drop("_folded")
    return df.join(names, header, "left")


def phone_candidate(c: Column) -> Column:
    cleaned = F.regexp_replace(c, r"[\s().-]", "")
    return F.when(~c.contains("@") & cleaned.rlike(r"^\+?\d{6,15}$"), cleaned)


#: As objects: a worker that imports this module has no session to parse a schema text with.
_SPAN_FIELDS = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]
SPANS = T.ArrayType(T.StructType(_SPAN_FIELDS))
STAMPS = T.ArrayType(T.StructType([*_SPAN_FIELDS, T.StructField("normalized", T.StringType())]))
#: Fixed value: which runs of a file name count.
_STAMP = re.compile(r"(?<!\d)(20\d{2})[-_.]?(\d{2})[-_.]?(\d{2})(?:[T _-]?(\d{2})[:_.-]?(\d{2})(?:[:_.-]?(\d{2}))?)?(?!\d)")
#: Fixed value: which runs of a file name count.
_PHONE = re.compile(r"(?<![A-Za-z0-9+])\+?\d(?:[ ()-]?\d){5,14}(?![A-Za-z0-9])")


def _stamp(groups: tuple) -> str | None:
    numbers = [int(x or 0) for x in groups]
    try:
        return datetime(*numbers).isoformat() if groups[3] is not None else date(*numbers[:3]).isoformat()
    except ValueError:
        return None


@F.pandas_udf(STAMPS)
def filename_timestamps(names: pd.Series) -> pd.Series:
    """Dates of 20YY and times in a file name's stem; those no calendar has are left out."""
    return names.map(lambda n: [{"start": m.start(), "end": m.end(), "text": m.group(), "normalized": x} for m in _STAMP.finditer(n or "") if (x := _stamp(m.groups()))])


@F.pandas_udf(SPANS)
def phone_spans(names: pd.Series) -> pd.Series:
    """Phone-shaped spans of a stem."""
    return names.map(lambda n: [{"start": m.start(), "end": m.end(), "text": m.group()} for m in _PHONE.finditer(n or "")])


def filename_phones(name: Column, stamps: Column) -> Column:
    """Phone-shaped spans of a stem that overlap no timestamp span."""
    return apart(phone_spans(name), stamps)


def apart(spans: Column, stamps: Column) -> Column:
    """The spans that overlap none of the others."""
    return F.filter(spans, lambda p: ~F.exists(stamps, lambda t: (p["start"] < t["end"]) & (p["end"] > t["start"])))


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds, ties to even; null if not finite, negative or beyond 2^63-1 ms."""
    fine = ~F.isnan(seconds) & (seconds >= 0) & (seconds <= (2**63 - 1) / 1000)
    return F.when(fine, F.rint(seconds * 1000).cast("bigint"))


def text_sha256(c: Column) -> Column:
    return F.sha2(c, 256)


@F.pandas_udf(T.StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """Sorted keys, no spaces, no escapes beyond need; null for what is not strict JSON."""
    return values.map(lambda v: _canonical(v)[0])


def _unique(pairs: list) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("duplicate key")
    return dict(pairs)


def _no_constant(name: str):
    raise ValueError(name)


def _canonical(text: str | None) -> tuple[str | None, object]:
    try:
        value = json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant)
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False), value
    except (TypeError, ValueError, RecursionError):
        return None, None


def strict_json_status(c: Column, depth: int = 64, nodes: int = 100_000) -> Column:
    """valid, invalid (not JSON, a duplicate key, a number that isn't finite), too_deep, too_many_nodes or missing."""

    @F.pandas_udf(T.StringType())
    def status(values: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return "missing"
            canonical, value = _canonical(text)
            if canonical is None:
                return "invalid"
            todo, seen, deepest = [(value, 1)], 0, 0
            while todo:
                v, level = todo.pop()
                seen, deepest = seen + 1, max(deepest, level)
                todo += [(x, level + 1) for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
            return "too_deep" if deepest > depth else "too_many_nodes" if seen > nodes else "valid"

        return values.map(one)

    return status(c)


def direction(code: Column, kind: Column) -> Column:
    calls = F.create_map(*(F.lit(x) for pair in {"1": "incoming", "2": "outgoing", "3": "missed", "5": "rejected"}.items() for x in pair))
    texts = F.create_map(*(F.lit(x) for pair in {"1": "incoming", "2": "outgoing"}.items() for x in pair))
    return F.coalesce(F.when(kind == "call", calls[code]).when(kind == "sms", texts[code]), code)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def file_kind(name: Column, mime: Column | None = None) -> Column:
    ext = extension(name)
    out = F.when(ext.isin(*sorted(FILE_KINDS["table"])), "table").when(ext.isin(*sorted(FILE_KINDS["audio"])), "audio").when(ext.isin(*sorted(FILE_KINDS["video"])), "video")
    return out.when(mime.startswith("audio/"), "audio").when(mime.startswith("video/"), "video").otherwise("other") if mime is not None else out.otherwise("other")


def mime_guess(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in MIME_TYPES.items() for x in pair))
    return F.coalesce(known[extension(name)], F.lit("application/octet-stream"))


def event_title(*parts: Column) -> Column:
    return F.concat_ws(" | ", *(F.nullif(p, F.lit("")) for p in parts))


def preview(c: Column, n: int) -> Column:
    return F.struct(F.substring(c, 1, n).alias("text"), F.coalesce(F.length(c) > n, F.lit(False)).alias("truncated"))


def priority_score(manual: Column, seconds: Column, known: Column, conflict: Column, legal: Column) -> Column:
    """The person's priority first; hints only order what has the same one."""
    flag = lambda c, points: F.when(c, points).otherwise(0)
    length = F.when(seconds >= 1200, 180).when(seconds >= 300, 120).when(seconds >= 60, 60).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), manual)) * 10000 + flag(legal, 600) + flag(conflict, 400) + flag(known, 100) + length


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def contains_ci(c: Column, needle: Column) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.lower(needle)), F.lit(False))


def email_domain_match(email: Column, domains: list[str]) -> Column:
    return F.coalesce(F.contains(email, F.lit("@")) & F.substring_index(F.lower(email), "@", -1).isin(*[d.lower() for d in domains]), F.lit(False))


def row_bytes(*columns: Column) -> Column:
    """UTF-8 bytes of the columns' text; null counts nothing."""
    return sum((F.coalesce(F.octet_length(c.cast("string")), F.lit(0)).cast("bigint") for c in columns), F.lit(0).cast("bigint"))


def json_scalar(value: Column) -> Column:
    """struct(value, representation, non_finite) of a DOUBLE: what JSON can't hold is named, not dropped."""
    odd = F.isnan(value) | (F.abs(value) == float("inf"))
    name = F.when(F.isnan(value), "nan").when(value > 0, "inf").otherwise("-inf")
    return F.struct(F.when(~odd, value).alias("value"), F.when(odd, name).alias("representation"), F.coalesce(odd, F.lit(False)).alias("non_finite"))


def sms_mms_body(parts: Column) -> Column:
    """Texts of the plain parts, a line each."""
    plain = F.filter(parts, lambda p: (p["ct"] == "text/plain") & (F.coalesce(p["text"], F.lit("")) != ""))
    return F.array_join(F.transform(plain, lambda p: p["text"]), "\n")


def unknown_if_blank(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
