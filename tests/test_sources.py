"""Sources and sinks on small files with known results."""

import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from provenant.operators import joins, pages
from provenant.sources import corpus, delimited, files, messages, packages, wav, xlsx

SMS = """<smses><sms date="1700000000000" address="+48 600" type="1" body="hej" contact_name="Ala"/><sms date="1700000000000" address="+48 600" type="1" body="hej"/>
<sms date="bad" address="x" type="9" body=""/><note/><mms date="" address="y"><parts><part ct="text/plain" text="a"/><part ct="image/png" text="no"/><part ct="text/plain" text="b"/></parts></mms></smses>"""
#: Each call is odd in one way: no length, a length below zero, one in words, a time in words, one in order.
CALLS = """<calls><call date="1650000000000" number="901" type="2"/><call date="1650000060000" duration="-30" number="902" type="1"/><call date="1650000120000" duration="1 min" number="903" type="44"/><call date="yesterday" duration="5" number="904" type="3"/><call date="1650000180000" duration="3605" number="905" type="5" contact_name="Ela"/></calls>"""


def test_sms_backup(spark, tmp_path):
    (tmp_path / "a.xml").write_text(SMS)
    (tmp_path / "b.xml").write_text(CALLS)
    (tmp_path / "c.xml").write_text("<smses><sms")
    rows = messages.read_sms_backup(spark, str(tmp_path)).orderBy("file", "row").collect()
    sms = [r for r in rows if r.file.endswith("a.xml")]
    assert [r.external_id for r in sms] == ["sms_backup:row:1", "sms_backup:row:2", "sms_backup:row:3", None, "sms_backup:row:5"]
    assert sms[0].direction == "incoming" and sms[2].direction == "9" and sms[4].body == "a\nb"
    assert sms[2].issues == ["timestamp_invalid"] and sms[3].issues == ["unsupported_record_type"] and sms[4].issues == ["timestamp_missing"]
    calls = [r for r in rows if r.file.endswith("b.xml")]
    assert [r.direction for r in calls] == ["outgoing", "incoming", "44", "missed", "rejected"]
    assert [r.issues for r in calls] == [["duration_missing"], ["duration_invalid"], ["duration_invalid"], ["timestamp_invalid"], []]
    assert (calls[4].ts_end - calls[4].ts_start).seconds == 3605 and calls[4].contact_label == "Ela" and calls[3].ts_start is None
    assert [r.issues for r in rows if r.file.endswith("c.xml")] == [["unreadable_file"]]


def test_small_exports_share_a_batch():
    import pyarrow as pa

    files = [(f"{i}.xml", SMS.encode()) for i in range(300)] + [("bad.xml", b"<smses><sms a='1'/></smses><sms/>"), ("other.xml", b"<note/>"), ("none.xml", b"<smses/>")]
    given = pa.RecordBatch.from_arrays([pa.array([path for path, _ in files]), pa.array([content for _, content in files], pa.binary())], names=["path", "content"])
    (found,) = messages._elements(iter([given.slice(0, 100), given.slice(100)]))
    rows = found.to_pylist()
    assert len(rows) == 300 * 5 + 2 and [r["row"] for r in rows[:5]] == [1, 2, 3, 4, 5] and rows[3]["tag"] == "smses/note" and dict(rows[0]["attrs"])["contact_name"] == "Ala"
    assert rows[4]["parts"] == [{"ct": "text/plain", "text": "a"}, {"ct": "image/png", "text": "no"}, {"ct": "text/plain", "text": "b"}] and rows[0]["parts"] == []
    assert [(r["file"], r["row"], r["attrs"]) for r in rows[-2:]] == [("bad.xml", None, None), ("other.xml", None, None)] and rows[-1]["error"] == "unsupported_root"
    assert [b.num_rows for b in messages._elements(iter([given] * 7))] == [10_002, 512]
    long = f"<smses>{f'<sms body="{"x" * 500_000}"/>' * 20}</smses>".encode()  # large elements go in small batches
    given = pa.RecordBatch.from_arrays([pa.array(["a.xml", "b.xml", "c.xml"]), pa.array([long] * 3, pa.binary())], names=["path", "content"])
    assert [b.num_rows for b in messages._elements(iter([given]))] == [20, 20, 20]
    given = pa.RecordBatch.from_arrays([pa.array(["a.xml"]), pa.array([long.replace(b"</smses>", b"") + long.removeprefix(b"<smses>")], pa.binary())], names=["path", "content"])
    assert [b.num_rows for b in messages._elements(iter([given]))] == [20, 20]



CHAT = "preamble\n3/4/2024, 10:05 - Ala: hej\nciąg dalszy\n\n[13/12/2023, 01:02:03 PM] Jan: ok\n31/02/2024, 10:00 - x: y\n1/2/24, 12:00 a.m. - Ala: rok?\n5/5/2024, 13:15 PM - Ala: zle\n6/6/2024, 09:00 - joined"


def test_chat(spark, tmp_path):
    (tmp_path / "chat.txt").write_text(CHAT)
    rows = messages.read_whatsapp(spark, str(tmp_path)).orderBy("message_no").collect()
    assert [(r.message_no, r.sender, r.status) for r in rows] == [(0, None, None), (1, "Ala", "parsed_local_time"), (2, "Jan", "parsed_local_time"), (3, "x", "invalid"), (4, "Ala", "unknown_century"), (5, "Ala", "invalid"), (6, None, "parsed_local_time")]
    assert rows[1].body == "hej\nciąg dalszy\n" and rows[1].ambiguous and (rows[1].line_start, rows[1].line_end) == (2, 4)
    assert rows[2].ts_start.hour == 13 and not rows[2].ambiguous and rows[6].body == "joined"


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Numer telefonu;Data\n\"+48 600\n100 200\";2024-01-02\nźle;x\n".encode("cp1250"))
    (tmp_path / "b.csv").write_bytes("sep=|\na|b\n1|2\n".encode("utf-16"))
    (tmp_path / "c.csv").write_text('a,b\n"open,1\n')
    found = messages.read_files(spark, str(tmp_path))
    cells = delimited.delimited_cells(found)
    rows = {(r.file[-5:], r.row, r.column): r for r in cells.collect()}
    assert rows["a.csv", 1, 0].value == "+48 600\n100 200" and rows["a.csv", 2, 0].start_line == 4 and rows["a.csv", 0, 0].issue == "encoding_fallback_cp1250"
    assert rows["b.csv", 1, 1].value == "2" and rows["b.csv", 0, 0].encoding == "utf-16"
    assert rows["c.csv", 1, None].issue.startswith("malformed_record") and rows["c.csv", 1, None].raw_record == '"open,1\n'
    kinds = {(r.row, r.kind): r.candidate for r in delimited.typed_observations(cells.filter(F.col("file").endswith("a.csv"))).collect()}
    assert kinds == {(1, "phone"): "+48600100200", (2, "phone"): None, (1, "timestamp"): "2024-01-02 00:00:00", (2, "timestamp"): None}
    assert rows["c.csv", 1, None].complete is False and rows["a.csv", 1, 0].complete
    assert delimited.records(cells).filter(F.col("file").endswith("b.csv") & (F.col("row") == 1)).first()["values"] == ["1", "2"]


@pytest.mark.parametrize("odd", ["\u2028", "\u2029", "\x85", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e"])
def test_only_line_ends_end_lines(spark, odd):
    text = f'a;b\r\nx{odd}y;1\r"p{odd}\nq";2\n'
    rows = delimited.delimited_cells(spark.createDataFrame([("f.csv", bytearray(text.encode()))], "path string, content binary")).orderBy("row", "column").collect()
    assert [(r.row, r.column, r.value) for r in rows] == [(0, 0, "a"), (0, 1, "b"), (1, 0, f"x{odd}y"), (1, 1, "1"), (2, 0, f"p{odd}\nq"), (2, 1, "2")]
    assert [r.raw_record for r in rows if r.column == 0] == ["a;b\r\n", f"x{odd}y;1\r", f'"p{odd}\nq";2\n'] and [r.start_line for r in rows if r.column == 0] == [1, 2, 3]


def test_delimiters():
    pick = lambda text, name="f.csv": delimited._delimiter(text, delimited._lines(text), name)
    assert pick("SEP=|\na|b;c\n") == ("|", 1) and pick("a,b\tc\n", "f.TSV") == ("\t", 0)
    # more commas in the first line, but only semicolons are as many in each
    assert pick("a, b, c; d\n1;2\n3;4\n5;6\n7;8\n")[0] == ";" and pick("one\n")[0] == "," and pick("")[0] == ","


def test_whole_fragment_is_kept(spark):
    text = 'a,b\n"open' + "x" * 9000
    row = delimited.delimited_cells(spark.createDataFrame([("f.csv", bytearray(text.encode()))], "path string, content binary")).filter("row = 1").first()
    assert row.raw_record == text[4:] and not row.complete


def book(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_xlsx(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    (tmp_path / "a.xlsx").write_bytes(book({
        "xl/workbook.xml": f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}><si><t>Phone</t></si></sst>",
        "xl/worksheets/s.xml": f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>',
    }))
    (tmp_path / "b.xlsx").write_bytes(b"PK broken")
    hidden = "<!--" + "x" * 5000 + "--><!DOCTYPE w><workbook/>"
    (tmp_path / "d.xlsx").write_bytes(book({"xl/workbook.xml": hidden, "xl/_rels/workbook.xml.rels": "<r/>"}))
    rows = {(r.file[-6:], r.ref): r for r in xlsx.xlsx_cells(messages.read_files(spark, str(tmp_path))).collect()}
    assert rows["a.xlsx", "A1"].value == "Phone" and (rows["a.xlsx", "AB1"].column, rows["a.xlsx", "AB1"].formula, rows["a.xlsx", "AB1"].value) == (28, "1+1", "2")
    assert rows["b.xlsx", None].issue.startswith("unreadable_workbook")
    assert "document_type" in rows["d.xlsx", None].issue


def wave(data=b"\0" * 8, fmt=(1, 1, 8000, 16000, 2, 16), declared=None):
    body = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, *fmt) + b"data" + struct.pack("<I", len(data) if declared is None else declared) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize(("prefix", "size", "whole", "status", "issue"), [
    (wave(), 52, True, "observed", "audio_body_not_validated"), (wave()[:44], None, False, "observed", "data_body_uninspected"), (wave()[:10], None, False, "partial", "header_prefix_incomplete"),
    (wave()[:10], None, True, "malformed", "truncated_header"), (b"RIFX" + wave()[4:], None, True, "unsupported", "unsupported_container"), (wave(fmt=(2, 1, 8000, 16000, 2, 16)), None, True, "unsupported", "unsupported_format"),
    (wave(), 60, False, "size_mismatch", "provider_size_mismatch"), (wave(fmt=(1, 1, 8000, 9, 2, 16)), None, True, "malformed", "invalid_format_geometry"), (wave(declared=99), None, True, "malformed", "chunk_extent_outside_riff"),
    (wave()[:12] + wave()[36:], None, False, "malformed", "data_before_fmt"), (wave()[:4] + struct.pack("<I", 3) + wave()[8:], None, False, "malformed", "invalid_riff_extent"), (wave() + b"xx", 54, True, "malformed", "trailing_bytes"),
    (wave()[:4] + struct.pack("<I", 28) + wave()[8:36], None, True, "malformed", "missing_required_chunk"), (wave()[:30], None, False, "partial", "header_prefix_incomplete"), (wave()[:36], 52, False, "partial", "required_header_unobserved"),
    (b"RIFF" + struct.pack("<I", 44) + b"AVI " + wave()[12:], None, True, "unsupported", "unsupported_wave_type"), (wave()[:-3], 52, True, "malformed", "truncated_chunk_payload"), (wave(fmt=(3, 2, 8000, 64000, 8, 32)), 52, True, "observed", "audio_body_not_validated"),
    (wave(data=b"\0" * 7 + b"\0", declared=7), None, True, "malformed", "unaligned_data_size"), (wave(fmt=(1, 1, 8000, 16000, 2, 12)), None, True, "malformed", "unsupported_sample_width"),
])
def test_wav_probe(prefix, size, whole, status, issue):
    found = wav.probe(prefix, size, whole)
    assert found[0] == status and issue in found[-1]
    assert (found[-2] is not None) == (status == "observed")


def chunk(name, body, size=None):
    return name + struct.pack("<I", len(body) if size is None else size) + body + b"\0" * (len(body) % 2)


def riff(*chunks):
    body = b"WAVE" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


FORMAT = struct.pack("<HHIIHH", 1, 2, 8000, 32000, 4, 16)


def test_wav_layouts():
    fmt, data = chunk(b"fmt ", FORMAT), chunk(b"data", b"\0" * 8)
    assert [c.name for c in wav.layout(riff(chunk(b"LIST", b"abc"), fmt, data)).chunks] == [b"LIST", b"fmt ", b"data"]
    ok = wav.probe(riff(chunk(b"LIST", b"abc"), fmt, data), None, True)
    assert ok[0] == "observed" and ok[-2] == 8 / 32000 and ok[-1] == ["audio_body_not_validated"]
    for broken, code in ((riff(fmt, fmt, data), "duplicate_fmt"), (riff(fmt, data, data), "duplicate_data"), (riff(chunk(b"fmt ", FORMAT[:10]), data), "invalid_fmt_size"), (riff(fmt, data, b"abc"), "truncated_chunk_header")):
        assert wav.probe(broken, None, True)[0] == "malformed" and code in wav.probe(broken, None, True)[-1]
    extended = riff(chunk(b"fmt ", FORMAT + b"\0\0"), data)
    assert wav.probe(extended, None, True)[0] == "observed" and wav.probe(riff(chunk(b"fmt ", FORMAT + b"\2\0"), data), None, True)[0] == "unsupported"
    assert wav.probe(extended[:37], None, False)[-1] == ["header_prefix_incomplete", "required_header_unobserved", "audio_body_not_validated"]
    long = riff(fmt, chunk(b"data", b"\0" * 200_000), chunk(b"LIST", b"x"))
    seen = wav.probe(long, len(long), False)
    assert seen[0] == "observed" and set(seen[-1]) == {"prefix_limit", "data_body_uninspected", "trailing_chunks_uninspected", "audio_body_not_validated"} and seen[-2] == 200_000 / 32000
    first = riff(chunk(b"LIST", b"x" * 70_000), fmt, data)
    assert wav.probe(first, None, False)[0] == "partial" and wav.probe(b"", None, False)[0] == "partial" and wav.probe(b"", None, True)[0] == "malformed"


def test_wav_and_inventory(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.wav").write_bytes(wave())
    (tmp_path / "d" / "a.wav").write_bytes(b"RIFF")
    (tmp_path / "t.csv").write_bytes(b"\xef\xbb\xbfa")
    rows = {r.file[-6:]: r for r in wav.wav_headers(messages.read_files(spark, str(tmp_path), "*.wav")).collect()}
    assert rows["/a.wav"].declared_duration_sec in (8 / 16000, None)
    listed = files.file_inventory(spark, str(tmp_path)).collect()
    assert sorted(r.path for r in listed) == ["a.wav", "d/a.wav", "t.csv"] and {r.path for r in files.file_inventory(spark, f"file://{tmp_path}/").collect()} == {r.path for r in listed}
    assert sorted((r.name, r.kind) for r in listed) == [("a.wav", "audio"), ("a.wav", "audio"), ("t.csv", "table")] and len({r.file_id for r in listed}) == 3
    assert sorted(r.hash_status for r in files.content_digest(spark, str(tmp_path), 10).collect()) == ["complete", "complete", "unknown_over_limit"]
    encoded = messages.read_files(spark, str(tmp_path), "*.csv").select(files.detect_encoding(F.col("content")).alias("e")).first()
    assert encoded.e == "utf-8-sig"


def test_corpus(spark, tmp_path):
    seed = {"contacts": [{"publicId": "1", "phone": "600", "label": "Ala", "interactions": 3, "extra": 1}], "sms": [{"id": "s", "phone": "600", "body": "x", "t": "2024"}], "presets": [{"id": "p", "phones": ["600"]}], "defaultPresetIds": ["q", "p", "p"]}
    (tmp_path / "seed.json").write_text(json.dumps(seed))
    parts = corpus.read_corpus_seed(spark, str(tmp_path / "seed.json"))
    assert parts["contacts"].first().label == "Ala" and parts["sms"].count() == 1 and parts["calls"].count() == 0
    (tmp_path / "none.json").write_text("{}")
    with pytest.raises(ValueError, match="no contacts"):
        corpus.read_corpus_seed(spark, str(tmp_path / "none.json"))


def test_archive_and_package(spark, tmp_path):
    jobs = spark.createDataFrame([(i * 70_000, "ż" if i % 2 else None) for i in range(1, 6)], "id bigint, status string")
    packages.write_archive({"jobs": jobs}, {"jobs": "id"}, str(tmp_path / "a"))
    back = packages.read_archive(spark, str(tmp_path / "a"), {"jobs": "id bigint, status string"})["jobs"]
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, jobs.collect()), key=str)
    assert sorted(r.ordinal for r in spark.read.parquet(str(tmp_path / "a" / "rows")).collect()) == list(range(5))
    proof = lambda: {r.table: r.exact for r in packages.verify_archive(spark, str(tmp_path / "a"), {"jobs": "id bigint, status string"}, {"jobs": "id"}).collect()}
    assert proof() == {"jobs": True, "*": True}
    spark.createDataFrame([(9, '{"id":70001,"status":"x"}')], "ordinal bigint, row_json string").write.mode("append").parquet(str(tmp_path / "a" / "rows" / "table_name=jobs"))
    assert proof() == {"jobs": False, "*": False}
    there = packages.export_package({"jobs": jobs}, {"jobs": "id"}, str(tmp_path / "p"), ["jobs", "tags"]).collect()
    assert {(r.name, r.present) for r in there} == {("jobs", True), ("tags", False)}
    (tmp_path / "p.json").write_text(json.dumps({"schema": "x", "tables": {"jobs": [{"id": 1, "status": "s"}]}}))
    assert packages.read_package(spark, str(tmp_path / "p.json"), {"jobs": "id bigint, status string"})["jobs"].first().status == "s"
    packages.write_events_csv(jobs.withColumn("ts_start", F.current_timestamp()), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 5
    assert {n for n, df in packages.read_package(spark, str(tmp_path / "p.json")).items() if df.count()} == {"jobs"} and len(packages.SCHEMAS) == 16
    packages.write_scan_manifest({"jobs": jobs}, str(tmp_path / "scan"), jobs.agg(F.count("*").alias("files_seen")))
    assert spark.read.parquet(str(tmp_path / "scan/jobs")).count() == 5 and spark.read.parquet(str(tmp_path / "scan/coverage")).first().files_seen == 5


def test_packets_with_errors_are_not_written(spark, tmp_path):
    artifacts = spark.createDataFrame([(1, 5, "a", "p"), (2, None, None, "p"), (3, 77, "c", "p")], "id bigint, source_id bigint, sha256 string, stored_path string")
    derived = spark.createDataFrame([(i, i, "transcript", r, "[]") for i, r in ((1, 10), (2, 10), (3, None))] + [(4, 1, "summary", None, "[]")], "id bigint, artifact_id bigint, kind string, run_id bigint, segments_json string")
    sources = spark.createDataFrame([(5, "s")], "id bigint, label string")
    runs = spark.createDataFrame([(10, 1, "failed", "secret", "")], "id bigint, artifact_id bigint, status string, lease_token string, tool string")
    seen = spark.createDataFrame([(100, 1, "legacy_snapshot")], "observation_id bigint, artifact_id bigint, acquisition_kind string")
    anchors = spark.createDataFrame([(i, i, i, "q") for i in (1, 2, 3)] + [(4, 1, 4, "q")], "anchor_id bigint, artifact_id bigint, derived_text_id bigint, quote_text string")
    found = {r.anchor_id: r for r in joins.citation_packets(anchors, artifacts, derived, sources, seen, runs).collect()}
    assert {i: r.errors for i, r in found.items()} == {1: [], 2: ["missing_or_foreign_run"], 3: ["missing_source"]}
    assert found[1].unknowns == ["acquisition_history_partial", "processing_run_success_unconfirmed", "processing_run.tool_unknown"] and "source_content_digest_unknown" in found[2].unknowns
    assert "stored_path" not in found[1].artifact and "lease_token" not in found[1].run
    packages.write_citation_packets(joins.citation_packets(anchors, artifacts, derived, sources, seen, runs), str(tmp_path / "packets"))
    assert [r.packet_id for r in packages.read_citation_packets(spark, str(tmp_path / "packets")).collect()] == [1]


def test_row_caps_report(spark):
    rows = spark.createDataFrame([(f, i) for f, n in (("a", 5), ("b", 2), ("c", 4)) for i in range(n)], "file string, row int")
    kept, issues = pages.cap_rows(rows, 3, 6)
    assert sorted(map(tuple, kept.groupBy("file").count().collect())) == [("a", 3), ("b", 2), ("c", 1)]
    assert sorted(map(tuple, issues.collect())) == [("a", "file_row_limit"), ("c", "file_row_limit"), ("c", "total_row_limit")]


def test_a_file_beyond_two_gigabytes_is_hashed_in_chunks(spark, tmp_path):
    import hashlib
    import resource

    from provenant.sources import files

    large, size, chunk = tmp_path / "large.bin", (1 << 31) + 12_345, 1 << 26
    with large.open("wb") as f:  # sparse: it takes no room
        f.truncate(size)
        f.seek(size - 3)
        f.write(b"end")
    rows = [(1, f"file:{large}"), (2, str(tmp_path / "gone")), (3, None), (4, str(tmp_path)), (5, f"file://{large}")]
    (tmp_path / "empty").write_bytes(b"")
    rows.append((6, str(tmp_path / "empty")))
    found = {r.id: r for r in files.stream_digests(spark.createDataFrame(rows[:4] + rows[5:], "id bigint, path string"), chunk=chunk).collect()}
    whole, zero = hashlib.sha256(), b"\0" * chunk
    for _ in range(size // chunk):
        whole.update(zero)
    whole.update(b"\0" * (size % chunk - 3) + b"end")
    assert found[1].digest == whole.hexdigest() and found[1]["size"] == size and len(found[1].chunks) == 33 and found[1].chunks[0] == hashlib.sha256(zero).hexdigest()
    assert found[2].failure == found[3].failure == "missing" and found[4].failure.startswith("unreadable") and found[6].digest == hashlib.sha256(b"").hexdigest() and found[6].chunks == []
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert files._stream_digests(f"file://{large}", 1 << 20)[1] == whole.hexdigest()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


def test_files_are_written_under_their_last_names(spark, tmp_path):
    rows = spark.range(40).selectExpr(f"concat('{tmp_path}/k=', id % 7, '/', id, '.bin') as path", "cast(repeat('x', cast(id as int)) as binary) as content").repartition(3)
    assert files.write_files(rows) == 40 and files.write_files(rows) == 40  # again writes the same
    found = {p.relative_to(tmp_path).as_posix(): p.stat().st_size for p in tmp_path.rglob("*") if p.is_file()}
    assert found == {f"k={i % 7}/{i}.bin": i for i in range(40)}  # no check sums, marks or temporary folders beside them
    assert files.write_files(rows.limit(0)) == 0
    listed = files.content_digest(spark, str(tmp_path), 20)
    assert sorted(r.hash_status for r in listed.collect()) == ["complete"] * 20 + ["unknown_over_limit"] * 19  # Spark lists no empty file


def test_cells_of_small_files_share_a_batch():
    import pyarrow as pa

    files = pa.table({"path": [f"{i}.csv" for i in range(50)], "content": [f"a;b\n\n{i};\"x\ny\"\n".encode() + (b'"z' if i == 7 else b"") for i in range(50)]})
    (batch,) = delimited._cells(iter(files.to_batches(max_chunksize=20)))
    got = [tuple(r.values()) for r in batch.to_pylist()]
    want = []
    for i in range(50):
        want += [(f"{i}.csv", n, c, v, r if c == 0 else None, at, "utf-8", ";", True, None) for n, r, at, vs in ((0, "a;b\n", 1, "ab"), (2, f'{i};"x\ny"\n', 3, (str(i), "x\ny"))) for c, v in enumerate(vs)]
        want += [("7.csv", 3, None, None, '"z', 5, "utf-8", ";", False, "malformed_record: unexpected end of data")] if i == 7 else []
    assert got == want
